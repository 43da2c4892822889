"""The second engine: texts bound to contexts, two-signed gates, allocation, feature birth and an episode index.

Every write sees the addresses and graphs that the one before it left (``ordered.py``), so
results do not depend on how events are dealt into batches. State is kept in keyed tables;
a batch reads the entries that it touches and gives back those that it changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle

from . import encode as E
from . import gates as G
from . import graph as GR
from . import maintain as M
from . import ordered as O
from . import rank as K
from . import recall as R
from . import store as S
from .memory import Memory, Settings

KEYS = ["ns", "episode_id"]


@dataclass
class BoundSettings(Settings):
    context_dimension: int = 8192
    context_topk: int = 64
    binding_dimension: int = 16_384
    address_topk: int = 192
    slots: int = 1024
    birth_threshold: float = 0.75
    hub: float = 0.5
    context_rate: float = 0.1
    context_degree: int = 128
    index_features: int = 192
    active: int = 64
    #: Events of a namespace that are folded in one call, which bounds its memory.
    together: int = 2000

    @property
    def reserved(self) -> int:
        """The first feature for births, behind the blocks of an address."""
        return self.dimension + self.context_dimension + self.binding_dimension

    def fold(self) -> O.FoldSettings:
        return O.FoldSettings(rule=self.rule, rate=self.rate, temporal_rate=self.temporal_rate, max_pairs=self.max_pairs, decay=self.decay, interval=self.interval, context_rate=self.context_rate, max_degree=self.max_degree, context_degree=self.context_degree, hub=self.hub, slots=self.slots, birth_threshold=self.birth_threshold, reserved=self.reserved)


class BoundMemory(Memory):
    """As ``Memory``, by the second engine; events may have metadata (JSON), timestamp, checksum, confidence and stream.

    ``log`` has every address ever written and ``codes`` those of the episodes now
    stored; ``contexts`` has the context codes, ``links`` the edges from context to address
    features, ``state`` the other keyed state of the fold. Later batches have larger seq,
    and no two events of a namespace have the same.
    """

    TABLES = ("episodes", "codes", "association", "temporal", "log", "contexts", "links", "state")
    GRAPHS = ("association", "temporal", "links")

    def __init__(self, settings: BoundSettings | None = None):
        super().__init__(settings or BoundSettings())
        self.log: DataFrame | None = None
        self.contexts: DataFrame | None = None
        self.links: DataFrame | None = None
        self.state: DataFrame | None = None

    def _bind(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(bound codes, context codes) as (ns, key, feature, w) of rows with text, metadata and timestamp."""
        s = self.settings
        keyed = rows.select(F.struct("ns", key).alias("_k"), "text", "metadata", "timestamp")
        hidden = settle(E.hash_codes(E.text_features(keyed, "_k", "text", **s.grams), "_k", s.dimension, s.topk, hash_mode=s.hash_mode, **s.hashing), "hidden")
        named = E.json_features(keyed, "_k", "metadata", exclude=("timestamp", "encoding_diagnostics"))
        timed = keyed.select("_k", F.explode(E.time_features(E.iso_local_time(F.col("timestamp")), F.col("timestamp"))).alias("name"))
        context = settle(E.hash_codes(named.unionByName(timed), "_k", s.context_dimension, s.context_topk, prefix="ctx:"), "contexts")
        bound = E.bind(hidden, context, "_k", s.dimension, s.context_dimension, s.binding_dimension, s.address_topk)
        flat = lambda df: df.select("_k.ns", f"_k.{key}", F.col("feature").cast("long").alias("feature"), "w")
        return settle(flat(bound), "bound"), flat(context)

    @staticmethod
    def _gates(new: DataFrame) -> DataFrame:
        """The events with what their metadata say: status, checksum, corrections, and the gates without novelty and redundancy."""
        rows = new.withColumn("_m", G.metadata(F.col("metadata")))
        given = lambda name: F.try_element_at("_m", F.lit(name))
        none = F.lit(None).cast("double")
        metrics = G.dopamine_metrics(F.col("_m"), F.length("text"), none, none, parsed=True)
        plain = {**metrics, "novelty": F.lit(0.0), "redundancy": F.lit(0.0)}
        generated = F.coalesce(given("generated").try_cast("boolean"), F.lit(False)) | F.coalesce(given("hypothetical").try_cast("boolean"), F.lit(False))
        weights = G.BIRTH
        return rows.withColumns(
            {
                "told": metrics["novelty"],
                "redundancy": metrics["redundancy"],
                "positive": G.raw_gate(plain, G.POSITIVE),
                "negative": G.raw_gate(plain, G.NEGATIVE),
                "utility": metrics["downstreamutility"],
                "birth": weights["retrieval_error"] * G.number(given("retrieval_error")) + weights["budget_pressure"] * G.number(given("budget_pressure")),
                "risk": metrics["poisonrisk"],
                "status": G.status(F.col("metadata")),
                "checksum": G.checksum_for(F.col("text"), F.col("checksum"), generated),
                "corrects": F.coalesce(F.nullif(given("corrects"), F.lit("")), given("supersedes")),
                "recency": G.number(given("recency")),
            }
        ).drop("_m")

    def _fold(self, told: DataFrame, bound: DataFrame, contexts: DataFrame) -> DataFrame:
        """Folds the events into the state and the graphs; gives the changes."""
        s = self.settings.fold()
        packed = lambda df, name: df.groupBy("ns", "seq").agg(F.collect_list(F.struct("feature", "w")).alias(name))
        events = told.select("ns", "seq", F.col("episode_id").cast("string").alias("episode"), "stream", (F.col("status") == "rejected").alias("rejected"), F.col("told").alias("novelty"), "redundancy", "positive", "negative", "utility", "birth")
        events = events.join(packed(bound, "code"), ["ns", "seq"], "left").join(packed(contexts, "context"), ["ns", "seq"], "left")
        if self.codes is None:
            events = events.withColumn("stored", F.lit(None).cast("array<struct<episode:string,votes:long,dot:double>>"))
        else:
            again = self.episodes.select(*KEYS).join(told.select(*KEYS).distinct(), KEYS, "left_semi").groupBy("ns").count()
            more = again.agg(F.max("count")).first()[0] or 0  # those that this batch writes again drop out on the way
            events = events.join(O.rivals(bound, self.codes, s.rivals + more), ["ns", "seq"], "left")
        graphs = {name: getattr(self, name) for name in O.GRAPHS}
        known = O.touched_state(self.state, graphs, told, bound, contexts)
        if known is None:
            known = told.sparkSession.createDataFrame([], f"ns {told.schema['ns'].dataType.simpleString()}, {O.STATE}")
        changes = settle(O.fold_writes(events, known, s), "changes")
        before = None if self.state is None else self.state.filter("kind = 'clock'")
        self.association = settle(O.renewed_edges(self.association, changes, "association", before, s.decay, s.interval), "edges")
        self.temporal = settle(O.renewed_edges(self.temporal, changes, "temporal", before, s.decay, s.interval), "edges")
        self.links = settle(O.renewed_edges(self.links, changes, "links", before), "edges")
        self.state = settle(O.renewed_state(self.state, changes), "state")
        return changes

    def _corrected(self, episodes: DataFrame, scored: DataFrame) -> DataFrame:
        """Episodes that a later event of the batch corrects lose confidence and index authority."""
        named = F.when(F.startswith("corrects", F.lit("[")), F.from_json("corrects", "array<string>")).otherwise(F.array("corrects"))
        said = scored.filter("corrects IS NOT NULL").select("ns", F.col("episode_id").cast("string").alias("new_id"), F.col("seq").alias("_s"), F.explode(named).alias("_old"))
        hits = episodes.select(*KEYS, "seq").join(said, "ns").filter((F.col("_old") == F.col("episode_id").cast("string")) & (F.col("seq") < F.col("_s")))
        hits = hits.select(F.struct(*KEYS).alias("old_id"), "new_id")
        table = episodes.withColumn("_id", F.struct(*KEYS)).drop("episode_id").withColumnsRenamed({"_id": "episode_id", "authority": "_latent", "index_authority": "authority", "superseded_by": "_was"})
        out = G.corrected(table, hits).withColumn("superseded_by", F.coalesce("superseded_by", "_was")).drop("_was")
        out = out.withColumnsRenamed({"authority": "index_authority", "_latent": "authority"})
        return out.withColumn("episode_id", F.col("episode_id.episode_id"))

    ENGINE = 2

    def shape(self) -> tuple[int, int]:
        """(engine, dimension of the addresses without births)."""
        return self.ENGINE, self.settings.reserved

    def event_counts(self) -> DataFrame:
        return self.state.filter("kind = 'clock'").select("ns", F.col("a").alias("n"))

    def _events(self, events: DataFrame) -> DataFrame:
        usual = {"stream": F.lit("default"), "metadata": F.lit("{}"), "timestamp": F.lit(None).cast("string"), "checksum": F.lit(None).cast("string"), "confidence": F.lit(1.0)}
        rows = events.withColumns({c: v for c, v in usual.items() if c not in events.columns})
        return rows.select(*KEYS, F.col("seq").cast("long").alias("seq"), *["text", *usual])

    def _write(self, rows: DataFrame) -> BoundMemory:
        """Folds events in order of seq; a repeated id replaces."""
        most = rows.groupBy("ns").count().agg(F.max("count")).first()[0] or 0
        if most <= self.settings.together:
            return self._written(rows)
        place = F.row_number().over(W.partitionBy("ns").orderBy("seq")) - 1
        dealt = settle(rows.withColumn("_round", F.floor(place / self.settings.together)), "rounds")
        for k in range(-(-most // self.settings.together)):
            self._written(dealt.filter(F.col("_round") == k).drop("_round"))
        return self

    def _written(self, new: DataFrame) -> BoundMemory:
        bound, contexts = self._bind(new, "seq")
        contexts = settle(contexts, "contexts")
        told = settle(self._gates(new), "gates")
        changes = self._fold(told, bound, contexts)
        x = F.col("x")
        scores = changes.filter("kind = 'score'").select("ns", F.col("a").alias("seq"), x[0].alias("novelty"), x[1].alias("interference"), x[2].alias("salience"), x[3].alias("negative"), x[4].alias("birth_score"), F.col("b").alias("slot"))
        scored = told.drop("told", "redundancy", "positive", "negative", "utility", "birth").join(scores, ["ns", "seq"])
        scored = settle(scored.withColumn("authority", G.latent_authority(F.col("status"), F.col("risk"))), "scored")
        made = O.entries(changes.filter("kind = 'address'"), "seq", "feature")
        made = made.join(scored.select(*KEYS, "seq", "stream", (F.col("status") == "rejected").alias("rejected")), ["ns", "seq"]).select(*KEYS, "seq", "stream", "rejected", "feature", "w")
        self.log = settle(made if self.log is None else self.log.unionByName(made), "log")
        last = S.upsert_latest(scored.withColumn("_id", F.struct(*KEYS)), "_id", "seq").drop("_id")
        fresh = last.withColumns({"index_authority": F.col("authority"), "access_count": F.lit(0).cast("long"), "last_access": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string"), "labile": F.lit(False)})
        old = None if self.episodes is None else self.episodes.join(new.select(*KEYS).distinct(), KEYS, "left_anti")
        episodes = self._corrected(fresh if old is None else old.unionByName(fresh, allowMissingColumns=True), scored)
        self.episodes = settle(episodes, "episodes")
        stored = self.episodes.select(*KEYS, "seq")
        self.codes = settle(self.log.join(stored, [*KEYS, "seq"], "left_semi"), "codes")
        named = contexts.join(scored.select(*KEYS, "seq"), ["ns", "seq"]).select(*KEYS, "seq", "feature", "w")
        every = named if self.contexts is None else self.contexts.unionByName(named)
        self.contexts = settle(every.join(stored, [*KEYS, "seq"], "left_semi"), "contexts")
        return self

    def _completed(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """(state, context, final, temporal, episode scores) of the queries."""
        s = self.settings
        usual = {"metadata": F.lit("{}"), "timestamp": F.lit(None).cast("string")}
        state, context = (c.withColumnRenamed("w", "v") for c in self._bind(queries.withColumns({c: v for c, v in usual.items() if c not in queries.columns}), "query_id"))
        known = self.episodes.filter("status <> 'rejected'").select(*KEYS, "salience")
        index = settle(GR.episode_index(self.codes.join(known, KEYS), F.col("salience"), s.index_features), "index")
        authority = self.episodes.select(*KEYS, F.col("index_authority").alias("authority"))
        told = settle(R.context_messages(context, self.links), "context-messages")
        self._trail = []
        final, timed, nodes = R.complete(state, *self.followed(), index, told, top=s.active, authority=authority, steps=s.steps, trail=self._trail, **s.recall)
        self._final = settle(final, "final")
        return state, context, self._final, settle(timed, "timed"), settle(nodes, "nodes")

    def ask(self, queries: DataFrame) -> DataFrame:
        """Queries have (ns, query_id, text) and may have metadata and timestamp; gives ranked (ns, query_id, episode_id, scores, rank, text)."""
        s = self.settings
        state, context, final, timed, nodes = self._completed(queries)
        seen = state.select("ns", "query_id", "feature").unionByName(final.select("ns", "query_id", "feature")).unionByName(timed.select("ns", "query_id", "feature")).distinct()
        asking = F.struct("ns", "query_id").alias("_q")
        votes = S.candidate_votes(seen.withColumn("_q", asking), self.codes, s.candidates, ["ns", "feature"], "_q")
        pairs = S.candidate_union(votes, nodes.select(asking, "episode_id", "score"), s.candidates, "_q")
        pairs = settle(pairs.select("_q.ns", "_q.query_id", "episode_id"), "pairs")
        parts = K.score_parts(pairs, self.codes, {"exact": state, "associative": final, "temporal": timed})
        near = pairs.join(self.contexts.select(*KEYS, "feature", "w"), KEYS).join(context, ["ns", "query_id", "feature"])
        near = near.groupBy("ns", "query_id", "episode_id").agg(F.sum(F.col("w") * F.col("v")).alias("context"))
        known = self.episodes.select(*KEYS, "status", "risk", "authority", "confidence", "recency", "text")
        full = parts.join(near, ["ns", "query_id", "episode_id"], "left").join(nodes.withColumnRenamed("score", "episode_node"), ["ns", "query_id", "episode_id"], "left").join(known, KEYS)
        return K.ranked(K.score_v2(full.fillna(0.0, ["context", "episode_node"]), **s.weights), s.results)

    def trace(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(final, temporal, episode scores) that the questions complete to."""
        return self._completed(queries)[2:]

    def use(self, results: DataFrame, as_of: Column, verified: bool | None = None) -> DataFrame:
        """As in the first engine; it is the authority in the episode index that moves."""
        self.episodes = self.episodes.withColumnsRenamed({"authority": "_latent", "index_authority": "authority"}).drop("labile")
        super().use(results, as_of, verified)
        self.episodes = self.episodes.withColumnsRenamed({"authority": "index_authority", "_latent": "authority"})
        return self.episodes

    def replay(self, strategy: str = "salience", budget: int = 32, scale: float = 0.15, with_temporal: bool = True, spaces: DataFrame | None = None) -> DataFrame:
        """Writes the trusted ones of the chosen episodes once more and quarantines the others; returns the chosen."""
        trusted = ~M.replay_quarantined(F.col("status"), F.col("checksum"))
        rows = self.episodes if spaces is None else self.episodes.join(spaces, "ns", "left_semi")
        chosen = M.replay_select(rows.withColumn("verified", trusted), strategy, budget, engine=2)
        chosen = settle(chosen.select(*KEYS, "place", "salience", "verified"), "chosen")
        codes = self.codes.select(*KEYS, "seq", "feature", "w")
        clock = self.state.filter("kind = 'clock'").select("ns", F.col("b").alias("t"))
        averages = self.state.filter("kind = 'average'").select("ns", F.col("a").alias("feature"), F.col("v").alias("mu"), F.col("u").alias("m2"))
        made = M.replay_run(chosen, codes, self.association, self.temporal, scale, engine=2, rule=self.settings.rule, with_temporal=with_temporal, after=clock, known=averages, rates=(self.settings.rate, self.settings.temporal_rate), max_pairs=self.settings.max_pairs, **self.settings.growth())
        self.association, self.temporal = (settle(e, "edges") for e in made)
        again = codes.join(chosen.filter("verified").select(*KEYS, "place"), KEYS).select("ns", F.col("place").alias("seq"), "feature", "w")
        moved = GR.final_activity(GR.strongest(again, self.settings.max_pairs), self.settings.rate, known=averages)
        changes = moved.select("ns", F.lit("average").alias("kind"), F.col("feature").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("s"), F.array("mu", "m2").alias("x"))
        counted = self.state.filter("kind = 'clock'").join(M.replay_writes(chosen), "ns")
        changes = changes.unionByName(counted.select("ns", "kind", "a", (F.col("b") + F.col("n")).alias("b"), "s", F.array("v", F.coalesce("u", F.lit(1.0))).alias("x")))
        self.state = settle(O.renewed_state(self.state, changes), "state")
        moved = self.episodes.join(M.replay_authority(chosen, scale), KEYS, "left")
        authority = GR.adjusted_authority(F.col("index_authority"), F.coalesce("change", F.lit(0.0)))
        self.episodes = settle(moved.withColumn("index_authority", authority).drop("change"), "episodes")
        return chosen

    def forget(self, gone: DataFrame) -> BoundMemory:
        """As in the first engine; status, novelty and versions of the others stay, and their index authority is the latent one again."""
        left = lambda df: settle(df.join(gone.select(*KEYS).distinct(), KEYS, "left_anti"), "left")
        self.episodes, self.codes, self.contexts = left(self.episodes), left(self.codes), left(self.contexts)
        self.rebuild(gone.select("ns").distinct())
        return self

    def _rebuild(self) -> None:
        """Learns the three graphs anew from the stored addresses and context codes; rejected episodes take no part."""
        s = self.settings.fold()
        ordered = self._in_rebuild_order(self.episodes.filter("status <> 'rejected'"))
        seqs = ordered.select(*KEYS, "seq", "stream", "salience")
        coded = settle(self.codes.select(*KEYS, "feature", "w").join(seqs, KEYS), "coded")
        numbers, now = seqs.select("ns", "seq", F.col("seq").alias("t")), seqs.groupBy("ns").agg(F.max("seq").alias("t"))
        scaled = lambda d: d.join(seqs.select("ns", F.col("seq").alias("t"), "salience"), ["ns", "t"]).withColumn("delta", F.col("delta") * F.col("salience")).drop("salience")
        grown = lambda d, **options: settle(GR.grown(None, scaled(d), None, now, **options), "edges")
        rules = {"decay": s.decay, "interval": s.interval, "max_degree": s.max_degree}
        self.association = grown(GR.pair_deltas(coded.select("ns", "seq", "feature", "w"), s.rule, s.rate, max_pairs=s.max_pairs, numbers=numbers), **rules)
        self.temporal = grown(GR.temporal_deltas(coded.select("ns", "seq", "stream", "feature", "w"), ["stream"], s.temporal_rate, s.rule, s.max_pairs, numbers=numbers), **rules)
        contexts = self.contexts.select(*KEYS, "feature", "w").join(seqs.select(*KEYS, F.col("seq").alias("t")), KEYS)
        addresses = coded.select(*KEYS, F.col("seq").alias("t"), "feature", "w")
        links = GR.context_deltas(contexts, addresses, s.context_rate, KEYS, ["t"])
        self.links = grown(links, decay=0.0, interval=0, max_degree=s.context_degree, cap=False, allow_negative=True)
        averages = GR.final_activity(GR.strongest(coded.select("ns", "seq", "feature", "w"), s.max_pairs), s.rate)
        last = coded.join(seqs.groupBy("ns", "stream").agg(F.max("seq").alias("seq")), ["ns", "stream", "seq"], "left_semi")
        none = lambda kind: F.lit(None).cast(kind)
        rows = averages.select("ns", F.lit("average").alias("kind"), F.col("feature").alias("a"), none("long").alias("b"), none("string").alias("s"), F.col("mu").alias("v"), F.col("m2").alias("u"))
        rows = rows.unionByName(last.select("ns", F.lit("previous").alias("kind"), F.col("feature").alias("a"), none("long").alias("b"), F.col("stream").alias("s"), F.col("w").alias("v"), none("double").alias("u")))
        kept = self.state.filter("kind IN ('eligibility', 'clock')").join(now.select("ns", F.col("t").alias("_t")), "ns", "left")
        clock = F.when(F.col("kind") == "clock", F.coalesce("_t", F.lit(0))).otherwise(F.col("b"))
        self.state = settle(kept.withColumn("b", clock).drop("_t").unionByName(rows), "state")
        self.episodes = settle(self.episodes.withColumn("index_authority", F.col("authority")), "episodes")
