"""An episodic memory over DataFrames: write a batch of events, ask a batch of questions.

The first engine: salience from novelty, postings, learned graphs, recall and ranking.
Asking changes nothing; access counts and feedback are separate calls. A write adds to what
the memory knows: feedback, access counts and replayed edges stay. The clock numbers the
writes of a namespace, replayed ones too; the features' averages and each stream's last
write are kept for the writes to come.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle

from . import encode as E
from . import gates as G
from . import graph as GR
from . import maintain as M
from . import rank as K
from . import recall as R
from . import store as S
from . import upkeep as U


@dataclass
class Settings:
    dimension: int = 65_536
    topk: int = 128
    rule: str = "covariance"
    steps: int = 2
    results: int = 5
    candidates: int = 500
    max_degree: int = 128
    hash_mode: str = "md5"
    recall: dict = field(default_factory=dict)
    upkeep: U.Upkeep = field(default_factory=U.Upkeep)
    rate: float = GR.RATE
    temporal_rate: float = GR.TEMPORAL_RATE
    decay: float = GR.DECAY
    interval: int = GR.INTERVAL
    max_pairs: int = GR.MAX_PAIRS
    cap: bool = True
    allow_negative: bool = False
    #: Options of ``text_features`` and of ``hash_codes`` beside those above.
    grams: dict = field(default_factory=dict)
    hashing: dict = field(default_factory=dict)
    #: Weights and bounds of the salience gate, where they are not the usual ones.
    salience: dict = field(default_factory=dict)
    salience_range: tuple[float, float] = G.SALIENCE_RANGE
    #: Weights of the score parts, as ``score_v1`` and ``score_v2`` name them.
    weights: dict = field(default_factory=dict)
    #: Which edges messages follow: learned, zero, shuffled or random.
    edges: str = "learned"
    edge_seed: int = 0

    def growth(self) -> dict:
        """Options of ``graph.grown``."""
        return {"decay": self.decay, "interval": self.interval, "max_degree": self.max_degree, "cap": self.cap, "allow_negative": self.allow_negative}


class Memory:
    """Episodes, postings and graphs of one or more namespaces; namespaces never mix."""

    TABLES = ("episodes", "codes", "association", "temporal", "clock", "averages", "last")
    #: The graphs among them.
    GRAPHS = ("association", "temporal")

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.episodes: DataFrame | None = None
        self.codes: DataFrame | None = None
        self.association: DataFrame | None = None
        self.temporal: DataFrame | None = None
        self.clock: DataFrame | None = None
        self.averages: DataFrame | None = None
        self.last: DataFrame | None = None
        self.log_of_upkeep: list[dict] = []
        self._trail: list[DataFrame] = []
        self._final: DataFrame | None = None

    def _encode(self, texts: DataFrame, key: str) -> DataFrame:
        s = self.settings
        keyed = texts.select(F.struct("ns", key).alias("_k"), "text")
        coded = E.hash_codes(E.text_features(keyed, "_k", "text", **s.grams), "_k", s.dimension, s.topk, hash_mode=s.hash_mode, **s.hashing)
        return coded.select("_k.ns", f"_k.{key}", "feature", "w")

    ENGINE = 1

    def write(self, events: DataFrame) -> Memory:
        """Events have (ns, episode_id, seq, text) and may have stream, timestamp and confidence.

        Later batches have larger seq; a repeated id replaces, of several in a round the
        last is written. Maintenance follows each round (``upkeep.py``).
        """
        rows, u = self._events(events), self.settings.upkeep
        if u == U.Upkeep():
            return self._write(settle(rows, "events"))
        counts = None if self.episodes is None else self.event_counts()
        dealt = settle(U.rounds(rows, counts, u.every or u.replay_every), "rounds")
        for k in range(1 + (dealt.agg(F.max("_round")).first()[0] or 0)):
            self._write(dealt.filter(F.col("_round") == k).drop("_round"))
            self.log_of_upkeep += U.maintain(self, u, self.ENGINE)
        return self

    def event_counts(self) -> DataFrame:
        """(ns, n): events written so far."""
        return self.clock.select("ns", "n")

    def _events(self, events: DataFrame) -> DataFrame:
        events = events if "stream" in events.columns else events.withColumn("stream", F.lit("default"))
        events = events if "timestamp" in events.columns else events.withColumn("timestamp", F.lit(None).cast("string"))
        told = [F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence")] if "confidence" in events.columns else []
        return events.select("ns", "episode_id", F.col("seq").cast("long").alias("seq"), "stream", "text", F.col("timestamp").cast("string").alias("timestamp"), *told)

    def _write(self, rows: DataFrame) -> Memory:
        counted = rows.groupBy("ns").agg(F.count(F.lit(1)).alias("_events"))
        new = settle(S.upsert_latest(rows.withColumn("_id", F.struct("ns", "episode_id")), "_id", "seq").drop("_id"), "events")
        coded = settle(self._encode(new, "episode_id").join(new.select("ns", "episode_id", "seq", "stream"), ["ns", "episode_id"]), "coded")
        known = coded.withColumn("until", F.lit(None).cast("long"))
        if self.codes is not None:
            replaced = new.select("ns", "episode_id", F.col("seq").alias("until"))
            known = self.codes.select(*coded.columns).join(replaced, ["ns", "episode_id"], "left").unionByName(known)
        fresh = G.novelty(known, only=new)
        scored = new.join(fresh, ["ns", "episode_id"], "left").withColumn("novelty", F.coalesce("novelty", F.lit(1.0)))
        scored = scored.withColumn("salience", self._salience(F.col("novelty"))).withColumn("checksum", F.sha2("text", 256))
        scored = settle(scored.withColumns({c: F.expr(v) for c, v in self.FEEDBACK.items() if c not in scored.columns}), "scored")
        self._learn(coded, scored, counted)
        left = lambda df: df.join(new.select("ns", "episode_id"), ["ns", "episode_id"], "left_anti")
        self.episodes = settle(scored if self.episodes is None else left(self.episodes).unionByName(scored, allowMissingColumns=True), "episodes")
        self.codes = settle(coded if self.codes is None else left(self.codes).unionByName(coded), "codes")
        return self

    #: What feedback starts from.
    FEEDBACK = {"confidence": "1.0D", "authority": "1.0D", "access_count": "0L", "last_access": "CAST(NULL AS TIMESTAMP)", "labile": "false"}

    def _learn(self, coded: DataFrame, scored: DataFrame, counted: DataFrame | None = None) -> None:
        """Adds the writes of ``coded`` (ns, seq, stream, feature, w), with the salience of ``scored``, to graphs, averages and clock."""
        s = self.settings
        plain = coded.select("ns", "seq", "feature", "w")
        weight = GR.with_write_number(scored.select("ns", "seq", "salience"), self.clock).select("ns", "t", "salience")
        weight = settle(weight, "weights")
        coded_writes = weight.groupBy("ns").agg(F.max("t").alias("t"))
        counted = coded_writes.select("ns", F.lit(0).alias("_events")) if counted is None else counted
        known = coded_writes.select("ns", F.lit(0).alias("_t"), F.lit(0).alias("_n")).limit(0) if self.clock is None else self.clock.select("ns", F.col("t").alias("_t"), F.col("n").alias("_n"))
        now = known.join(coded_writes, "ns", "full").join(counted, "ns", "left")
        now = settle(now.select("ns", F.coalesce("t", "_t").cast("long").alias("t"), (F.coalesce("_n", F.lit(0)) + F.coalesce("_events", F.lit(0))).cast("long").alias("n")), "clock")
        numbered = GR.with_write_number(scored.select("ns", "seq"), self.clock)
        scaled = lambda d: d.join(weight, ["ns", "t"]).withColumn("delta", F.col("delta") * F.col("salience")).drop("salience")
        grown = lambda edges, d: settle(GR.grown(edges, scaled(d), self.clock, now, **s.growth()), "edges")
        chained = coded.select("ns", "seq", "stream", "feature", "w")
        if self.association is None and self.temporal is None and self.last is None and s.rule in ("hebb", "covariance", "bcm"):
            folded = lambda events: settle(GR.event_fold(events.join(weight, ["ns", "t"]), now, **s.growth()), "edges")
            self.association = folded(GR.pair_events(plain, s.rule, s.rate, s.max_pairs, numbered, self.averages))
            self.temporal = folded(GR.temporal_events(chained, ["stream"], s.temporal_rate, s.max_pairs, numbered))
        else:
            self.association = grown(self.association, GR.pair_deltas(plain, s.rule, s.rate, max_pairs=s.max_pairs, numbers=numbered, known=self.averages))
            self.temporal = grown(self.temporal, GR.temporal_deltas(chained, ["stream"], s.temporal_rate, s.rule, s.max_pairs, numbers=numbered, last=self.last))
        averages = GR.final_activity(GR.strongest(plain, s.max_pairs), s.rate, known=self.averages)
        if self.averages is not None:
            averages = self.averages.join(averages.select("ns", "feature"), ["ns", "feature"], "left_anti").unionByName(averages)
        self.averages = settle(averages, "averages")
        ends = scored.groupBy("ns", "stream").agg(F.max("seq").alias("seq"))
        last = chained.join(ends, ["ns", "stream", "seq"], "left_semi")
        if self.last is not None:
            last = self.last.join(ends, ["ns", "stream"], "left_anti").select(*last.columns).unionByName(last)
        self.last, self.clock = settle(last, "last"), now

    def ask(self, queries: DataFrame) -> DataFrame:
        """Queries have (ns, query_id, text); gives ranked (ns, query_id, episode_id, scores, rank, text)."""
        s = self.settings
        state = self._encode(queries, "query_id").withColumnRenamed("w", "v")
        state = settle(state, "queries")
        self._trail = []
        final, timed = R.recall(state, *self.followed(), s.steps, trail=self._trail, **s.recall)
        self._final = final
        seen = state.select("ns", "query_id", "feature").unionByName(final.select("ns", "query_id", "feature")).unionByName(timed.select("ns", "query_id", "feature")).distinct()
        tagged = seen.withColumn("_q", F.struct("ns", "query_id"))
        votes = S.candidate_votes(tagged, self.codes, s.candidates, ["ns", "feature"], "_q").select("_q.ns", "_q.query_id", "episode_id")
        parts = K.score_parts(votes, self.codes, {"exact": state, "associative": final, "temporal": timed})
        parts = parts.join(self.episodes.select("ns", "episode_id", "confidence"), ["ns", "episode_id"]) if s.weights.get("confidence_weight") else parts.withColumn("confidence", F.lit(0.0))
        scored = K.score_v1(parts, confidence=F.col("confidence"), **s.weights).drop("confidence")
        return K.ranked(scored, s.results).join(self.episodes.select("ns", "episode_id", "text"), ["ns", "episode_id"])

    def trace(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(final, temporal) states (ns, query_id, feature, v) that the questions complete to."""
        state = settle(self._encode(queries, "query_id").withColumnRenamed("w", "v"), "queries")
        return R.recall(state, *self.followed(), self.settings.steps, **self.settings.recall)

    def _salience(self, novelty: Column) -> Column:
        s = self.settings
        return G.salience({"novelty": novelty}, G.SALIENCE | s.salience, s.salience_range)

    def followed(self) -> tuple[DataFrame, DataFrame]:
        """(association, temporal) edges that messages follow, under the condition of the settings."""
        s = self.settings
        if GR.condition(s.edges) == "learned":
            return self.association, self.temporal
        return GR.conditioned(self.association, s.edges, s.edge_seed), GR.conditioned(self.temporal, s.edges, s.edge_seed + 1_000_003)

    def visits(self) -> DataFrame:
        """(ns, query_id, active, visits) of the questions asked last: features of the final state, and the edges that messages passed over all steps."""
        edges = self.followed()
        met = [R.edge_visits(state, *edges, reverse=self.ENGINE == 1) for state in self._trail]
        active = self._final.groupBy("ns", "query_id").agg(F.count(F.lit(1)).alias("active"))
        if not met:
            return active.withColumn("visits", F.lit(0).cast("long"))
        every = met[0]
        for m in met[1:]:
            every = every.unionByName(m)
        return every.groupBy("ns", "query_id").agg(F.sum("visits").alias("visits")).join(active, ["ns", "query_id"], "full").select("ns", "query_id", F.coalesce("active", F.lit(0).cast("long")).alias("active"), F.coalesce("visits", F.lit(0).cast("long")).alias("visits"))

    def stats(self) -> DataFrame:
        """A row for each namespace: episodes, postings, and nodes and edges of each graph."""
        none = F.lit(0).cast("long")
        out = self.episodes.groupBy("ns").agg(F.count(F.lit(1)).alias("episodes"))
        out = out.join(self.codes.groupBy("ns").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("feature").alias("features")), "ns", "left")
        for name in self.GRAPHS:
            sized = getattr(self, name).groupBy("ns").agg(F.countDistinct("src").alias(f"{name}_nodes"), F.count(F.lit(1)).alias(f"{name}_edges"))
            out = out.join(sized, "ns", "left")
        return out.select("ns", *[F.coalesce(c, none).alias(c) for c in out.columns if c != "ns"])

    def use(self, results: DataFrame, as_of: Column, verified: bool | None = None) -> DataFrame:
        """The episodes after the results of ``ask`` were used: accesses counted, confidence and authority moved within 0 and 2."""
        known = self.episodes.select("ns", "episode_id", "checksum")
        ranked = results.select("ns", "episode_id", "rank").join(known, ["ns", "episode_id"]).withColumn("has_checksum", F.col("checksum").isNotNull())
        one = lambda df: df.withColumn("episode_id", F.struct("ns", "episode_id"))
        rows = self.episodes
        used = K.with_feedback(one(rows), K.after_use(one(ranked), verified), as_of)
        self.episodes = settle(used.withColumn("episode_id", F.col("episode_id.episode_id")), "episodes")
        return self.episodes

    def replay(self, strategy: str, budget: int, scale: float = 0.25, with_temporal: bool = False, spaces: DataFrame | None = None) -> DataFrame:
        """Writes the verified ones of the chosen episodes once more, in the namespaces of ``spaces`` (ns) where it is given; returns the chosen (ns, episode_id, place, salience, verified)."""
        rows = self.episodes.withColumn("timestamp", F.col("seq"))
        rows = rows if spaces is None else rows.join(spaces, "ns", "left_semi")
        chosen = M.replay_select(rows.withColumn("verified", M.replay_verified(F.col("text"), F.col("checksum"))), strategy, budget)
        chosen = settle(chosen.select("ns", "episode_id", "place", "salience", "verified"), "chosen")
        made = M.replay_run(chosen, self.codes, self.association, self.temporal, scale, rule=self.settings.rule, with_temporal=with_temporal, after=self.clock, known=self.averages, rates=(self.settings.rate, self.settings.temporal_rate), max_pairs=self.settings.max_pairs, **self.settings.growth())
        self.association, self.temporal = (settle(e, "edges") for e in made)
        again = self.codes.join(chosen.filter("verified").select("ns", "episode_id", "place"), ["ns", "episode_id"]).select("ns", F.col("place").alias("seq"), "feature", "w")
        averages = GR.final_activity(GR.strongest(again, self.settings.max_pairs), self.settings.rate, known=self.averages)
        self.averages = settle(self.averages.join(averages.select("ns", "feature"), ["ns", "feature"], "left_anti").unionByName(averages), "averages")
        self.clock = settle(self.clock.join(M.replay_writes(chosen).withColumnRenamed("n", "_replayed"), "ns", "left").select("ns", (F.col("t") + F.coalesce("_replayed", F.lit(0))).alias("t"), "n"), "clock")
        return chosen

    def clear(self) -> Memory:
        for name in self.TABLES:
            setattr(self, name, None)
        return self

    def count(self) -> int:
        return 0 if self.episodes is None else self.episodes.count()

    def forget(self, gone: DataFrame) -> Memory:
        """Removes episodes (ns, episode_id) and folds the graphs again from the others, so no edge of theirs stays.

        The others keep their codes, salience and feedback; they are folded in order of
        timestamp and id, those without a timestamp after them in order of seq.
        """
        left = lambda df: settle(df.join(gone.select("ns", "episode_id").distinct(), ["ns", "episode_id"], "left_anti"), "left")
        self.episodes, self.codes = left(self.episodes), left(self.codes)
        self.rebuild(gone.select("ns").distinct())
        return self

    def rebuild(self, spaces: DataFrame | None = None) -> None:
        """Learns the graphs of some namespaces (ns), or of all, anew from the stored codes and salience."""
        if spaces is None:
            self._rebuild()
            return
        part = type(self)(self.settings)
        spaces = settle(spaces, "spaces")
        for name in self.TABLES:
            setattr(part, name, getattr(self, name).join(spaces, "ns", "left_semi"))
        part._rebuild()
        for name in self.TABLES:
            rest = getattr(self, name).join(spaces, "ns", "left_anti")
            setattr(self, name, settle(rest.unionByName(getattr(part, name), allowMissingColumns=True), name))

    def _rebuild(self) -> None:
        counts = self.clock.select("ns", F.lit(0).cast("long").alias("t"), "n")
        ordered = self._in_rebuild_order(self.episodes)
        coded = self.codes.drop("seq", "stream").join(ordered.select("ns", "episode_id", "seq", "stream"), ["ns", "episode_id"])
        self.association = self.temporal = self.averages = self.last = None
        self.clock = settle(counts, "clock")
        self._learn(settle(coded, "coded"), ordered)
        seqs = self.episodes.select("ns", "stream", "episode_id", F.col("seq").alias("_seq"))
        renamed = ordered.select("ns", "episode_id", "seq").join(seqs, ["ns", "episode_id"]).select("ns", "stream", "seq", "_seq")
        self.last = settle(self.last.join(renamed, ["ns", "stream", "seq"]).select("ns", F.col("_seq").alias("seq"), "stream", "feature", "w"), "last")

    @staticmethod
    def _in_rebuild_order(episodes: DataFrame) -> DataFrame:
        """The episodes with their place in the order of a rebuild as seq."""
        order = [F.col("timestamp").asc_nulls_last(), F.when(F.col("timestamp").isNull(), F.col("seq")), "episode_id"]
        return settle(episodes.withColumn("seq", F.row_number().over(W.partitionBy("ns").orderBy(*order)).cast("long")), "order")

    def shape(self) -> tuple[int, int]:
        """(engine, dimension of the codes)."""
        return self.ENGINE, self.settings.dimension

    def save(self, folder: str) -> None:
        """Writes all tables, and the shape that ``load`` compares."""
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        spark = self.episodes.sparkSession
        spark.createDataFrame([self.shape()], "engine int, dimension int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")

    @classmethod
    def load(cls, spark, folder: str, settings: Settings | None = None) -> Memory:
        """A saved memory; fails if it was saved by the other engine or has another dimension than ``settings`` ask for."""
        out = cls(settings)
        saved = tuple(spark.read.parquet(f"{folder}/shape").first())
        if settings is None and cls.ENGINE == 1:
            out.settings.dimension = saved[1]
        if saved != out.shape():
            raise ValueError(f"saved with engine and dimension {saved}, not {out.shape()}")
        for name in cls.TABLES:
            setattr(out, name, spark.read.parquet(f"{folder}/{name}"))
        return out
