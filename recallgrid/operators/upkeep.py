"""Maintenance of a memory between its writes: consolidation, capacity, bytes and replay.

A batch is written in rounds that end where a namespace's number of events reaches a
multiple of ``every`` (of ``replay_every`` where that is 0), and maintenance follows each
round, in this order: consolidation and eviction of namespaces above their capacity,
eviction of those above their bytes, replay of those whose number of events is a multiple of
``replay_every``. With ``every`` = 1 each event is followed by its maintenance; longer
rounds let the events of a round see what an eviction would have taken. Graphs are folded
again for the namespaces that lost episodes, and for no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle

from . import maintain as M

KEYS = ["ns", "episode_id"]
BYTE_ROUNDS = 3


@dataclass
class Upkeep:
    """What a memory does by itself; 0 switches a limit off. Limits hold for each namespace."""

    capacity: int = 0
    policy: str = "salience"
    capacity_bytes: int = 0
    consolidate: bool = False
    similarity: float = 0.92
    group: int = 2
    replay_every: int = 0
    replay_budget: int = 64
    replay_strategy: str = "salience"
    replay_scale: float = 0.25
    every: int = 0


def rounds(events: DataFrame, counts: DataFrame | None, every: int) -> DataFrame:
    """Adds _round to events (ns, seq), from 0; a round ends at a multiple of ``every`` events of the namespace, ``counts`` (ns, n) included."""
    if every <= 0:
        return events.withColumn("_round", F.lit(0).cast("long"))
    place = F.row_number().over(W.partitionBy("ns").orderBy("seq")) - 1
    if counts is None:
        return events.withColumn("_round", F.floor(place / every))
    before = F.coalesce("_n", F.lit(0)) % every
    return events.join(counts.select("ns", F.col("n").alias("_n")), "ns", "left").withColumn("_round", F.floor((place + before) / every)).drop("_n")


def sortable(episodes: DataFrame) -> DataFrame:
    """Episodes whose times are texts; those without a timestamp come after the others, in order of seq."""
    return episodes.withColumns({"timestamp": F.coalesce("timestamp", F.concat(F.lit("~"), F.lpad(F.col("seq").cast("string"), 20, "0"))), "last_access": F.date_format("last_access", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})


def _over(memory, most: int) -> DataFrame:
    return memory.episodes.groupBy("ns").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("ns")


def _consolidate(memory, upkeep: Upkeep, log: list[dict]) -> None:
    spaces = settle(_over(memory, upkeep.capacity), "over")
    if spaces.isEmpty():
        return
    codes = memory.codes.join(spaces, "ns", "left_semi")
    found = M.greedy_groups(codes, upkeep.similarity, upkeep.group)
    members = settle(found.join(memory.episodes, ["ns", "seq"]).select("ns", "seed", *[c for c in memory.episodes.columns if c != "ns"]), "members")
    if members.isEmpty():
        return
    ids = F.transform(F.sort_array(F.collect_list(F.struct("seq", "episode_id", "text"))), lambda x: x["episode_id"].cast("string"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "episode_id", "text"))), lambda x: x["text"])
    made = members.groupBy("ns", "seed").agg(
        F.concat(F.lit("prototype:"), F.array_join(ids, "+")).alias("episode_id"), F.array_join(texts, "\n\n").alias("text"), F.max("timestamp").alias("timestamp"),
        F.max("salience").alias("salience"), F.avg("confidence").alias("confidence"), F.max("seq").alias("seq"),
    )
    made = settle(made.withColumns({"stream": F.lit("default"), "authority": F.lit(1.0), "access_count": F.lit(0).cast("long"), "labile": F.lit(False)}), "prototypes")
    weighed = members.select(F.struct("ns", "seed").alias("group_id"), F.struct(*KEYS).alias("episode_id"), "salience", "confidence")
    entries = codes.select(F.struct(*KEYS).alias("episode_id"), "feature", "w")
    merged = M.prototypes(weighed, entries, memory.settings.topk).select("group_id.ns", "group_id.seed", "feature", "w").join(made.select("ns", "seed", "episode_id", "seq", "stream"), ["ns", "seed"])
    left = lambda df: df.join(members.select(*KEYS), KEYS, "left_anti")
    memory.codes = settle(left(memory.codes).unionByName(merged.select(*memory.codes.columns)), "codes")
    memory.episodes = settle(left(memory.episodes).unionByName(made.drop("seed"), allowMissingColumns=True), "episodes")
    memory.rebuild(made.select("ns").distinct())
    log.append({"kind": "consolidation", "groups": made.count(), "removed": members.count()})


def _forget(memory, marked: DataFrame, kind: str, log: list[dict]) -> bool:
    gone = settle(marked.filter("evicted").select(*KEYS), "gone")
    n = gone.count()
    if n:
        memory.forget(gone)
        log.append({"kind": kind, "evicted": n})
    return n > 0


def sizes(memory) -> DataFrame:
    """(ns, episode_bytes, graph_bytes): logical bytes, 20 an entry with its posting, 12 an edge and 12 a node of a graph."""
    each = episode_sizes(memory).groupBy("ns").agg(F.sum("bytes").alias("episode_bytes"))
    edges = memory.association.select("ns", "src", "dst", F.lit(1).alias("g")).unionByName(memory.temporal.select("ns", "src", "dst", F.lit(2).alias("g")))
    nodes = edges.select("ns", F.col("src").alias("node")).unionByName(edges.select("ns", F.col("dst").alias("node"))).distinct().groupBy("ns").agg(F.count(F.lit(1)).alias("_nodes"))
    graph = edges.groupBy("ns").agg(F.count(F.lit(1)).alias("_edges")).join(nodes, "ns").select("ns", (12 * (F.col("_edges") + F.col("_nodes"))).alias("graph_bytes"))
    return each.join(graph, "ns", "left").fillna(0, ["graph_bytes"])


def episode_sizes(memory) -> DataFrame:
    """The episodes with their logical bytes."""
    rows = memory.episodes
    features = memory.codes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_f"))
    meta: Column = F.octet_length("metadata") if "metadata" in rows.columns else F.lit(2)
    size = M.episode_bytes(F.coalesce("_f", F.lit(0)), F.coalesce("text", F.lit("")), F.coalesce(meta, F.lit(2)), F.col("episode_id").cast("string"), F.coalesce("timestamp", F.lit("")))
    return rows.join(features, KEYS, "left").withColumn("bytes", size.cast("long")).drop("_f")


def maintain(memory, upkeep: Upkeep, engine: int = 1) -> list[dict]:
    """Runs what is due after a round; gives what was done."""
    log: list[dict] = []
    if upkeep.capacity > 0:
        if upkeep.consolidate and engine == 1:
            _consolidate(memory, upkeep, log)
        if not _over(memory, upkeep.capacity).isEmpty():
            _forget(memory, M.evict(sortable(memory.episodes), upkeep.policy, upkeep.capacity), "eviction", log)
    for _ in range(BYTE_ROUNDS if upkeep.capacity_bytes > 0 and engine == 1 else 0):
        over = settle(sizes(memory).filter(F.col("episode_bytes") + F.col("graph_bytes") > upkeep.capacity_bytes), "over")
        if over.isEmpty():
            break
        budget = over.select("ns", F.greatest(F.lit(0), F.lit(upkeep.capacity_bytes) - F.col("graph_bytes")).alias("_budget"))
        rows = sortable(episode_sizes(memory).join(budget, "ns"))
        if not _forget(memory, M.evict_bytes(rows, upkeep.policy, F.col("_budget")), "byte_eviction", log):
            break
    if upkeep.replay_every > 0:
        due = settle(memory.event_counts().filter((F.col("n") > 0) & (F.col("n") % upkeep.replay_every == 0)).select("ns"), "due")
        if not due.isEmpty():
            chosen = memory.replay(upkeep.replay_strategy, upkeep.replay_budget, upkeep.replay_scale, spaces=due)
            log.append({"kind": "replay", "replayed": chosen.filter("verified").count()})
    return log
