"""Maintenance inside write: capacity, bytes, consolidation and replay at their points."""

from pyspark.sql import functions as F

from recallgrid.operators import upkeep as U
from recallgrid.operators.capsules import BoundMemory, BoundSettings
from recallgrid.operators.memory import Memory, Settings

EVENT = "ns string, episode_id string, seq long, text string, timestamp string"
TEXTS = ["the red kite flies over the valley", "a blue boat waits in the harbour", "rumour of rain", "the boat left early", "a green hill far away", "the red kite flies over the valley"]
SMALL = {"dimension": 512, "topk": 12, "steps": 1, "max_degree": 6}


def events(spark, n, spaces="nm"):
    rows = [(spaces[i % len(spaces)], f"e{i}", i, TEXTS[(i // len(spaces)) % 6], f"2024-01-{1 + i:02d}") for i in range(n)]
    return spark.createDataFrame(rows, EVENT)


def ids(memory):
    return {(r.ns, r.episode_id) for r in memory.episodes.collect()}


def test_capacity_consolidation_and_replay(spark):
    upkeep = U.Upkeep(capacity=4, policy="fifo", consolidate=True, similarity=0.99, replay_every=3, replay_budget=2, every=3)
    memory = Memory(Settings(upkeep=upkeep, **SMALL)).write(events(spark, 12))
    kinds = [x["kind"] for x in memory.log_of_upkeep]
    assert kinds == ["replay", "consolidation", "eviction", "replay"]
    left = ids(memory)
    # each namespace had six, of which the first and last say the same: one prototype, then the oldest goes
    assert {e for s, e in left if s == "n"} == {"prototype:e0+e10", "e4", "e6", "e8"} and len(left) == 8
    merged = memory.episodes.filter("episode_id = 'prototype:e0+e10'").first()
    assert merged.timestamp == "2024-01-11" and merged.text.count(TEXTS[0]) == 2
    assert {r.ns: r.n for r in memory.clock.collect()} == {"n": 6, "m": 6}
    stored = {(r.ns, r.feature) for r in memory.codes.collect()}
    assert all((r.ns, r.src) in stored and (r.ns, r.dst) in stored for r in memory.association.collect())


def test_bytes_are_kept_in_each_namespace(spark):
    whole = Memory(Settings(**SMALL)).write(events(spark, 7, "nnm"))
    size = {r.ns: r.episode_bytes + r.graph_bytes for r in U.sizes(whole).collect()}
    assert size["n"] > size["m"]
    kept = Memory(Settings(upkeep=U.Upkeep(capacity_bytes=size["n"] - 100, policy="fifo"), **SMALL)).write(events(spark, 7, "nnm"))
    assert {e for s, e in ids(kept) if s == "m"} == {e for s, e in ids(whole) if s == "m"}
    assert {x["kind"] for x in kept.log_of_upkeep} == {"byte_eviction"} and 0 < len([1 for s, _ in ids(kept) if s == "n"]) < 5
    edges = lambda memory: {(r.src, r.dst): r.w for r in memory.association.filter("ns = 'm'").collect()}
    assert edges(kept) == edges(whole)


def test_second_engine_keeps_its_capacity(spark):
    settings = BoundSettings(rule="hebb", context_dimension=64, binding_dimension=64, upkeep=U.Upkeep(capacity=2, policy="fifo", replay_every=2, replay_budget=1, replay_strategy="salience", every=2), **SMALL)
    memory = BoundMemory(settings).write(events(spark, 4, "n"))
    assert ids(memory) == {("n", "e2"), ("n", "e3")}
    assert [x["kind"] for x in memory.log_of_upkeep] == ["replay", "eviction", "replay"]
    assert memory.event_counts().first().n == 4 and memory.codes.select("episode_id").distinct().count() == 2


def test_rounds_end_at_multiples(spark):
    rows = spark.createDataFrame([("n", i) for i in range(7)] + [("m", 1)], "ns string, seq long")
    counts = spark.createDataFrame([("n", 5)], "ns string, n long")
    got = U.rounds(rows, counts, 3).groupBy("ns", "_round").agg(F.count(F.lit(1)).alias("c")).collect()
    assert {(r.ns, r._round): r.c for r in got} == {("n", 0): 1, ("n", 1): 3, ("n", 2): 3, ("m", 0): 1}
