"""Runs of configurations on both engines, their files, and the comparison of two runs."""

import json

import numpy as np
import pytest

from recallgrid.__main__ import main
from recallgrid.operators import stats as B
from recallgrid.operators.memory import Memory, Settings
from recallgrid.sources import experiment as X
from recallgrid.sources import runner as RU
from recallgrid.sources.generators import synthetic


def test_settings_of_a_configuration():
    config = X.resolve({"memory": {"encoder": {"params": {"dimension": 512, "topk": 9, "wordngrams": [1], "seed": 3}}, "graph": {"rule": "bcm", "learningrate": 0.3, "edgecondition": "permuted"}, "retrieval": {"exactweight": 0.5}, "consolidation": {"fixedcapacityepisodes": 4, "evictionpolicy": "fifo"}}})
    s = X.settings(config)
    assert (s.dimension, s.topk, s.grams, s.hashing, s.rule, s.rate, s.edges) == (512, 9, {"words": (1,)}, {"seed": 3}, "bcm", 0.3, "shuffled")
    assert s.weights["exact"] == 0.5 and (s.upkeep.capacity, s.upkeep.policy, s.upkeep.replay_every) == (4, "fifo", 0)
    with pytest.raises(NotImplementedError, match="recencyweight"):
        X.settings(X.resolve({"memory": {"retrieval": {"recencyweight": 0.1}}}))
    with pytest.raises(NotImplementedError, match="allownegativeedges"):
        X.settings(X.resolve({"memory": {"variant": "hippocampal", "graph": {"allownegativeedges": True}}}))
    with pytest.raises(ValueError, match="unknown edge condition"):
        X.settings(X.resolve({"memory": {"graph": {"edgecondition": "odd"}}}))
    with pytest.raises(ValueError, match="unknown parameters"):
        X.settings(X.resolve({"memory": {"encoder": {"params": {"odd": 1}}}}))


def test_a_run_writes_its_files(spark, tmp_path, monkeypatch):
    config = {**RU.SMOKE, "dataset": {"type": "synthetic", "params": {"tasks": ["paired_associate"], "examplespertask": 2, "distractors": 3, "seed": 7}}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(config))
    out = str(tmp_path / "run")
    assert main(["run", str(path), "--outputdir", out]) == 0
    summary = json.loads("".join(r.value for r in spark.read.text(f"{out}/summary").collect()).replace("\n", ""))
    assert summary["aggregate"]["examples"] == 2 and summary["aggregate"]["recall"]["estimate"] == 1.0 and summary["aggregate"]["write_seconds"] > 0
    assert len(summary["environment"]["config_sha256"]) == 64
    rows = spark.read.json(f"{out}/per_example").collect()
    for r in rows:
        assert r.retrieved_ids and len(r.retrieved_ids) == len(r.retrieved_scores) and r.retrieved_scores == sorted(r.retrieved_scores, reverse=True)
        assert r.recall_message_edge_visits > 0 and r.memory_bytes_total == r.memory_episode_bytes + r.memory_graph_bytes and r.association_edges > 0
    again = Memory.load(spark, f"{out}/graph", Settings(dimension=8192))
    assert again.count() == sum(1 for _ in rows) * 4
    with pytest.raises(ValueError, match="dimension"):
        Memory.load(spark, f"{out}/graph", Settings(dimension=4096))
    assert main(["compare", out, out, "--metric", "recall", "--samples", "50", "--signs", "50"]) == 0


def test_edge_visits_count_every_step(spark):
    events = spark.createDataFrame([("a", "e1", 1, "red fox"), ("a", "e2", 2, "red dog")], "ns string, episode_id string, seq long, text string")
    asked = spark.createDataFrame([("a", "q", "red"), ("a", "none", "unknown")], "ns string, query_id string, text string")
    memory = Memory(Settings(dimension=4096, rule="hebb", steps=2, grams={"words": (1,)})).write(events)
    memory.ask(asked).collect()
    edges = [{(r.src, r.dst) for r in e.collect()} for e in (memory.association, memory.temporal)]
    code = {(r.episode_id, r.feature) for r in memory.codes.collect()}
    (red,) = {f for e, f in code if e == "e1"} & {f for e, f in code if e == "e2"}
    met = lambda state: sum((s in state) for s, _ in edges[0]) + sum((s in state) + (d in state) for s, d in edges[1])
    reached = {red} | {d for s, d in edges[0] | edges[1] if s == red} | {s for s, d in edges[1] if d == red}
    got = {r.query_id: (r.active, r.visits) for r in memory.visits().collect()}
    assert got["q"] == (len(reached), met({red}) + met(reached)) and got["none"][1] == 0
    stats = memory.stats().first()
    assert (stats.episodes, stats.features, stats.association_edges, stats.temporal_edges) == (2, 3, len(edges[0]), len(edges[1]))


def test_edge_conditions_change_messages(spark):
    events = spark.createDataFrame([("a", "e1", 1, "red fox"), ("a", "e2", 2, "fox hill")], "ns string, episode_id string, seq long, text string")
    asked = spark.createDataFrame([("a", "q", "red")], "ns string, query_id string, text string")
    memory = Memory(Settings(dimension=4096, rule="hebb")).write(events)
    learned = memory.trace(asked)[0].count()
    memory.settings.edges = "zero"
    assert memory.trace(asked)[0].count() == 1 < learned
    for name in ("shuffled", "random"):
        memory.settings.edges = name
        assert [e.count() > 0 for e in memory.followed()] == [True, True]


def test_second_engine_runs(spark):
    config = X.resolve({"memory": {"variant": "hippocampal", "encoder": {"params": {"dimension": 2048, "topk": 32}}, "graph": {"rule": "hebb", "maxdegree": 32}, "context": {}}})
    settings = X.settings(config)
    settings.context_dimension, settings.binding_dimension, settings.address_topk, settings.context_degree = 256, 512, 48, 16
    per_example, means, memory, seconds = RU.measured(synthetic(spark, ["paired_associate"], 2, 3), settings, reader=lambda prompts: ["x" for _ in prompts])
    rows = per_example.collect()
    assert len(rows) == 2 and all(r.recall == 1.0 and r.prediction == "x" and r.exact_match == 0.0 and r.token_f1 == 0.0 and r.links_edges > 0 and r.recall_message_edge_visits > 0 for r in rows)
    assert memory.ENGINE == 2 and set(seconds) == {"write_seconds", "read_seconds"}


def test_events_keep_their_confidence(spark):
    rows = [("x", "t", "q", [], [], [], [("e1", "one", None, '{"confidence": 0.5}'), ("e2", "two", None, None)])]
    made = spark.createDataFrame(rows, "example_id string, task string, query string, answers array<string>, evidence_ids array<string>, negative_ids array<string>, events array<struct<event_id:string,text:string,timestamp:string,metadata:string>>")
    memory = Memory(Settings(dimension=512)).write(RU._events(made))
    assert {r.episode_id: r.confidence for r in memory.episodes.collect()} == {"e1": 0.5, "e2": 1.0}


def test_comparison(spark):
    base = spark.createDataFrame([("a", 1.0, None), ("b", 0.0, 1.0), ("c", 0.5, 0.0), ("x", 1.0, None)], "example_id string, recall double, f1 double")
    new = spark.createDataFrame([("c", 1.0, 1.0), ("b", 1.0, 1.0), ("a", 1.0, 1.0), ("y", 0.0, None)], "example_id string, recall double, f1 double")
    got = {r.metric: r for r in B.comparison(base, new, ["recall", "f1"], samples=300, signs=300, seed=5).collect()}
    r = got["recall"]
    assert (r.baseline_examples, r.treatment_examples, r.paired_examples, r.baseline_only_ids, r.treatment_only_ids) == (4, 4, 3, ["x"], ["y"])
    assert (got["f1"].baseline_examples, got["f1"].paired_examples, got["f1"].treatment_only_ids, got["f1"].baseline_only_ids) == (2, 2, ["a"], [])
    d = np.array([0.0, 1.0, 0.5])
    assert (r.estimate, r.lower, r.upper) == B.bootstrap(d, 300, 0.95, 5)[:3] and r.p_value == B.randomization_p(d, 300, 5)
    with pytest.raises(ValueError, match="no paired examples for f1"):
        B.comparison(base.filter("example_id = 'a'"), new, ["f1"])
    with pytest.raises(ValueError, match="repeated"):
        B.comparison(base.union(base), new, ["recall"])
