"""The example runner, open metadata and the version ledger."""

import json

import pytest

from recallgrid.operators import encode as E
from recallgrid.operators import versions as V
from recallgrid.operators.memory import Settings
from recallgrid.sources.generators import synthetic
from recallgrid.sources.runner import run_examples


def test_runner(spark):
    examples = synthetic(spark, ["paired_associate", "replay_poison"], 2, 5)
    per_example, means = run_examples(examples, Settings(dimension=4096, rule="hebb", steps=1))
    got = per_example.collect()
    assert len(got) == 4 and all(r.recall == 1.0 for r in got if r.task == "paired_associate")
    assert {(r.task, r.metric) for r in means.collect()} >= {("paired_associate", "recall"), (None, "ndcg")}


def test_flat_features(spark):
    meta = {"speaker": " Ann ", "tool_state": {"tool": "x", "n": 0}, "flag": True, "list": [1, "b"], "none": None, "timestamp": "2024-02-05T03:00:00Z", "bad": float("nan")}
    df = spark.createDataFrame([(1, json.dumps(meta)), (2, None)], "id long, meta string")
    got = {r.name for r in E.json_features(df, "id", "meta", exclude=("list",)).collect()}
    assert got == {"speaker:ann", "tool_state.tool:x", "tool_state.n:num:pos:1e-9", "tool_state.n:num_rounded:0.0", "flag:true", "time:year:2024", "time:month:2024-02", "time:weekday:0", "time:hour:3", "bad:nan"}
    listed = spark.createDataFrame([(1, '{"l": [1, "b"], "n": {"b": null, "a": [[1, 2, 3], {"z": 1e7, "y": true}, -0.0001]}, "time": "2024-02-26T23:00:00Z"}'), (2, "no json"), (3, "[]"), (4, None)], "id int, meta string")
    names = {}
    for r in E.json_features(listed, "id", "meta").collect():
        names.setdefault(r.id, set()).add(r.name)
    assert names == {
        1: {"l:len:2", "l[0]:num:pos:1e0", "l[0]:num_rounded:1.0", "l[1]:b", "n.a:len:3", "n.a[0]:len:3", "n.a[0][0]:num:pos:1e0", "n.a[1].y:true", "n.a[1].z:num:pos:1e7", "n.a[2]:num:neg:1e-4", "n.a[2]:num_rounded:-0.0"}
        | {"time:year:2024", "time:month:2024-02", "time:weekday:0", "time:hour:23"},
        3: {":len:0"},
    }


def test_ledger(spark):
    rows = [("a", "observed", 1.0, 1.0, "c"), ("b", "observed", 0.9, 1.0, None)]
    ledger = V.register(spark.createDataFrame(rows, "episode_id string, status string, confidence double, authority double, checksum string"))
    got = {r.memory_id: r for r in V.supersede(ledger, spark.createDataFrame([("a", "b")], "old_id string, new_id string")).collect()}
    assert (got["a"].status, got["a"].confidence, got["b"].supersedes, got["b"].version_id) == ("superseded", 0.25, ["a"], "b:v1")
    assert V.current(ledger).count() == 2
    with pytest.raises(Exception, match="unknown status"):
        V.register(spark.createDataFrame([("a", "odd", 1.0, 1.0, "c")], "episode_id string, status string, confidence double, authority double, checksum string")).collect()


def test_triggers():
    assert not V.consolidation_due(True, 5, None) and V.consolidation_due(True, 5, 4)
    assert V.eviction_due(1, None, 10, 5) and not V.eviction_due(1, None, 10, 5, engine=2)
