import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import latent as L
from recallgrid.operators.capsules import BoundMemory
from recallgrid.operators.memory import Memory, Settings
from recallgrid.sources import backend as B


def test_token_topk_from_names():
    assert L.token_topk("codec-L0_100") == 100 and L.token_topk("w64k-l0-50-x") == 50 and L.token_topk("plain", 7) == 7


@pytest.mark.parametrize("pooling", ["positive_max", "max", "mean", "sum", "last"])
def test_topk_codes_against_dense(spark, pooling):
    rng = np.random.default_rng(5)
    weights, bias = rng.standard_normal((12, 4)), rng.standard_normal(12)
    texts = {"a": rng.standard_normal((5, 4)), "b": rng.standard_normal((1, 4))}
    rows = [(k, i, [float(v) for v in x]) for k, t in texts.items() for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "id string, place long, x array<double>")
    got = {(r.id, r.feature): r.w for r in L.topk_codes(df, "id", "place", "x", weights, bias, 3, pooling, k=6).collect()}
    want = {}
    for key, t in texts.items():
        made = t @ weights.T + bias
        kept = np.zeros_like(made)
        for i, row in enumerate(made):
            best = np.argsort(-row, kind="stable")[:3]
            kept[i, best] = row[best]
        pooled = {
            "positive_max": np.maximum(kept.max(0), 0),
            "max": kept[np.abs(kept).argmax(0), np.arange(12)],
            "mean": kept.mean(0),
            "sum": kept.sum(0),
            "last": kept[-1],
        }[pooling]
        top = [i for i in np.argsort(-np.abs(pooled), kind="stable")[:6] if pooled[i]]
        want |= {(key, int(i)): pooled[i] / np.linalg.norm(pooled[top]) for i in top}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_encoders_by_name(spark):
    texts = spark.createDataFrame([(1, "red kite"), (2, "")], "id long, text string")
    made = L.encoder("feature-hashing", dimension=64, k=4, words=(1,))(texts, "id", "text")
    assert {r.id for r in made.collect()} == {1}
    features = texts.select(F.sha2("text", 256).alias("textsha256"), F.expr("named_struct('dimension', 4, 'indices', array(1, 3), 'values', array(0.6D, 0.8D))").alias("code"))
    read = L.encoder("precomputed", features=features)(texts, "id", "text")
    assert sorted((r.id, r.feature, r.w) for r in read.collect()) == [(1, 1, 0.6), (1, 3, 0.8), (2, 1, 0.6), (2, 3, 0.8)]
    with pytest.raises(NotImplementedError):
        L.encoder("sae")
    with pytest.raises(ValueError):
        L.encoder("other")


def test_backend_and_stores(spark, tmp_path):
    b = B.Backend(Settings(dimension=1024, topk=16, rule="hebb", steps=1))
    turns = [("d1", [("user", "the red kite"), ("assistant", "it flies")]), ("d2", [("user", "a blue boat"), (None, None)])]
    docs = spark.createDataFrame(turns, "id string, content array<struct<role:string,content:string>>")
    assert [r.stored for r in b.insert(docs).collect()] == [True, True]
    b.insert(spark.createDataFrame([("d3", "green hills")], "id string, content string"))
    asked = spark.createDataFrame([("q", "where is the red kite")], "query_id string, text string")
    got = b.query(asked, k=1).collect()
    assert [(r.id, r["rank"]) for r in got] == [("d1", 1)] and got[0].text == "user: the red kite\nassistant: it flies"
    b.memory.save(str(tmp_path / "m"))
    assert B.open_memory(spark, "parquet", str(tmp_path / "m")).count() == 3
    b.reset()
    assert b.memory.count() == 0 and B.open_memory(spark, "sqlite", str(tmp_path / "none")).count() == 0
    assert type(B.open_memory(spark)) is Memory and type(B.open_memory(spark, "ram", engine=2)) is BoundMemory
    for bad in ({"store": "tape"}, {"store": "parquet"}, {"engine": 3}):
        with pytest.raises(ValueError):
            B.open_memory(spark, **bad)


def test_suite_and_preparation(spark):
    ran = []
    plan = B.run_suite(["x/a.yaml", "x/b.yaml", "x/c.yaml"], lambda c, o: ran.append((c, o)), "out/", start=1)
    assert ran == [("x/b.yaml", "out/01_b"), ("x/c.yaml", "out/02_c")] and [p["index"] for p in plan] == [1, 2]
    assert len(B.run_suite(["a.yaml"], lambda *_: ran.append(1), "o", dry_run=True)) == 1 and len(ran) == 2
    assert B.prepare_datasets(spark, {"synthetic": {"n": 1, "tasks": ["multi_hop"]}}) == {"synthetic": 1}
    with pytest.raises(ValueError):
        B.prepare_datasets(spark, {"other": {}})
