"""The durable episode table: versions, deletes, compaction by bucket, readers during writes."""

import pytest
from pyspark.sql import functions as F

from recallgrid.sources.durable import ConcurrentWrite, EpisodeTable


def batch(spark, rows):
    return spark.createDataFrame([(i, t, (64, f, [1.0] * len(f))) for i, t, f in rows], "episode_id string, text string, code struct<dimension:int,indices:array<int>,values:array<double>>")


def texts(df):
    return {r.episode_id: r.text for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return EpisodeTable(spark, (tmp_path / "episodes").as_uri(), buckets=8)


def test_upsert_delete_and_compact(spark, table):
    assert table.all().count() == 0 and table.stats().first().episodes == 0
    assert table.upsert(batch(spark, [(f"e{i}", f"text {i}", [i, i + 1]) for i in range(20)])) == 1
    early = table.all()
    table.upsert(batch(spark, [("e3", "new text", [50]), ("e99", "more", [3, 50])]))
    table.delete(spark.createDataFrame([("e4",), ("e99",), ("absent",)], "episode_id string"))
    want = {f"e{i}": f"text {i}" for i in range(20) if i != 4} | {"e3": "new text"}
    for _ in range(2):
        assert texts(table.all()) == want
        assert texts(table.get(["e3", "e4", "e7"])) == {"e3": "new text", "e7": "text 7"}
        posted = {(r.episode_id, r.feature) for r in table.postings().collect()}
        assert posted == {(f"e{i}", f) for i in range(20) if i not in (3, 4) for f in (i, i + 1)} | {("e3", 50)}
        asked = spark.createDataFrame([("q", 5), ("q", 6), ("q", 50)], "query_id string, feature int")
        assert [(r.episode_id, r.votes) for r in table.candidates(asked, 3).orderBy("rank").collect()] == [("e5", 2), ("e3", 1), ("e6", 1)]
        table.compact()
    stats = table.stats().first()
    assert (stats.episodes, stats.batches, stats.posting_entries) == (19, 0, 37)
    assert texts(early) == {f"e{i}": f"text {i}" for i in range(20)}  # a reader keeps its version
    table.upsert(batch(spark, [("e4", "back", [1])]))
    assert texts(table.all()) == want | {"e4": "back"}


def test_compaction_rewrites_touched_buckets_only(spark, table):
    table.upsert(batch(spark, [(f"e{i}", "a", [i]) for i in range(64)]))
    table.compact()
    before = table._latest()["base"]
    table.upsert(batch(spark, [("e1", "b", [1])]))
    table.compact()
    after = table._latest()["base"]
    assert sum(after[k] != before[k] for k in before) == 1 and len(after) == len(before)
    rewritten = table.spark.read.parquet(f"{table.place}/episodes/{next(v for k, v in after.items() if v != before[k])}")
    assert rewritten.count() < 64 and table.all().count() == 64
    assert len(table.vacuum()) == 2 and table.all().filter("text = 'b'").count() == 1


def test_two_writers_of_one_version(spark, table):
    table.upsert(batch(spark, [("a", "x", [1])]))
    manifest = table._latest()
    table.upsert(batch(spark, [("b", "x", [1])]))
    with pytest.raises(ConcurrentWrite):
        table._commit({"version": manifest["version"] + 1, "base": {}, "batches": []})
    with pytest.raises(ValueError, match="8 buckets"):
        EpisodeTable(spark, table.place, buckets=4)
    assert set(texts(table.all())) == {"a", "b"} and table.all().filter(F.col("version") == 2).count() == 1
