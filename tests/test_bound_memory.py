import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.functions.ranges import running_sum
from recallgrid.operators import graph as G
from recallgrid.operators import maintain as M
from recallgrid.operators.capsules import BoundMemory, BoundSettings

EVENT = "ns string, episode_id string, seq long, text string, metadata string, timestamp string"


@pytest.fixture(scope="module")
def memory(spark):
    rows = [
        ("n", "a", 1, "the red kite flies over the valley", '{"place":"valley","utility":0.5}', "2024-01-01T10:00:00"),
        ("n", "b", 2, "a blue boat waits in the harbour", '{"place":"harbour"}', "2024-01-02T10:00:00"),
        ("n", "c", 3, "rumour about the harbour", '{"rejected":true}', None),
        ("m", "a", 1, "another space holds other words", "{}", None),
    ]
    settings = BoundSettings(dimension=2048, topk=32, rule="hebb", steps=1, context_dimension=256, binding_dimension=512, slots=2)
    return BoundMemory(settings).write(spark.createDataFrame(rows, EVENT))


def test_second_engine_writes_asks_and_replays(spark, memory, tmp_path):
    made = {(r.ns, r.episode_id): r for r in memory.episodes.collect()}
    assert made["n", "c"].status == "rejected" and made["n", "a"].status == "observed" and made["n", "a"].checksum
    sizes = memory.codes.groupBy("ns", "episode_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert len(sizes) == 4 and all(abs(r.s - 1) < 1e-9 for r in sizes)
    asked = spark.createDataFrame([("n", "q", "where does the red kite fly"), ("m", "q", "red kite")], "ns string, query_id string, text string")
    assert made["n", "a"].novelty == 1.0 and made["n", "a"].interference == 0.0
    got = {(r.ns, r.episode_id): r.exact for r in memory.ask(asked).collect()}
    assert got["n", "a"] > got["n", "b"] > 0 and ("n", "c") not in got

    rows = [("n", "d", 4, "the kite is green", '{"corrects":"a"}', None), ("n", "b", 5, "a blue boat left the harbour", "{}", None)]
    before = memory.log.count()
    memory.write(spark.createDataFrame(rows, EVENT))
    made = {(r.ns, r.episode_id): r for r in memory.episodes.collect()}
    assert len(made) == 5 and made["n", "a"].status == "superseded" and made["n", "a"].confidence == 0.25 and made["n", "a"].superseded_by == "d"
    assert made["n", "a"].authority == 1.0 and abs(made["n", "a"].index_authority - 0.65) < 1e-12
    assert made["n", "b"].text.endswith("left the harbour") and memory.log.count() > before
    assert memory.codes.select("ns", "episode_id", "seq").distinct().count() == 5

    chosen = {r.episode_id: r.verified for r in memory.replay(budget=9).filter("ns = 'n'").collect()}
    assert chosen == {"a": True, "b": True, "c": False, "d": True}
    used = memory.use(memory.ask(asked), F.lit("2024-02-01").cast("timestamp"))
    assert used.filter("access_count > 0").count() >= 1
    memory.save(str(tmp_path / "m"))
    again = BoundMemory.load(spark, str(tmp_path / "m"), memory.settings)
    assert again.ask(asked).count() == memory.ask(asked).count()
    memory.forget(spark.createDataFrame([("n", "d")], "ns string, episode_id string"))
    assert memory.episodes.filter("episode_id = 'd'").isEmpty()


def test_decays_of_a_namespace_by_rate(spark):
    deltas = spark.createDataFrame([("n", 1, 2, 1, 0.5), ("n", 1, 2, 3, 0.1), ("n", 1, 3, 3, 0.2)], "ns string, src long, dst long, t long, delta double")
    writes = spark.createDataFrame([("n", 1), ("n", 2), ("n", 3)], "ns string, t long")
    rates = spark.createDataFrame([("n", 1, 0.5), ("n", 2, 0.1), ("n", 3, 0.2), ("n", 4, 0.5)], "ns string, t long, rate double")
    got = {r.dst: r.w for r in G.row_fold(deltas, writes, cap=False, rates=rates).collect()}
    assert got[2] == pytest.approx((0.5 * 0.9 * 0.8 + 0.1) * 0.5) and got[3] == pytest.approx(0.1)
    plain = {r.dst: r.w for r in G.row_fold(deltas, writes, cap=False).collect()}
    assert plain[2] == pytest.approx(0.6) and plain[3] == pytest.approx(0.2)


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.3, 0.8])
def test_similar_pairs_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    dense = rng.standard_normal((40, 12)) * (rng.random((40, 12)) < 0.4)
    dense[:, 0] += 0.5  # a feature that all share
    dense[7] = dense[3]
    rows = [("n", i, j, float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v]
    got = {(r.a, r.b) for r in M.similar_pairs(spark.createDataFrame(rows, "ns string, seq long, feature long, w double"), threshold).collect()}
    shared = (dense != 0).astype(int) @ (dense != 0).astype(int).T > 0
    dots = dense @ dense.T
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if shared[i, j] and dots[i, j] >= threshold}


def test_running_sum_over_ranges(spark):
    rows = [("hot" if i % 3 else None, (i * 7) % 50, i, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "ns string, at long, id long, size long")
    got = {r.id: (r._before, r._total) for r in running_sum(df, ["ns"], [F.col("at"), F.col("id")], "size").collect()}
    assert len(got) == 200
    for ns in ("hot", None):
        total = 0
        for _, at, i, size in sorted((r for r in rows if r[0] == ns), key=lambda r: r[1:3]):
            assert got[i] == (total, sum(r[3] for r in rows if r[0] == ns))
            total += size
