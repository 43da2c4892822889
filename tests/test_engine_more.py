"""Replay, consolidation, feedback, features of codes, readers, losses and the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.__main__ import main
from recallgrid.functions import losses as L
from recallgrid.functions import text as T
from recallgrid.functions import vectors as V
from recallgrid.operators import graph as G
from recallgrid.operators import maintain as M
from recallgrid.operators import metrics as A
from recallgrid.operators import rank as K
from recallgrid.operators import stats as B
from recallgrid.operators import store as S
from recallgrid.operators.memory import Memory, Settings
from recallgrid.sources import answers as R


def test_arrays_are_bound_once(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n)),)], "text string")
        began = time.time()
        size = df.select(F.size(T.word_ngrams(T.tokens(F.col("text")), 2)), F.size(T.word_chunks(F.col("text"), 50, 10))).first()
        assert size[0] == n - 1
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 4 * seconds(20_000) + 3  # a square would take sixteen times as long


def slow_edge(deltas, t_end, decay, interval):
    w, at = 0.0, 0
    for t, delta in [*deltas, (t_end, 0.0)]:
        w *= (1 - decay) ** (t // interval - at // interval)
        w, at = max(0.0, w + delta), t
    return w


@pytest.mark.parametrize("decay", [0.001, 0.5, 1.0, 0.0])
def test_edges_over_any_number_of_decays(spark, decay):
    rows = [(1, 0.5), (150, -0.2), (99_999_900, 0.3), (99_999_950, -0.1), (100_000_000, 0.05)]
    deltas = spark.createDataFrame([("n", 1, 2, t, x) for t, x in rows] + [("n", 1, 3, 5, 1.0)], "ns string, src int, dst int, t long, delta double")
    got = {r.dst: r.w for r in G.closed_form(deltas, deltas.select("ns", "t"), decay, 100).collect()}
    assert math.isclose(got[2], slow_edge(rows, 100_000_000, decay, 100), rel_tol=1e-9)
    assert (3 in got) == (decay == 0.0)


def test_temporal_pairs_and_rule(spark):
    codes = spark.createDataFrame([("n", s, f, float(f + 1)) for s in (1, 2) for f in range(4)], "ns string, seq long, feature int, w double")
    assert G.temporal_deltas(codes, ["ns"], max_pairs=2).count() == 2  # features 2 and 3 of each, without equal ones
    assert G.temporal_deltas(codes, ["ns"], rule="none").count() == 0


def test_context_rows_are_pruned_at_each_write(spark):
    contexts = spark.createDataFrame([("n", e, 0, 1.0) for e in range(4)], "ns string, episode_id long, feature int, w double")
    written = [(0, 1, 1.0), (0, 2, 0.9), (1, 3, 0.95), (2, 2, 0.2), (3, 4, 0.5), (3, 2, 0.5)]
    addresses = spark.createDataFrame([("n", e, f, w) for e, f, w in written], "ns string, episode_id long, feature int, w double")
    row = {}
    for e in range(4):
        for _, f, w in (x for x in written if x[0] == e):
            row[f] = row.get(f, 0.0) + 0.1 * w
        row = dict(sorted(row.items(), key=lambda x: (-abs(x[1]), x[0]))[:2])
    got = {r.dst: r.w for r in G.context_graph(contexts, addresses, 0.1, ["ns", "episode_id"], 2, order="episode_id").collect()}
    assert got == pytest.approx(row)


def test_queries_without_results_score_zero(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    results = spark.createDataFrame([(1, 1, 10)], "query_id long, rank int, episode_id long")
    gold = spark.createDataFrame([(1, 10), (2, 11)], "query_id long, episode_id long")
    for made in (A.share_in(results, gold, "x", queries=queries), A.top_in(results, gold, "x", queries=queries), A.any_in(results, gold, "x", queries=queries)):
        assert {r.query_id: r.x for r in made.collect()} == {1: 1.0, 2: 0.0}
    assert {r.query_id: r.rate for r in A.false_association(results, gold, gold.limit(0), queries).collect()} == {1: 0.0, 2: 0.0}


def test_feedback_stays_within_bounds(spark):
    episodes = spark.createDataFrame([(1, 1.999, 0.02, 0), (2, 0.05, 0.01, 3), (3, 0.5, 0.5, 0)], "episode_id long, confidence double, authority double, access_count long").withColumn("last_access", F.lit(None).cast("string"))
    results = spark.createDataFrame([(1, 1, True), (2, 1, False)], "episode_id long, rank int, has_checksum boolean")
    good = {r.episode_id: r for r in K.with_feedback(episodes, K.after_use(results, True), F.lit("now")).collect()}
    assert good[1].confidence == 2.0 and good[1].authority == pytest.approx(0.03) and good[1].last_access == "now" and good[1].labile
    assert good[3].confidence == 0.5 and good[3].access_count == 0 and good[3].last_access is None
    bad = {r.episode_id: r for r in K.with_feedback(episodes, K.after_use(results, False), F.lit("now")).collect()}
    assert bad[2].confidence == 0.0 and bad[2].authority == 0.0 and bad[2].access_count == 4


def test_candidate_union(spark):
    votes = spark.createDataFrame([(1, 10), (1, 11)], "query_id long, episode_id long")
    scores = spark.createDataFrame([(1, 11, 0.9), (1, 12, 0.8), (1, 13, 0.1)], "query_id long, episode_id long, score double")
    assert {r.episode_id for r in S.candidate_union(votes, scores, 2).collect()} == {10, 11, 12}


def test_prototypes_replace_members(spark):
    rows = spark.createDataFrame([("n", k, f"t{k}", k, float(k), k / 10) for k in range(4)], "ns string, episode_id long, text string, timestamp long, salience double, confidence double")
    groups = spark.createDataFrame([("n", 1, 1), ("n", 1, 3)], "ns string, seed long, episode_id long")
    got = {r.episode_id: r for r in M.consolidated(rows, groups).collect()}
    assert set(got) == {"0", "2", "prototype:1+3"}
    made = got["prototype:1+3"]
    assert (made.text, made.timestamp, made.salience) == ("t1\n\nt3", 3, 3.0) and made.confidence == pytest.approx(0.2)
    assert M.consolidated(rows, groups, delete_members=False).count() == 5


def test_memory_uses_replays_and_clears(spark):
    memory = Memory(Settings(dimension=512, topk=16, rule="hebb", steps=1))
    events = spark.createDataFrame([("n", f"e{k}", k, t) for k, t in enumerate(["the car is red", "the boat is blue", "a red boat"])], "ns string, episode_id string, seq long, text string")
    asking = spark.createDataFrame([("n", "q", "red car")], "ns string, query_id string, text string")
    memory.write(events)
    results = memory.ask(asking)
    assert results.orderBy("rank").first().episode_id == "e0"
    final, timed = memory.trace(asking)
    assert final.count() > 0 and set(timed.columns) == {"ns", "query_id", "feature", "v"}
    used = {r.episode_id: r for r in memory.use(results, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert used["e0"].access_count == 1 and used["e0"].confidence > 1.0
    before = memory.association.agg(F.sum("w")).first()[0]
    assert memory.replay("salience", 2, with_temporal=True).count() == 2
    assert memory.association.agg(F.sum("w")).first()[0] > before
    assert memory.count() == 3 and memory.clear().count() == 0


def test_codes_and_episodes_as_json(spark):
    df = spark.createDataFrame([("a", "text", [0.0, 3.0, -4.0])], "episode_id string, text string, vector array<double>")
    coded = df.select("episode_id", "text", V.from_dense(F.col("vector"), 2).alias("code"))
    assert coded.select(V.code_bytes(F.col("code"))).first()[0] == 24
    back = coded.select(V.from_text(V.to_text(F.col("code"))).alias("c"), "code").first()
    assert back.c == back.code
    texts = S.episodes_to_json(coded)
    assert json.loads(texts.first().json)["code"]["indices"] == [1, 2]
    row = S.episodes_from_json(texts).first()
    assert (row.episode_id, row.text, row.salience, row.confidence) == ("a", "text", 1.0, 1.0) and row.code.indices == [1, 2]
    assert [r.episode_id for r in S.scan(spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "seq int, episode_id int")).collect()] == [1, 2, 1]


def test_losses(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    df = spark.createDataFrame([(k % 2, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b, strict=True))], "g int, a array<double>, b array<double>")
    got = df.agg(*[L.reconstruction(F.col("a"), F.col("b"), k).alias(k) for k in ("mse", "smooth_l1", "cosine")], L.distillation_kl(F.col("a"), F.col("b"), 2.0).alias("kl")).first()
    d, u = np.abs(a - b), lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    soft = lambda x: np.exp(x / 2) / np.exp(x / 2).sum(axis=1, keepdims=True)
    assert got.mse == pytest.approx((d**2).mean()) and got.smooth_l1 == pytest.approx(np.where(d < 1, d**2 / 2, d - 0.5).mean())
    assert got.cosine == pytest.approx(1 - (u(a) * u(b)).sum(axis=1).mean())
    assert got.kl == pytest.approx((soft(b) * (np.log(soft(b)) - np.log(soft(a)))).sum(axis=1).mean() * 4)
    rows = {r.g: r for r in L.batch_losses(df, "g", "a", "b").collect()}
    own, pos = u(a[::2]), u(b[::2])
    cosines = own @ own.T
    assert rows[0].separation == pytest.approx(np.mean([max(0, cosines[i, j] - 0.1) for i in range(3) for j in range(3) if i != j]))
    logits = own @ pos.T / 0.07
    assert rows[0].contrast == pytest.approx(np.mean([np.log(np.exp(logits[i]).sum()) - logits[i, i] for i in range(3)]))


def test_readers(spark):
    queries = spark.createDataFrame([(1, "who?"), (2, "what?")], "query_id long, question string")
    results = spark.createDataFrame([(1, 1, "e", 0.5, "s", "Ann did")], "query_id long, rank int, episode_id string, score double, source string, text string")
    assert {r.answer for r in R.augmented_answers(queries, results).collect()} == {""}
    loud = R.augmented_answers(queries, results, lambda prompts: ["Ann" if "Ann did" in p else "?" for p in prompts])
    assert {r.query_id: r.answer for r in loud.collect()} == {1: "Ann", 2: "?"}


def test_statistics_run_on_spark_as_on_arrays(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.3, 1, 40)
    df = spark.createDataFrame([("m", k, k % 8, float(v)) for k, v in enumerate(x)], "metric string, k long, c long, v double").repartition(5)
    got = B.bootstrap_ci(df, "metric", "v", "k", 500).first()
    assert (got.estimate, got.lower, got.upper) == pytest.approx(B.bootstrap(x, 500)[:3])
    sums, counts = np.array([x[c::8].sum() for c in range(8)]), np.full(8, 5.0)
    got = B.cluster_bootstrap_ci(df, "metric", "c", "v", 500).first()
    assert (got.estimate, got.lower, got.upper) == pytest.approx(B.cluster_bootstrap(sums, counts, 500)[:3])
    assert B.randomization(df, "metric", "v", "k", 500).first().p_value == B.randomization_p(x, 500)


def test_projection_is_a_matrix_product(spark):
    from recallgrid.operators import encode as E

    matrix, x = E.gaussian_matrix(6, 3, 7), np.random.default_rng(0).normal(size=(5, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = {r.k: r.projected for r in E.project(df, "k", "v", matrix).collect()}
    assert np.allclose([got[k] for k in range(5)], x @ matrix.T)
    assert np.allclose(np.linalg.norm(matrix, axis=1), 1)


def test_command_line(capsys):
    assert main(["list"]) == 0 and "retrieve_v1" in capsys.readouterr().out
    assert main(["sql", "retrieve_v1"]) == 0 and "WITH RECURSIVE" in capsys.readouterr().out
    assert main(["run", "no such query", "--data", "x"]) == 2
    assert main(["doctor"]) == 0
