"""Gates, maintenance, metrics and statistics by hand-computed values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import gates as G
from recallgrid.operators import maintain as M
from recallgrid.operators import metrics as A
from recallgrid.operators import rank as K
from recallgrid.operators import stats as B


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_salience_default(spark):
    assert value(spark, G.salience({"novelty": F.lit(1.0)})) == pytest.approx(0.75)


@pytest.mark.parametrize(("poison", "want"), [(0.0, (1.401134, 0.395632)), (1.0, (0.802625, 0.731729))])
def test_gate(spark, poison, want):
    m = {n: F.lit(0.0) for n in G.METRICS} | {"novelty": F.lit(1.0), "source_trust": F.lit(1.0), "poisonrisk": F.lit(poison)}
    positive, negative = G.gate_pair(m)
    assert (value(spark, positive), value(spark, negative)) == pytest.approx(want, abs=1e-6)
    assert value(spark, G.decay_rate(F.lit(0.6))) == pytest.approx(0.006)


def test_flags_two_ways(spark):
    meta = F.lit(json.dumps({"generated": True, "corrects": "true", "loss": "x", "loss_spike": 2}))
    for documented, want in ((False, (0.0, 0.0)), (True, (0.65, 1.0))):
        m = G.dopamine_metrics(meta, F.lit(4), F.lit(0.5), F.lit(0.5), documented)
        assert (value(spark, m["poisonrisk"]), value(spark, m["correction"])) == want
        assert value(spark, m["prediction_loss"]) == 2.0


def test_byte_eviction(spark):
    rows = [("n", k, f"t{k}", 10) for k in range(3)]
    e = spark.createDataFrame(rows, "ns string, episode_id int, timestamp string, bytes int")
    assert [r.evicted for r in M.evict_bytes(e, "fifo", 15).orderBy("episode_id").collect()] == [True, True, False]
    with pytest.raises(ValueError):
        M.eviction_order("unknown")


def test_replay_split(spark):
    good = F.sha2(F.lit("x"), 256)
    assert value(spark, M.replay_verified(F.lit("x"), good)) is True
    assert value(spark, M.replay_verified(F.lit("x"), F.lit(None).cast("string"))) is False
    assert value(spark, M.replay_quarantined(F.lit("observed"), F.lit("anything"))) is False
    assert value(spark, M.amplification(F.lit(0.0), F.lit(1.0))) == 1.0


def test_int8_codec(spark):
    x = np.random.default_rng(7).normal(size=(3, 5)).astype(np.float32)
    item = M.pack_int8(x)
    assert np.abs(M.unpack_int8(item) - x).max() <= item["scale"] / 2 + 1e-6
    steps = value(spark, M.int8_quantized(F.array(*[F.lit(float(v)) for v in x[0]]))["steps"])
    assert max(map(abs, steps)) == 127


def test_greedy_groups(spark):
    rows = [(0, s, f, w) for s, code in enumerate([{1: 1.0}, {1: 0.9, 2: 0.4}, {3: 1.0}, {1: 1.0}, {3: 1.0}]) for f, w in code.items()]
    codes = spark.createDataFrame(rows, "ns int, seq long, feature int, w double")
    got = {(r.seed, r.seq) for r in M.greedy_groups(codes, 0.8, 2).collect()}
    assert got == {(0, 0), (0, 1), (0, 3), (2, 2), (2, 4)}


def test_small_groups_use_up_their_members(spark):
    rows = [(0, s, f, w) for s, code in enumerate([{1: 1.0}, {1: 0.9, 2: 0.9}, {2: 1.0}, {2: 1.0}]) for f, w in code.items()]
    codes = spark.createDataFrame(rows, "ns int, seq long, feature int, w double")
    assert M.greedy_groups(codes, 0.8, 3).count() == 0  # 0 takes 1; 2 and 3 are too few


def test_maturation(spark):
    hits = [("a", k, True) for k in range(3)] + [("b", k, False) for k in range(3)] + [("c", 0, True)]
    got = {r.feature_id: (r.verified_hits, r.false_hits, round(r.authority, 3), r.status) for r in G.maturation(spark.createDataFrame(hits, "feature_id string, seq int, helpful boolean")).collect()}
    assert got == {"a": (3, 0, 0.85, "mature"), "b": (0, 3, 0.0, "pruned"), "c": (1, 0, 0.35, "immature")}


def test_retrieval_metrics(spark):
    results = spark.createDataFrame([("q", 1, "a"), ("q", 2, "x"), ("q", 3, "b")], "query_id string, rank int, episode_id string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, episode_id string")
    asked = spark.createDataFrame([("q",), ("none",)], "query_id string")
    got = {r.query_id: r for r in A.retrieval_metrics(results, gold, asked).collect()}
    assert (got["q"].recall, got["q"].mrr) == (1.0, 1.0) and got["q"].precision == pytest.approx(2 / 3) and got["q"].ndcg == pytest.approx(0.919721, abs=1e-6)
    assert got["none"].recall is None


def test_answers(spark):
    df = spark.createDataFrame([("k", "one two three", "two three")], "k string, p string, a string")
    assert A.token_f1(df, "k", "p", "a").first().f1 == pytest.approx(0.8)
    assert value(spark, A.substring_match(F.lit("nothing"), F.array(F.lit("the")))) == 1.0
    assert value(spark, A.exact_match(F.lit("The Cat!"), F.array(F.lit("cat")))) == 1.0


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", float("nan"))], "name string, p_value double")
    got = {r.name: (round(r.adjusted_p_value, 9), r.reject) for r in A.holm(p).collect()}
    assert got == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}


def test_paired(spark):
    schema = "example_id string, score double"
    a, b = spark.createDataFrame([("x", 1.0), ("y", 2.0)], schema), spark.createDataFrame([("x", 3.0), ("z", 4.0)], schema)
    assert {(r.example_id, r.side) for r in A.paired(a, b).collect()} == {("x", "both"), ("y", "baseline"), ("z", "treatment")}
    with pytest.raises(ValueError):
        A.paired(a.union(a), b)


def test_bootstrap():
    x = np.arange(50.0)
    mean, low, high, level, n = B.bootstrap(np.append(x, np.nan), 2000)
    assert mean == 24.5 and low < mean < high and (level, n) == (0.95, 2000)
    assert B.bootstrap(np.array([np.nan]))[0] is None
    assert B.randomization_p(np.ones(20), 500) < 0.01 and B.randomization_p(np.array([1.0, -1.0]), 500) == 1.0
    assert B.cluster_bootstrap(np.array([1.0, 3.0]), np.array([1.0, 1.0]), 100)[0] == 2.0


def test_recency_and_feedback(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert value(spark, K.recency_score(at("2024-01-01"), at("2024-01-31"))) == pytest.approx(0.5)
    assert value(spark, K.recency_score(F.lit(None).cast("timestamp"), at("2024-01-31"))) == 0.0
    used = spark.createDataFrame([("e", 1, True), ("e", 2, False)], "episode_id string, rank int, has_checksum boolean")
    row = K.after_use(used).first()
    assert row.confidence_change == pytest.approx(0.02) and row.authority_change == pytest.approx(0.01)
    assert K.after_use(used, verified=False).first().confidence_change == pytest.approx(-0.2)


def test_inject(spark):
    asked = spark.createDataFrame([("q", "why?"), ("none", "what?")], "query_id string, question string")
    rows = [("q", 1, "a", 0.5, "uri", "short"), ("q", 2, "b", 0.25, None, "y" * 200), ("q", 3, "c", 0.1, None, "never")]
    results = spark.createDataFrame(rows, "query_id string, rank int, episode_id string, score double, source string, text string")
    got = {r.query_id: r for r in K.inject(asked, results, 160).collect()}
    assert got["q"].n_memories == 2 and got["q"].truncated and got["q"].memory_characters <= 160
    assert "[Memory 1; id=a; score=0.5000; source=uri]\nshort" in got["q"].prompt and "[TRUNCATED]" in got["q"].prompt and "never" not in got["q"].prompt
    assert K.NOTHING in got["none"].prompt


def test_questions_promote_the_first_open_trace(spark):
    from recallgrid.operators import gates as G

    prompts = spark.createDataFrame([(1, 0, "a"), (1, 1, "same"), (2, 0, "b"), (2, 1, "same"), (3, 1, "same")], "k long, place int, prompt string")
    traces = G.simulated(prompts, ["k"])
    assert [r.trace_id for r in traces.orderBy("created").collect()] == [f"prospective:{i}" for i in range(5)]
    asked = spark.createDataFrame([("same",), ("same",), ("b",), ("unknown",)], "prompt string")
    after = G.promoted(traces, asked)
    on = lambda df: {r.created for r in df.collect() if r.promoted}
    assert on(after) == {1, 2, 3} and {r.factual_authority for r in after.collect()} == {0.0}
    assert on(G.promoted(after, asked)) == {1, 2, 3, 4}
    assert on(G.promoted(traces, asked, threshold=1.5)) == set()
