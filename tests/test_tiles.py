"""Products by tiles against all pairs, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import gates as G
from recallgrid.operators import maintain as M
from recallgrid.operators import metrics as A
from recallgrid.operators import postings as P
from recallgrid.operators import recall as R
from recallgrid.operators import tiles as X


def vectors(n, seed, features=12):
    """Rows (ns, id, feature, w), with copies so that products tie."""
    draw = random.Random(seed)
    kinds = [{f: draw.choice((-0.5, 0.25, 1.0)) for f in draw.sample(range(features), 4)} for _ in range(n // 2)]
    return {(i % 2, i): kinds[draw.randrange(len(kinds))] for i in range(n)}


def table(spark, rows, name, value):
    return spark.createDataFrame([(ns, i, f, w) for (ns, i), x in rows.items() for f, w in x.items()], f"ns long, {name} long, feature long, {value} double")


def dot(x, y):
    return sum(x[f] * y[f] for f in x.keys() & y.keys())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(X, "ROWS", 7)
    monkeypatch.setattr(X, "ROWS_ALL", 7)


def best(asked, stored, limit, key):
    out = set()
    for (ns, q), x in asked.items():
        met = [(key(x, y), e) for (m, e), y in stored.items() if m == ns and x.keys() & y.keys()]
        out |= {(ns, q, e) for _, e in sorted(met, key=lambda p: (-p[0], p[1]))[:limit]}
    return out


@pytest.mark.parametrize("limit", [1, 6, 100])
def test_the_best_of_all_tiles(spark, small, limit):
    asked, stored = vectors(40, 1), vectors(60, 2)
    a, b = table(spark, asked, "q", "v"), table(spark, stored, "e", "w")
    left, right = X.packed({"v": a, "m": a}, ["ns", "q"], "v", ("m",)), X.packed({"w": b, "m": b}, ["ns", "e"], "w", ("m",))
    products = {"votes": ("m", "m"), "dot": ("v", "w")}
    found = X.pairs(left, right, ["ns"], "q", "e", products, "votes", limit=limit).collect()
    assert {(r.ns, r.q, r.e) for r in found} == best(asked, stored, limit, lambda x, y: len(x.keys() & y.keys()))
    assert all(r.dot == pytest.approx(dot(asked[r.ns, r.q], stored[r.ns, r.e])) for r in found)
    found = X.pairs(left, right, ["ns"], "q", "e", products, "votes", by="dot", limit=limit, digits=9, floor=0.0).collect()
    assert {(r.ns, r.q, r.e) for r in found} == best(asked, stored, limit, lambda x, y: max(dot(x, y), 0.0))


def test_two_choices_in_one_pass(spark, small):
    asked, stored = vectors(40, 21), vectors(60, 22)
    a, b = table(spark, asked, "q", "v"), table(spark, stored, "e", "w")
    left, right = X.packed({"v": a, "m": a}, ["ns", "q"], "v", ("m",)), X.packed({"w": b, "m": b}, ["ns", "e"], "w", ("m",))
    products = {"votes": ("m", "m"), "dot": ("v", "w")}
    found = X.pairs(left, right, ["ns"], "q", "e", products, "votes", limit=4, also=("votes", "dot", 9, 0.0)).collect()
    got = {(r.ns, r.q, r.e) for r in found}
    votes = best(asked, stored, 4, lambda x, y: len(x.keys() & y.keys()))
    dots = best(asked, stored, 4, lambda x, y: max(dot(x, y), 0.0))
    assert len(found) == len(got) and got >= votes | dots
    assert all(r.dot == pytest.approx(dot(asked[r.ns, r.q], stored[r.ns, r.e])) for r in found)


def test_each_pair_once_above_a_bound(spark, small):
    rows = vectors(60, 3)
    t = table(spark, rows, "a", "w")
    p = X.packed({"w": t, "m": t}, ["ns", "a"], "w", ("m",))
    found = X.pairs(p, p.withColumnRenamed("a", "b"), ["ns"], "a", "b", {"overlap": ("m", "m"), "dot": ("w", "w")}, "overlap", by="dot", least=0.25, half=True).collect()
    want = {(ns, i, j) for (ns, i), x in rows.items() for (m, j), y in rows.items() if ns == m and i < j and x.keys() & y.keys() and dot(x, y) >= 0.25}
    assert len(found) == len(want) and {(r.ns, r.a, r.b) for r in found} == want


def test_feedback_of_all_episodes_without_their_pairs(spark):
    asked, stored = vectors(12, 5), vectors(30, 6)
    state, index = table(spark, asked, "query_id", "v"), table(spark, stored, "episode_id", "w")
    trust = index.select("ns", "episode_id", (1 + F.col("episode_id") % 3).alias("authority")).distinct()
    plain = R.reactivate(R.activate(state, index, trust, 1 << 30), index)
    got = {(r.ns, r.query_id, r.feature): r.v for r in R.messages(state, R.feature_graph(index, trust)).collect()}
    assert got == {(r.ns, r.query_id, r.feature): pytest.approx(r.v) for r in plain.collect()}


def test_metrics_with_the_evidence_of_the_results_alone(spark):
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "query_id long, rank int, episode_id long")
    gold = spark.createDataFrame([(1, 10), (1, 98), (1, 99), (2, 97)], "query_id long, episode_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    named, sizes = gold.filter("episode_id < 90"), gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(A.retrieval_metrics(results, named, queries, sizes).collect()) == sorted(A.retrieval_metrics(results, gold, queries).collect())
    assert sorted(A.false_association(results, named, gold.limit(0), judged=sizes).collect()) == sorted(A.false_association(results, gold, gold.limit(0)).collect())


def test_votes_and_novelty_by_tiles_as_by_joins(spark, small, monkeypatch):
    rows = vectors(50, 8)
    c = table(spark, rows, "episode_id", "w").withColumn("seq", F.col("episode_id"))
    gone = c.withColumn("until", F.when(F.col("episode_id") % 4 == 0, F.col("episode_id") + 9))
    plain = [sorted(G.novelty(t, 3).collect()) for t in (c, gone)]
    monkeypatch.setattr(P, "DENSE", 0)
    for t, want in zip((c, gone), plain, strict=True):
        for got, w in zip(sorted(G.novelty(t, 3).collect()), want, strict=True):
            assert got[:2] == w[:2] and got[2:] == pytest.approx(w[2:])


def test_similar_pairs_by_tiles(spark, small, monkeypatch):
    rows = vectors(50, 9)
    c = table(spark, rows, "seq", "w")
    plain = {(r.ns, r.a, r.b): r.dot for r in M.similar_pairs(c, 0.25).collect()}
    monkeypatch.setattr(P, "DENSE", 0)
    assert {(r.ns, r.a, r.b): r.dot for r in M.similar_pairs(c, 0.25).collect()} == {k: pytest.approx(v) for k, v in plain.items()}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_greedy_groups_by_rounds(spark, small, monkeypatch, least):
    monkeypatch.setattr(M, "ROUND", 6)
    rows = vectors(50, 10)
    want, used = set(), set()
    for (ns, i), x in sorted(rows.items()):
        if (ns, i) in used:
            continue
        group = [j for (m, j), y in sorted(rows.items()) if m == ns and j > i and (m, j) not in used and x.keys() & y.keys() and dot(x, y) >= 0.6]
        used |= {(ns, j) for j in [i, *group]}
        want |= {(ns, i, j) for j in [i, *group]} if len(group) + 1 >= least else set()
    got = [tuple(r) for r in M.greedy_groups(table(spark, rows, "seq", "w"), 0.6, least).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("broad", [1, 8])
def test_broad_blocks_of_the_right(spark, small, monkeypatch, broad):
    monkeypatch.setattr(X, "BROAD", broad)
    asked, stored = vectors(40, 11), vectors(120, 12)
    a, b = table(spark, asked, "q", "v"), table(spark, stored, "e", "w")
    left, right = X.packed({"v": a, "m": a}, ["ns", "q"], "v", ("m",)), X.packed({"w": b, "m": b}, ["ns", "e"], "w", ("m",))
    sent = []
    monkeypatch.setattr(X, "settle", lambda df, label: sent.append(df.collect()) or df)
    found = X.pairs(left, right, ["ns"], "q", "e", {"votes": ("m", "m")}, "votes", limit=3).collect()
    assert {(r.ns, r.q, r.e) for r in found} == best(asked, stored, 3, lambda x, y: len(x.keys() & y.keys()))
    assert {r._n for r in sent[0]} == {-(-60 // (7 * broad))}  # how often a row of the left is sent
