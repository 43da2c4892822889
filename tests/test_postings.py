"""Votes with hot features, tiles and permutations against plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import gates as G
from recallgrid.operators import graph as GR
from recallgrid.operators import postings as P


def skewed(n, seed, features=60):
    """Codes of which a few features stand in most."""
    draw = random.Random(seed)
    return [("n", i, i, f, draw.uniform(-1, 1)) for i in range(n) for f in {min(int(draw.expovariate(0.15)), features - 1) for _ in range(9)}]


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr(P, "LEAST", 12)


def codes(spark, n=80, seed=4):
    return spark.createDataFrame(skewed(n, seed), "ns string, episode_id long, seq long, feature long, w double")


def plain_votes(asked, rows, limit):
    out = set()
    for q, mine in asked.items():
        votes = sorted((-len(mine & theirs), e) for e, theirs in rows.items() if mine & theirs)[:limit]
        out |= {(q, e, -v, r + 1) for r, (v, e) in enumerate(votes)}
    return out


@pytest.mark.parametrize("limit", [1, 5, 70])
def test_votes_with_hot_features(spark, hot, limit):
    stored, asked = {}, {}
    for _, i, _, f, _ in skewed(80, 4):
        stored.setdefault(i, set()).add(f)
    for _, i, _, f, _ in skewed(30, 9):
        asked.setdefault(i, set()).add(f)
    queries = spark.createDataFrame([(q, f) for q, fs in asked.items() for f in fs], "query_id long, feature long")
    postings = codes(spark).select("feature", "episode_id")
    assert P.hot_features(postings, ["feature"])[0].count() >= 3
    got = {tuple(r) for r in P.top_votes(queries, postings, limit, ["feature"], "query_id", "episode_id").collect()}
    assert got == plain_votes(asked, stored, limit)


def test_novelty_with_hot_features(spark, monkeypatch):
    c = codes(spark)
    plain = {(r.episode_id): (r.novelty, r.interference) for r in G.novelty(c, 5).collect()}
    monkeypatch.setattr(P, "LEAST", 12)
    assert {(r.episode_id): (r.novelty, r.interference) for r in G.novelty(c, 5).collect()} == {k: pytest.approx(v) for k, v in plain.items()}


def test_tiles_give_every_pair_once_and_no_task_a_whole_list(spark, hot):
    c = codes(spark)
    a, b = c.select("feature", F.col("episode_id").alias("a"), "w"), c.select("feature", F.col("episode_id").alias("b"), "w")
    rows = {}
    for _, i, _, f, w in skewed(80, 4):
        rows.setdefault(i, {})[f] = w
    got = {(r.a, r.b): (r.dot, r.overlap) for r in P.row_dots(a, b, "a", "b", ["feature"]).collect()}
    want = {(i, j): (sum(x[f] * y[f] for f in x.keys() & y.keys()), len(x.keys() & y.keys())) for i, x in rows.items() for j, y in rows.items() if x.keys() & y.keys()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(v[0]), v[1]) for k, v in want.items())
    most = max(sum(f == g for x in rows.values() for g in x) for f in range(60))
    blocks = P.hot_features(a, ["feature"])[0].agg(F.max("_blocks")).first()[0]
    assert blocks >= most // 12 > 3


def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(GR.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))
    two = [[r.x for r in spark.range(50).select("id", GR.permuted(F.col("id"), F.lit(50).cast("long"), F.lit(k)).alias("x")).orderBy("id").collect()] for k in "ab"]
    assert two[0] != two[1] and two[0] != list(range(50))


def test_random_targets_keep_degrees_and_avoid_self(spark):
    edges = spark.createDataFrame([("n", i, j, 1.0 + i + j) for i in range(9) for j in range(9) if i != j and (i + j) % 3], "ns string, src long, dst long, w double")
    got = GR.random_targets(edges, 5).collect()
    assert len({(r.src, r.dst) for r in got}) == len(got) == edges.count() and all(r.src != r.dst for r in got)
    weights = lambda rows: sorted((r.src, r.w) for r in rows)
    assert weights(got) == weights(edges.collect())
    assert {(r.src, r.dst) for r in got} != {(r.src, r.dst) for r in edges.collect()}
