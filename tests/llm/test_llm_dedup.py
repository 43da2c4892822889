"""SimHash, substring removal and nearest neighbours against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from recallgrid.llm import nearest as N
from recallgrid.llm import simhash as S
from recallgrid.llm import substrings as R
from recallgrid.llm.components import connected_components

DOCS = "doc_id long, text string, component_id string, prefix int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 30, 60, 200]))) for _ in range(n // 3)]
    out = []
    for k in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        shared = base[0].split(" ") if rng.random() < 0.3 else []
        out.append((k * 2 + 1, " ".join(words + shared) if rng.random() < 0.9 else " \t\n".join(words)))
    return [*out, (0, None), (500, ""), (501, "  \n"), (502, "Straße ÄÖ a")]


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("bucket", [4096, 2])
def test_simhash(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = corpus(3)
    got = {r.doc_id: r for r in S.simhash_components(frame(spark, [*rows, (None, "x y z")])).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: got[i].lo % 2**64 for i in prints} == prints
    assert {i: got[i].component_id for i in prints} == slow_components(prints)
    assert got[None].component_id is None


def test_every_close_pair_shares_a_variant():
    rng = random.Random(5)
    places = [np.arange(s, s + n) for s, n in S.CONTRACT.segments]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        lo = np.array([a, b], np.uint64)
        assert any((v[0] == v[1]) for _, v in S._variants(np.zeros(2, np.uint64), lo, places))


def test_one_of_each_keeps_columns(spark):
    long = " ".join(f"v{k}" for k in range(300))
    rows = [(5, long), (3, long), (9, long.replace("v7 ", "u7 ")), (4, "other text here"), (4, "other text here"), (None, long)]
    kept = S.one_of_each(frame(spark, rows), S.SIMILAR)
    assert kept.columns == ["doc_id", "text", "component_id", "prefix"]
    assert sorted(((r.doc_id is None), r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (True, 0)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {k: got[k] for k in range(1, 61)} == dict.fromkeys(range(1, 61), 0) and got[103] == got[101] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_removal(rows):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - R.SIZE + 1):
            if first.setdefault(tuple(w[p : p + R.SIZE]), i) < i:
                gone[p : p + R.SIZE] = [True] * R.SIZE
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.setdefault(i, set()).add((len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_substrings(spark, monkeypatch, group):
    monkeypatch.setattr(R, "GROUP", group)
    rows = [*corpus(8, 90), (600, "la " * 130), (601, "la " * 70), (602, "x " + "la " * 55), (11, "dup " * 60), (11, "dup " * 60)]
    got = R.remove_repeats(frame(spark, [*rows, (None, "la " * 60)])).collect()
    want = slow_removal(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) in want[r.doc_id]
    assert any(0 < r.n_removed < r.n_words for r in got)
    assert R.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, score string"


@pytest.mark.parametrize("block", [8192, 16])
def test_nearest(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 12)).astype(np.float32)
    x[40:90] = x[0]  # many equal vectors
    x[91] = x[0] * 1e-30
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    bad = [(1000, None, ""), (1010, [0.0] * 12, ""), (1020, [float("nan")] * 12, ""), (1030, [None] + [1.0] * 11, ""), (1040, [], ""), (None, [1.0] * 12, ""), (1050, [float("inf")] * 12, "")]
    other = [(2000, [1.0, 2.0], ""), (2001, [1.0, 2.5], "")]
    df = spark.createDataFrame(rows + rows[:3] + bad + other, VECTORS)
    got = N.nearest(df, N.F.col("vec_id") % 10 == 0, k=7, block=block, query_block=5).collect()
    y = x.astype(np.float64)
    for q in range(0, 150, 10):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        want = [k for k in np.lexsort((np.arange(150), d)) if k != q][:7]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == want and np.allclose([r.score for r in mine], d[want], rtol=1e-13)
    assert [(r.vec_id, r.score) for r in got if r.query_id == 2000] == [(2001, 0.5)]
    assert {r.query_id for r in got} == {*range(0, 150, 10), 2000}
    assert N.nearest(spark.createDataFrame([], VECTORS), N.F.col("vec_id") % 10 == 0).count() == 0


def test_rounds_of_components_are_small_plans(spark, monkeypatch):
    """No written table of a round is planned with more than a dozen exchanges, as the driver holds what it plans; stars need no round."""
    from recallgrid.llm import components as C

    planned, keep = [], C.written

    def counted(df, label):
        planned.append((label, df._jdf.queryExecution().executedPlan().toString().count("Exchange ")))
        return keep(df, label)

    monkeypatch.setattr(C, "written", counted)
    chain = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(200 + k, 200) for k in range(1, 9)], "a long, b long").repartition(4)
    got = {r.node: r.root for r in C.connected_components(chain).collect()}
    assert {v: got[v] for v in got} == {k: 0 for k in range(1, 61)} | {200 + k: 200 for k in range(1, 9)}
    assert max(n for _, n in planned) <= 12
    planned.clear()
    stars = spark.createDataFrame([(10 * g + k, 10 * g) for g in range(9) for k in range(1, 5)], "a long, b long").repartition(4)
    assert C.connected_components(stars).count() == 36
    assert [label for label, _ in planned] == ["links"]
