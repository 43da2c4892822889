"""Near-duplicate removal against brute-force five-word Jaccard similarity."""

import random

import numpy as np
import pytest

from recallgrid.llm import simhash as S
from recallgrid.llm import similar as N

SCHEMA = "doc_id long, text string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA)


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_kept(rows):
    """Doc_ids that stay: the least of each component of pairs at 0.8 or more."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def planted(rng, n, words=120):
    """Pairs of a text and a copy with a run of new words at its end, of a similarity from 0.5 to 1."""
    out = []
    for k in range(n):
        base = [f"t{k}w{rng.randrange(10**6)}" for _ in range(words)]
        cut = round((words - 4) * (1 - (0.5 + 0.5 * k / n)) / (1 + 0.5 + 0.5 * k / n))
        copy = base[: words - cut] + [f"n{k}x{j}" for j in range(cut)]
        out += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return out


@pytest.mark.parametrize("tile", [1 << 20, 300])
def test_planted_pairs_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rows = planted(random.Random(6), 150)
    near = [jaccard(shingles(rows[k][1]), shingles(rows[k + 1][1])) for k in range(0, 300, 2)]
    assert sum(0.8 <= s < 0.85 for s in near) >= 10 and sum(0.7 <= s < 0.8 for s in near) >= 20
    chain = [f"c{k}" for k in range(200)]
    rows += [(1000 + k, " ".join([f"z{j}" for j in range(8 * k)] + chain[8 * k :])) for k in range(12)]  # each like the next only
    got = [r.doc_id for r in S.one_of_each(frame(spark, rows), S.SIMILAR).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_kept(rows)


def test_recall_of_the_bands():
    rng, met = np.random.default_rng(1), 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 2**63, 10, dtype=np.uint64)])  # 80 of 100
        met += bool((N.band_keys(a, N.SIMILAR) == N.band_keys(b, N.SIMILAR)).any())
    assert met >= 298


def test_short_texts_and_empty_ones_stay_apart(spark):
    rng = random.Random(3)
    short = [(k, " ".join(f"s{rng.randrange(10**6)}" for _ in range(6))) for k in range(10, 300)]
    rows = [(1, None), (2, ""), (3, " \n"), *short]
    assert {r.doc_id for r in S.one_of_each(frame(spark, rows), S.SIMILAR).collect()} == {1, *range(10, 300)}
    assert S.one_of_each(frame(spark, rows).limit(0), S.SIMILAR).count() == 0


def test_rows_of_one_doc_id_are_told_apart(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(4, a), (4, b), (4, b), (7, a + " more"), (None, a)]
    kept = S.one_of_each(frame(spark, rows), S.SIMILAR).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, a), (4, a), (4, b)]


def test_fingerprints_propose_without_bands(spark, monkeypatch):
    monkeypatch.setattr(N, "_stars", lambda batches: (b.slice(0, 0).rename_columns(["a", "b"]) for b in batches))
    draw = random.Random(8)
    rows = []
    for k in range(20):  # copies with one word more, of a similarity of 0.999
        base = " ".join(f"t{k}w{draw.randrange(10**6)}" for _ in range(1000))
        rows += [(2 * k, base), (2 * k + 1, base + " more")]
    prints = [S.majority(np.unique(N.shingle_hashes(t, 5))) for _, t in rows]
    near = {2 * k for k in range(20) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 3}
    assert len(near) > 10
    kept = {r.doc_id for r in S.one_of_each(frame(spark, rows), S.SIMILAR).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i - 1 not in near}
