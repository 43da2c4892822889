"""Decontamination, licenses, mixing, the quality classifier and the pipeline."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.llm import decontaminate as D
from recallgrid.llm import licenses as L
from recallgrid.llm import mixing as M
from recallgrid.llm import quality as Q

WORDS = [f"word{k}" for k in range(500)]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def slow_score(item, words):
    """Plain local alignment, as a share of the best possible score."""
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (2 * len(item))


def test_align_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(30):
        items = [rng.integers(0, 6, rng.integers(1, 9)) for _ in range(4)]
        parts = [rng.integers(-1, 6, rng.integers(1, 14)) for _ in range(4)]
        score, _ = D.align(items, parts)
        assert np.allclose(score / [2 * len(i) for i in items], [slow_score(i.tolist(), p.tolist()) for i, p in zip(items, parts, strict=True)])


def test_contaminated(spark):
    rng = random.Random(4)
    items = [text(rng, 30) for _ in range(12)] + ["two words"]
    edited = lambda s: " ".join("changed" if k % 6 == 3 else w for k, w in enumerate(s.split()))
    docs = [(k, text(rng, 80)) for k in range(40)]
    docs += [(100 + k, f"{text(rng, 20)} {s.upper()}, {text(rng, 20)}") for k, s in enumerate(items[:12])]
    docs += [(200 + k, f"{text(rng, 20)} {edited(s)} {text(rng, 20)}") for k, s in enumerate(items[:12])]
    docs += [(300 + k, f"{text(rng, 9)} {items[0]}") for k in range(60)]  # a passage that is common
    docs += [(400, None), (401, ""), (402, "here are Two words!"), (None, items[3])]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, None), (51, " ... ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(df, bench).collect()}
    want = {(100 + k, k) for k in range(12)} | {(200 + k, k) for k in range(12)} | {(300 + k, 0) for k in range(60)} | {(402, 12), (None, 3)}
    assert set(got) == want
    assert got[100, 0].score == 1.0 and (got[100, 0].begin, got[100, 0].stop) == (20, 50)
    left = D.clean_documents(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 10)
    bench = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k}") for k in range(3)], "item_id long, text string")
    df = spark.createDataFrame([(k, f"so alpha{k} beta{k} gamma{k} delta{k} it is") for k in range(3)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_licenses(spark, monkeypatch):
    rng = random.Random(1)
    docs = [(k, f"{text(rng, 40)}. {notice} {text(rng, 40)}") for k, notice in enumerate(L.NOTICES.values())]
    docs += [(50, None), (51, ""), (52, "Licensed under the"), (53, " ".join(["Released under the MIT License."] * 3)), (None, L.NOTICES["MIT"])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, template_id string")
    names = spark.createDataFrame([*L.NOTICES.items(), ("none", None), ("short", "word1 word2")], "template_id string, text string")
    for limit in (5000, 3):
        monkeypatch.setattr(L, "BLOCK_SHINGLES", limit)
        got = {(r.doc_id, r.template_id) for r in L.license_scan(df, names).filter("template_id <> 'short'").collect()}
        assert got >= {(k, n) for k, n in enumerate(L.NOTICES)} | {(53, "MIT"), (None, "MIT")}
        assert not {i for i, _ in got} & {50, 51, 52}
    assert L.license_scan(df.limit(0), names).count() == 0 and L.license_scan(df, names.limit(0)).count() == 0


LEAVES = "domain string, lang string, source string, tokens long, n long"


def test_budgets_by_hand(spark):
    leaves = [("a", "x", "s1", 10, 1), ("a", "x", "s2", 100, 1), ("a", "y", "s3", 100, 1), ("b", "x", "s4", 20, 1)]
    got = {r.source: r.budget for r in M.leaf_budgets(spark.createDataFrame(leaves, LEAVES), 120, 1, {"domain": {"a": 1.0, "b": 1.0}}).collect()}
    # b can give 20 of its 60; a takes the other 100: 50 each for x and y, where s1 gives 10 and its sibling the rest.
    assert got == {"s1": 10.0, "s2": 40.0, "s3": 50.0, "s4": 20.0}
    more = {r.source: r.budget for r in M.leaf_budgets(spark.createDataFrame(leaves, LEAVES), 10_000, 2, {}).collect()}
    assert more == {"s1": 20.0, "s2": 200.0, "s3": 200.0, "s4": 40.0}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, text(rng, rng.randint(0, 30)), rng.choice(["en", None]), f"s{k % 3}" if k % 5 else None) for k in range(200)] + [(None, "a b", "en", "s1"), (7, None, "en", "s1")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    got = M.mix(docs, F.lit("d"), 0.5, 3, {"lang": {"en": 5.0}}).collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    used = sum(r.tokens * r.copies for r in got)
    assert used <= total * 0.5 and used >= total * 0.5 - 30 * 8  # each of 8 leaves misses less than a document
    again = M.mix(docs.repartition(7), F.lit("d"), 0.5, 3, {"lang": {"en": 5.0}}).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    once = {r.doc_id for r in M.mix(docs, F.lit("d"), 0.5, 1, {}).collect()}
    kept = M.mix_documents(docs, F.lit("d"), 0.5, {})
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == once
    assert M.mix(docs.limit(0), F.lit("d"), 0.5, 1, {}).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, F.lit("d"), 0.5, 1, {"lang": {"en": 0}}).collect()


def test_quality(spark):
    rng = random.Random(3)
    good = [(k, text(rng, 60) + ".") for k in range(150)]
    bad = [(k + 1000, " | ".join(text(rng, 40).upper().split())) for k in range(150)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in [*good, *bad, (5000, None), (5001, ""), (None, "x")]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert all(got[i] >= 0.3 for i, _ in good) and all(got[i] < 0.3 for i, _ in bad)
    kept = {r.doc_id for r in Q.good_documents(docs, model, 0.3).collect()}
    assert kept == {i for i, s in got.items() if s >= 0.3}
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0


def test_model_is_additive():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # a pure interaction
    model = Q.fit(x, y, rounds=20, pairs=3)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.85
    at = model.bins(x[:5])
    by_hand = [model.intercept + sum(t[b[k]] for t, b in zip(model.tables, at, strict=True)) + sum(t[model.coarse[i][at[i][k]], model.coarse[j][at[j][k]]] for i, j, t in model.pairs) for k in range(5)]
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-np.array(by_hand))))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > seen[4] == seen[5] > 0
    assert P.run(spark, SF).count() == seen[-1]


def test_other_texts_are_left_alone(spark):
    from recallgrid.llm import simhash as S

    rng = random.Random(9)
    docs = spark.createDataFrame([(k, text(rng, 120)) for k in range(150)], "doc_id long, text string")
    assert S.one_of_each(docs, S.SIMILAR).count() == 150
