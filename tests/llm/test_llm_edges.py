"""Operators against brute force on edge cases: edits, ties, magnitudes, long and repeated texts."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from recallgrid.llm import chat_format as C
from recallgrid.llm import decontaminate as D
from recallgrid.llm import nearest as N
from recallgrid.llm import quality as Q
from recallgrid.llm.common import text_batches, tokenizer_path
from recallgrid.llm.token_output import TextEncoder


def test_text_batches_bound_bytes():
    texts = ["a" * n for n in (3, 0, 5, 1, 1, 30, 2)] + [None, "é"]
    batch = pa.RecordBatch.from_pydict({"k": list(range(9)), "text": pa.array(texts, pa.string())})
    for source in (batch, batch.slice(2)):
        got = list(text_batches([source], 1, 6))
        assert pa.Table.from_batches(got) == pa.Table.from_batches([source])
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 6 for b in got)
    assert [b.num_rows for b in text_batches([batch.slice(0, 0)], 1)] == [0]


def test_pretokens_of_random_texts():
    encoder, rng = TextEncoder(tokenizer_path("byte_bpe_50k.json")), random.Random(11)
    alphabet = ["'", "s", "t", "r", "e", "v", "l", "d", "m", " ", " ", "\n", "\t", "1", ".", "é", "漢", " ", "　", "'s", "'re", "S", "<|", "٣", "\x85", "\x1c"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(5000)]
    want = [x.ids for x in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    for at_once in (1, 700):
        for k in range(0, len(texts) if at_once > 1 else 300, at_once):
            ids, sizes = encoder.encode(texts[k : k + at_once])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want[k : k + at_once]


def test_full_token_table_starts_again():
    encoder = TextEncoder(tokenizer_path("byte_bpe_50k.json"))
    encoder.table.ROOM = 10
    for text in ["some words here", "and others there now", "some words here"] * 3:
        assert encoder.encode([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


WORDS = [f"w{k}" for k in range(60)]


def test_contaminated_against_all_pairs(spark):
    rng = random.Random(8)
    items = [" ".join(rng.choices(WORDS, k=rng.choice([3, 8, 15, 40]))) for _ in range(25)] + ["alpha beta gamma delta epsilon zeta eta theta"]

    def edited(text, rate):
        out = []
        for w in text.split():
            u = rng.random()
            out += [rng.choice(WORDS)] if u < rate / 2 else [] if u < rate * 0.75 else [w, "extra"] if u < rate else [w]
        return " ".join(out)

    docs = [(k, f"{' '.join(rng.choices(WORDS, k=30))} {edited(rng.choice(items), rng.choice([0, 0.1, 0.2, 0.3]))} {' '.join(rng.choices(WORDS, k=30))}") for k in range(120)]
    docs += [(500, "alpha beta gamma changed epsilon zeta")]  # a single seed survives
    got = {(r.doc_id, r.item_id): r.score for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    block = D.Items(list(enumerate(items)))
    pairs = [(d, k, block.read(t)) for d, t in docs for k in range(len(items))]
    best = D.align([block.words[k] for _, k, _ in pairs], [w for _, _, w in pairs])[0]
    want = {(d, k): b / (2 * len(block.words[k])) for (d, k, _), b in zip(pairs, best, strict=True) if b >= len(block.words[k])}
    assert len(want) > 80 and (500, 25) in got
    assert got.keys() <= want.keys()  # nothing but what aligns
    whole = {(d, k) for d, k in want if f" {items[k]} " in f" {dict(docs)[d]} "}
    assert whole <= got.keys()
    for least in (8, 15):  # of three words, two that match by chance but not side by side are not looked for
        sized = {p for p in want if len(block.words[p[1]]) >= least}
        assert len(got.keys() & sized) >= 0.95 * len(sized), least
    assert all(math.isclose(s, want[p]) for p, s in got.items())


def test_turns_with_equal_numbers_follow_role_and_text(spark):
    texts = ["<|im_end|>", "<a", "<|", "<\\|", "b", None, "<z"]
    rows = [(1, 0, r, t) for t in texts for r in ("user", "us\ter", None)] + [(1, None, "user", "first"), (1, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ordered = sorted(((t is not None, t or 0, (r or "").encode(), (x or "").encode()) for _, t, r, x in rows))
    want = hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, _, r, x in ordered)).hexdigest()
    formatted = C.format_turns(turns)
    for got in (C.read_back(formatted).collect(), C.read_back(formatted, in_order=True).collect()):
        assert [(r.n_turns, r.turns_sha256) for r in got] == [(len(rows), want)]
    whole = "".join(r.segment for r in sorted(formatted.collect(), key=lambda r: r.place))
    assert [(r.encode(), x.encode()) for r, x, _, _ in C.parse(whole)] == [o[2:] for o in ordered]  # the whole conversation parses back


def test_features_cover_the_whole_text():
    text = " ".join(f"w{k}" for k in range(20_000))
    at = Q.FEATURES.index("distinct_words")
    assert Q.text_features(text)[at] == 1.0
    assert Q.text_features(f"{text} {text}")[at] == 0.5
    assert Q.text_features("")[at] == 0.0 and len(Q.text_features("one")) == len(Q.FEATURES)


def test_training_with_repeated_doc_ids_is_reproducible(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(WORDS, k=20)) + ("." if k % 2 else " | |")) for k in range(60)]
    rows += [(3, f"another text {k}") for k in range(50)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    models = [Q.train(spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(n), labels) for n in (1, 5)]
    x = np.array([Q.text_features(t) for _, t in rows])
    assert (models[0].score(x) == models[1].score(x)).all()


@pytest.mark.parametrize("size", [1e200, 1e-200, 1.0])
def test_nearest_at_all_magnitudes(spark, size):
    rng = random.Random(6)
    rows = [(k, [size * rng.uniform(-1, 1) for _ in range(5)]) for k in range(40)] + [(50, [size * 1e3, 0.0, 0.0, 0.0, 0.0]), (60, [1.0, 0.0, 0.0, 0.0, 1e-3])]
    got = N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), N.F.col("vec_id") % 10 == 0, 4, block=16, query_block=4).collect()
    near = {q: sorted((math.dist(v, dict(rows)[q]), i) for i, v in rows if i != q)[:4] for q, _ in rows if q % 10 == 0}
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, k): i for q, best in near.items() for k, (_, i) in enumerate(best, 1)}
    assert all(math.isclose(r.score, near[r.query_id][r["rank"] - 1][0], rel_tol=1e-12) for r in got)
