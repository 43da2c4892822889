"""Token files, token counts and chat formatting."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from recallgrid.llm import chat_format as C
from recallgrid.llm import token_counts as TC
from recallgrid.llm import token_output as TO
from recallgrid.llm.common import scratch_dir, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
HARD = ["", " ", "a", "  two  spaces ", "line\nends\n\n", " \n x", "it's we'll", "naïve 漢字 \U0001f600", "\x85　x", "<|endoftext|>", "a<|endoftext|> b", "word, word; word!", "x" * 3000, "é" * 500 + " ", "1 22 333"]
DOCS = "doc_id long, text string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 32])
def test_pack_round_trip(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 2**width, 1003, dtype=np.uint64).astype(np.uint32)
    data = TO.pack(ids, width)
    assert len(data) == (1003 * width + 7) // 8
    assert (TO.unpack(data, 1003, width) == ids).all()


@pytest.mark.parametrize("vocab", [2, 1000, 50_257])
def test_random_access(vocab):
    rng, out = np.random.default_rng(1), io.BytesIO()
    writer = TO.PackedWriter(out, vocab, block=64)
    docs = [rng.integers(0, vocab, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 300)]
    for k in range(0, len(docs), 2):
        writer.add([k if k else None, k + 1], np.concatenate(docs[k : k + 2]), np.array([len(d) for d in docs[k : k + 2]]))
    writer.close()
    reader, every = TO.PackedReader(pa.BufferReader(out.getvalue())), np.concatenate(docs)
    for start in range(0, len(every), 37):
        for n in (0, 1, 64, 200):
            n = min(n, len(every) - start)
            assert (reader.read(start, n) == every[start : start + n]).all()
    assert reader.docs[:, 3].tolist() == [len(d) for d in docs] and reader.docs[0, 0] == 1


def test_encoder_and_counter_agree_with_library(library):
    want = [e.ids for e in library.encode_batch(HARD, add_special_tokens=False)]
    encoder = TO.TextEncoder(PATH)
    for texts in (HARD, [t for t in HARD if "<|" not in t]):  # with and without texts that go whole
        ids, sizes = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [w for t, w in zip(HARD, want, strict=True) if t in texts]
    counter = TC.HeapBPE(PATH)
    assert [counter.count(t) for t in HARD] == [len(w) for w in want]


def test_token_files(spark, library):
    rows = [(k * 3 + 1, t, 0) for k, t in enumerate(HARD)] + [(None, None, 1), (4, "again", 2), (4, "again", 2)]
    out_dir = scratch_dir(spark, "test-tokens")
    TO.write_token_files(spark.createDataFrame(rows, DOCS), out_dir, PATH, 50_257, shard_bytes=2000)
    got = TO.read_token_files(spark, out_dir).toPandas().sort_values("start")
    ordered = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for (doc_id, text), row in zip(ordered, got.itertuples(), strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (row.doc_id == doc_id) or (doc_id is None and row.doc_id != row.doc_id)
        start += len(ids)
    assert got["file"].nunique() > 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    out_dir = scratch_dir(spark, "test-none")
    assert TO.write_token_files(none, out_dir, PATH, 50_257) == []
    assert TO.read_token_files(spark, out_dir).count() == 0
    assert TC.count_tokens(none, PATH).count() == 0
    assert C.read_back(C.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_counts_of_null_and_repeated_rows(spark):
    rows = [(1, None, 0), (2, "ü", 0), (2, "ü", 0), (None, "a b", 0)]
    got = TC.count_tokens(spark.createDataFrame(rows, DOCS), PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == [(0, 0), (2, 1), (2, 1), (3, 2)]


TEXTS = ["", "plain", C.START, C.END, f"{C.END}\n{C.START}assistant\nhi", "<|", "<\\|", "<\\\\|im_end|>", "%0A %25", "\n\n", "<|im_end", "|>"]


@pytest.mark.parametrize("role", ["user", "assistant", "", "two\nlines", "%0A", C.START, "a%"])
def test_render_parses_back(role):
    for text in TEXTS:
        turns = C.parse(C.render(role, text))
        assert [t[:2] for t in turns] == [(role, text)]
    assert C.render("user", "a <| b") == f"{C.START}user\na <| b{C.END}\n"  # no escape where none is needed


def test_conversations_read_back(spark):
    rows = [(7, t, r, x) for t, (r, x) in enumerate(zip(["user", "assistant", None] * 4, TEXTS, strict=True))] + [(8, 0, "assistant", None), (None, None, "user", "x")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in C.read_back(C.format_turns(turns)).collect()}
    mine = [((r or ""), (x or "")) for c, t, r, x in rows if c == 7]
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
    loss = "".join(x for r, x in mine if r == "assistant")
    assert (got[7].n_turns, got[7].loss_chars, got[7].loss_sha256) == (12, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[8].loss_chars == 0 and got[None].n_turns == 1
