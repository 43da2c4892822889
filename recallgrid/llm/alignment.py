"""Alignment of two tokenizers' tokens of the same texts.

A two-pointer merge over the cumulative ends of both token sequences, in bytes, emits
groups, cut wherever tokens of both end, and links, the pairs of tokens whose byte ranges
overlap. Spark counts the linked pairs of identifiers over all texts and joins the counts
and each side's largest back.

Neither tokenizer joins characters across a space or line end that follows other than
white space, so texts are cut there and each distinct unit is tokenized and merged once
a worker. Where a vocabulary has a piece that would cross such a cut, texts go whole.

Documents are written in blocks of bounded size, with the numbers of their links in the
block's list of distinct pairs. Only these lists are exploded, joined with the counts and
sent back to their block, so a pair that stands everywhere is one row a block. A block's
documents and counts meet in one call, whose size the block bounds.

Edge cases: a null or empty text, and one whose tokens do not spell it (the second
tokenizer writes spaces as U+2581, so texts that hold that character), has no tokens: zeros
and an empty list of groups. A null id is kept; repeated rows are treated each, and count
each; other columns of the input are ignored; an empty table gives none. Special strings
inside texts are ordinary text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release_memory, table, text_batches, tokenizer_path, written
from .pieces import TIED
from .pretokens import PreTokenTable
from .token_counts import byte_alphabet

#: Bytes of text in a block.
BLOCK = 1 << 22
#: A pair of identifiers in one number: the first tokenizer's above these bits, the second's below.
SHIFT = 24


def merged_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, a, b, cut): the merge of two rising sequences of token ends that reach the same last byte.

    Each end closes a stretch that one token of either side covers, ``a`` and ``b`` by
    place: the links, each once. ``cut`` marks the ends that both sides have.
    """
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def _flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all entries one after the other, how many each list has)."""
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter(chain.from_iterable(each), np.int64, sizes.sum()), sizes


class Aligner:
    """Aligns texts under a byte-level BPE file (first) and a sentencepiece model (second)."""

    #: Units kept with their alignment, and their characters.
    ROOM, ROOM_CHARS = 300_000, 1 << 23
    #: Units that the first library gets in one call.
    TOGETHER = 4096

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.between = next(((t.content, k) for k, t in self.a.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)), None)
        self.specials = tuple(t.content for t in self.a.get_added_tokens_decoder().values())
        spec = json.load(open(path_a, encoding="utf-8"))
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path_a}: only plain byte-level files are supported")
        byte = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(byte[c] if c in byte else c.encode() for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in known]) for known in (self.bytes_a, self.bytes_b))
        self.words = {(k, c): np.array([f"{i}{c}" for i in range(n)], object) for k, n, c in (("a", len(self.bytes_a), ","), ("a", len(self.bytes_a), "|"), ("b", len(pieces), ","), ("b", len(pieces), ";"))}
        self.lead = self.b.piece_to_id("▁x")
        crossing = any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.cut = None if crossing or self.b.is_unknown(self.lead) else re.compile(r"(?<=\S)(?=[ \n])")
        self.pretokens = PreTokenTable(self._ids_a, np.uint32)
        self.clear()

    def clear(self) -> None:
        """Forgets all units."""
        self.number: dict[str, int] = {}
        self.shown: list[str | None] = []
        self.sizes = np.empty((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, where the links begin
        self.links = np.empty(0, np.int64)
        self.chars = 0

    def units(self, text: str) -> list[str]:
        """The pieces of a space and the text, which tokens do not cross."""
        if self.cut is None:
            return [" " + text]
        if any(t in text for t in TIED) or text[:1].isspace():
            return self.cut.split(" " + text)
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(("\n" if out else " ") + words[0])
            out += [" " + w for w in words[1:]]
        return out

    def _ids_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, how many each unit has) of the first tokenizer; many units go in one call, parted by a special string that none of them has."""
        if self.between is None or any(s in u for u in units for s in self.specials):
            self.a.encode_special_tokens = True
            each = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
            return _flat(each)
        self.a.encode_special_tokens = False
        made, sizes = [], []
        for k in range(0, len(units), self.TOGETHER):
            ids = np.array(self.a.encode_batch_fast([self.between[0].join(units[k : k + self.TOGETHER])], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.between[1])
            sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
            made.append(np.delete(ids, cuts))
        return np.concatenate(made), np.concatenate(sizes)

    def _ids_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of the second tokenizer; units stand after a letter, whose token is taken off."""
        if self.cut is None:
            return _flat(self.b.encode([u[1:] for u in units], num_threads=1))
        ids, sizes = _flat(self.b.encode(["x" + u for u in units], num_threads=1))
        first = np.cumsum(sizes) - sizes
        if not (ids[first] == self.lead).all():
            raise ValueError("the second tokenizer joins a unit with the letter before it")
        return np.delete(ids, first), sizes - 1

    def learn(self, units: list[str]) -> None:
        """Aligns units that are not known yet, all in one merge."""
        if not units:
            return
        first = len(self.shown)
        self.chars += sum(map(len, units))
        self.number.update(zip(units, range(first, first + len(units)), strict=True))
        a, bounds = self.pretokens.numbers("".join(units), np.cumsum([0, *map(len, units[:-1])]))
        a, n_a, (b, n_b) = a.astype(np.int64), np.diff(bounds), self._ids_b(units)
        raw = list(map(str.encode, units))
        right = self._spelled(a, n_a, self.bytes_a, self.size_a, raw) & self._spelled(b, n_b, self.bytes_b, self.size_b, raw)
        sizes = np.zeros((len(units), 5), np.int64)
        shown: list[str | None] = [None] * len(units)
        good = np.flatnonzero(right)
        if len(good):
            sizes[good, 0], sizes[good, 1] = n_a[good], n_b[good]
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            ends, at_a, at_b, cut = merged_ends(ends_a, ends_b)
            own = np.searchsorted(ends_a[np.cumsum(sizes[good, 0]) - 1], ends)
            sizes[good, 2], sizes[good, 3] = np.bincount(own[cut], minlength=len(good)), np.bincount(own, minlength=len(good))
            sizes[good, 4] = len(self.links) + np.cumsum(sizes[good, 3]) - sizes[good, 3]
            self.links = np.append(self.links, a[at_a] << SHIFT | b[at_b])
            last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            last_a[at_a[cut]] = last_b[at_b[cut]] = True
            before_a, before_b = np.append(0, at_a[cut] + 1), np.append(0, at_b[cut] + 1)  # tokens before each group
            written_out = np.empty(len(a) + len(b), object)
            place_a = np.arange(len(a)) + before_b[np.cumsum(last_a) - last_a]
            place_b = np.arange(len(b)) + before_a[np.cumsum(last_b) - last_b + 1]
            for k, ids, last, place, end in (("a", a, last_a, place_a, "|"), ("b", b, last_b, place_b, ";")):
                written_out[place] = np.where(last, self.words[k, end][ids], self.words[k, ","][ids])
            pieces, begin = written_out.tolist(), 0
            for k, n in zip(good.tolist(), (sizes[good, 0] + sizes[good, 1]).tolist(), strict=True):
                shown[k] = "".join(pieces[begin : begin + n])
                begin += n
        self.shown += shown
        self.sizes = np.append(self.sizes, sizes, axis=0)

    @staticmethod
    def _spelled(ids: np.ndarray, sizes: np.ndarray, known: list[bytes], lengths: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each unit's tokens spell it; one comparison of all, and one for each unit only where that fails."""
        ends = np.append(0, np.cumsum(lengths[ids]))[np.cumsum(sizes)]
        said = b"".join(map(known.__getitem__, ids.tolist()))
        if np.array_equal(ends, np.cumsum(list(map(len, raw)))) and said == b"".join(raw):
            return np.ones(len(raw), bool)
        begins = np.append(0, ends[:-1]).tolist()
        return np.array([said[s:e] == r for s, e, r in zip(begins, ends.tolist(), raw, strict=True)])

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, links) of each text; groups as `a1,a2|b1;a3|b2,b3`, links as a << SHIFT | b."""
        if len(self.shown) > self.ROOM or self.chars > self.ROOM_CHARS:
            self.clear()
        split = [self.units(t) if t else [] for t in texts]
        self.learn(list(dict.fromkeys(u for s in split for u in s if u not in self.number)))
        for s in split:
            numbers = list(map(self.number.__getitem__, s))
            shown = list(map(self.shown.__getitem__, numbers))
            if not s or None in shown:
                yield 0, 0, 0, "", np.empty(0, np.int64)
                continue
            of = self.sizes[numbers]
            size = of[:, 3]
            n_links = int(size.sum())
            where = np.repeat(of[:, 4] - np.cumsum(size) + size, size) + np.arange(n_links)
            yield *of[:, :3].sum(axis=0).tolist(), "".join(shown)[:-1], self.links[where]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents and of blocks, told apart by ``pairs``, which only blocks have.

    A document has (block, id, n_a, n_b, n_groups, n_links, groups, links); ``groups`` is
    its alignment as text, ``links`` the compressed places of its links in the block's
    ``pairs``. A block has its distinct pairs and in ``times`` how many links each has.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["block", id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, pack = _aligner(path_a, path_b), zstandard.ZstdCompressor(level=1).compress
        base = TaskContext.get().partitionId() << 32
        number, size, held, kind_of_id = 0, 0, [], None

        def doc_rows(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list]:
            found = list(aligner.align(batch.column(1).to_pylist()))
            return [f[4] for f in found], [batch.column(0), *[[f[k] for f in found] for k in range(4)]]

        def close() -> Iterator[pa.RecordBatch]:
            links = [x for each, _ in held for x in each]
            pairs, places, times = np.unique(np.concatenate(links) if links else np.empty(0, np.int64), return_inverse=True, return_counts=True)
            places, at = places.astype(np.uint32), 0
            block = base + number
            for each, (ids, n_a, n_b, n_groups, groups) in held:
                packed = []
                for x in each:
                    packed.append(pack(places[at : at + len(x)].tobytes()))
                    at += len(x)
                n = len(each)
                longs = [pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, [len(x) for x in each])]
                empty = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), ids, *longs, pa.array(groups, pa.string()), pa.array(packed, pa.binary()), empty, empty], names=names)
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (pairs, times)]
            none = [pa.nulls(1, t) for t in (kind_of_id, *[pa.int64()] * 4, pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, *lists], names=names)

        for batch in text_batches(batches, 1):
            if not len(batch):
                continue
            kind_of_id = batch.column(0).type
            held.append(doc_rows(batch))
            size += batch.column(1).nbytes
            if size >= BLOCK:
                yield from close()
                number, size, held = number + 1, 0, []
        if held:
            yield from close()
        held = []
        release_memory()

    schema = f"block long, `{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<long>, times array<long>"
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, links, a_most, b_most): links of each pair of identifiers, and the largest of its two sides."""
    each = aligned.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("links"))
    counted = counted.withColumns({"a": F.shiftright("pair", SHIFT), "b": F.col("pair").bitwiseAND((1 << SHIFT) - 1)})
    most = {f"{side}_most": F.max("links").over(W.partitionBy(side)) for side in ("a", "b")}
    return counted.withColumns(most).select("pair", "a", "b", "links", "a_most", "b_most")


def doc_links(aligned: DataFrame, counts: DataFrame, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The documents of ``aligned`` with n_best, their links whose count is the highest of the second identifier, and count_sum, the counts of all links.

    ``keep`` names the further columns of the documents that are wanted.
    """
    keep = keep or []
    wanted = aligned.filter("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("place", "pair"))
    told = wanted.join(counts.select("pair", "links", (F.col("links") == F.col("b_most")).alias("best")), "pair").select(F.col("block").alias("of"), "place", "links", "best")
    rows = aligned.filter("pairs IS NULL").select("block", id_col, *keep, "links")
    schema = rows.drop("block", "links").schema.add("n_best", "long").add("count_sum", "long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        n = 1 + max(right.column("place").to_numpy(), default=-1)
        links, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        links[place], best[place] = right.column("links").to_numpy(), right.column("best").to_numpy()
        sums, bests = [], []
        for packed in left.column("links").to_pylist():
            at = np.frombuffer(unpack(packed), np.uint32)
            sums.append(int(links[at].sum()))
            bests.append(int(best[at].sum()))
        kept = left.select([id_col, *keep])
        return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return rows.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(meet, schema)


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).when(F.col("pairs").isNull(), "")
    kept = written(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return doc_links(kept, pair_counts(kept), keep=["n_a", "n_b", "n_groups", "n_links", "groups_sha256"], id_col="doc_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
