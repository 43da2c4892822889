"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over all documents counts how many contain each word n-gram of the test items.
Those that are not much more frequent than an item's median one become its seeds, and in
every run of SPREAD neighbouring n-grams the rarest one, so that any copied run of a few
words holds a seed however common a passage is. A second
pass finds the seeds, joins passages to items by them (seeds that nearly agree on the
shift between the two make one passage), and aligns the words of passage and item locally
(match +2, mismatch and gap -1). A copy in which no two (three, from SHORT words on)
neighbouring words of the item stand together is not found.
The score is the alignment's share of the item's best possible one; pairs from
``threshold`` on count as contaminated.

The items come in blocks of bounded size, BLOCK_CHARS (or one item), each sent to all tasks; a larger
test set takes further passes instead of more memory. Both passes are map-only over whole
texts, so frequent passages meet in no single task; only counts per n-gram are shuffled.

Words are lower-cased and stripped of ASCII punctuation. Edge cases: null and empty texts
contain nothing and null or empty items match nothing; items of one or two words are
found as they stand; repeated document rows are reported each, several items with one
item_id as the best of them; a null doc_id is kept; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

#: Words of an n-gram (for items of fewer than SHORT words, and for others), and neighbouring n-grams of which the rarest is a seed.
SHORT_GRAM, GRAM, SHORT, SPREAD = 2, 3, 12, 4
#: N-grams of an item that are more frequent than this many times its median one are no seeds, unless the rarest nearby.
COMMON = 8
#: Characters of test items that go to the tasks together.
BLOCK_CHARS = 8_000_000
#: Shifts this far apart belong to different passages.
GAP = 8
_DROP = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)


def normal_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_DROP).split()


class Items:
    """A block of test items as word numbers, with the n-grams of each."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            tokens = normal_words(text or "")
            if tokens:
                self.ids.append(item_id)
                self.words.append(np.array([self.number.setdefault(t, len(self.number)) for t in tokens], np.int64))
        self.grams = [self.codes(w, self.width(w)) for w in self.words]
        self.widths = sorted({self.width(w) for w in self.words})

    @staticmethod
    def width(words: np.ndarray) -> int:
        return min(GRAM if len(words) >= SHORT else SHORT_GRAM, len(words))

    def codes(self, words: np.ndarray, width: int) -> np.ndarray:
        """A 63-bit hash of each run of ``width`` words; -1 where a word is in no item. Two with one hash cost an alignment."""
        n = len(words) - width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.full(n, width, np.uint64), np.ones(n, bool)
        for k in range(width):
            part = words[k : k + n]
            code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            known &= part >= 0
        return np.where(known, (code >> np.uint64(1)).astype(np.int64), -1)

    def read(self, text: str) -> np.ndarray:
        tokens = normal_words(text)
        get = self.number.get
        return np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))

    def hits(self, words: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place in the sorted ``wanted``) of each wanted n-gram."""
        at, which = [], []
        for width in self.widths:
            code = self.codes(words, width)
            places = np.flatnonzero(code >= 0)
            if len(places) and len(wanted):
                k = np.minimum(np.searchsorted(wanted, code[places]), len(wanted) - 1)
                found = wanted[k] == code[places]
                at.append(places[found])
                which.append(k[found])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.empty(0, np.int64),) * 2


def rare_seeds(grams: np.ndarray, documents: dict[int, int]) -> np.ndarray:
    """Places of the seeds of one item: n-grams no more than COMMON times as frequent as its median one, and the rarest of each SPREAD neighbours.

    The first kind covers edited copies, whose unbroken n-grams are a little more frequent
    than the broken ones; the second leaves no stretch of the item without a seed.
    """
    counts = np.array([documents.get(int(g), 0) for g in grams])
    usual = np.flatnonzero(counts <= COMMON * max(1, np.sort(counts)[(len(counts) - 1) // 2]))
    if len(counts) <= SPREAD:
        return np.union1d(usual, np.flatnonzero(counts == counts.min()))
    view = np.lib.stride_tricks.sliding_window_view(counts, SPREAD)
    return np.union1d(usual, view.argmin(axis=1) + np.arange(len(view)))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item and passage, and the place one past its end in the passage."""
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.full((len(items), rows), -2, np.int64), np.full((len(items), cols), -1, np.int64)
    for k, (i, p) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(i)], b[k, : len(p)] = i, p
    step = np.arange(cols)
    above = np.zeros((len(items), cols + 1), np.int64)
    best, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for r in range(rows):
        own = np.maximum(above[:, :-1] + np.where(b == a[:, r : r + 1], 2, -1), above[:, 1:] - 1)
        own = np.maximum(own, 0)
        own = np.maximum.accumulate(own + step, axis=1) - step  # gaps along the passage
        above[:, 1:] = own
        top = own.argmax(axis=1)
        score = own[np.arange(len(items)), top]
        better = score > best
        best[better], end[better] = score[better], top[better] + 1
    return best, end


def _counts(items: Items, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            seen = np.zeros(len(wanted), np.int64)
            for text in b.column(1).to_pylist():
                seen[np.unique(items.hits(items.read(text), wanted)[1])] += 1
            k = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[k]), pa.array(seen[k])], names=["gram", "n"])

    return run


FOUND = "doc_id long, item_id long, score double, begin long, stop long"
#: Words of passages that are aligned together.
TOGETHER = 1 << 14


def _finder(items: Items, seeds: list[np.ndarray], threshold: float):
    """A function from (number, text) pairs to rows (number, item_id, score, begin, stop)."""
    owner = np.concatenate([np.full(len(s), k) for k, s in enumerate(seeds)]) if seeds else np.empty(0, np.int64)
    place = np.concatenate(seeds) if seeds else np.empty(0, np.int64)
    code = np.concatenate([g[s] for g, s in zip(items.grams, seeds, strict=True)]) if seeds else np.empty(0, np.int64)
    order = np.argsort(code, kind="stable")
    owner, place, code = owner[order], place[order], code[order]
    wanted, first, count = np.unique(code, return_index=True, return_counts=True)

    def passages(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, stop) of each passage with a seed; those whose seeds nearly agree on a shift are one."""
        at, which = items.hits(words, wanted)
        n = count[which]
        spread = np.repeat(first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        item, shift = owner[spread], np.repeat(at, n) - place[spread]
        order = np.lexsort((shift, item))
        item, shift = item[order], shift[order]
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(shift) > GAP)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
            if e > s:
                k = int(item[s])
                yield k, max(0, int(shift[s]) - GAP), min(len(words), int(shift[e - 1]) + len(items.words[k]) + GAP)

    def solve(tasks: list[tuple]) -> list[tuple]:
        """Tasks are (doc_id, item, begin, words of the passage)."""
        own, parts = [items.words[t[1]] for t in tasks], [t[3] for t in tasks]
        score, stop = align(own, parts)
        share = score / np.array([2 * len(w) for w in own])
        good = np.flatnonzero(share >= threshold)
        if not len(good):
            return []
        tail = align([own[k][::-1] for k in good], [parts[k][: stop[k]][::-1] for k in good])[1]
        return [(tasks[k][0], items.ids[tasks[k][1]], float(share[k]), tasks[k][2] + int(stop[k] - n), tasks[k][2] + int(stop[k])) for k, n in zip(good.tolist(), tail.tolist(), strict=True)]

    def in_parts(tasks: list[tuple]) -> list[tuple]:
        """By size, so that no passage or item is filled up to twice its length."""
        sized: dict[tuple[int, int], list[tuple]] = {}
        for t in tasks:
            sized.setdefault((len(t[3]).bit_length(), len(items.words[t[1]]).bit_length()), []).append(t)
        return [row for part in sized.values() for row in solve(part)]

    def find(texts: Iterator[tuple[int, str]]) -> list[tuple]:
        rows: list[tuple] = []
        tasks: list[tuple] = []
        cells = 0
        for n, text in texts:
            words = items.read(text)
            for k, begin, stop in passages(words):
                tasks.append((n, k, begin, words[begin:stop]))
                cells += stop - begin
                if cells >= TOGETHER:
                    rows += in_parts(tasks)
                    tasks, cells = [], 0
        return rows + in_parts(tasks)

    return find


def _search(items: Items, seeds: list[np.ndarray], threshold: float):
    find = _finder(items, seeds, threshold)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            rows = find(enumerate(b.column(1).to_pylist()))
            n, *rest = zip(*rows, strict=True) if rows else ([],) * 5
            cols = [b.column(0).take(pa.array(n, pa.int64())), *[pa.array(list(c), t) for c, t in zip(rest, kinds[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "begin", "stop"])

    return run


def _clean(items: Items, seeds: list[np.ndarray], threshold: float, place: int):
    """Passes on the rows whose text, in column ``place``, holds no item."""
    find = _finder(items, seeds, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, place):
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in find(enumerate(t or "" for t in b.column(place).to_pylist()))]] = False
            yield b.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size; the driver holds one block at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).orderBy("item_id", "text").toLocalIterator():
        rows.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= BLOCK_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _prepared(texts: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Items, list[np.ndarray]]]:
    """Each block of test items, with the seeds that are rarest in all of (doc_id, text)."""
    for rows in _blocks(benchmark):
        items = Items(rows)
        if items.words:
            wanted = np.unique(np.concatenate(items.grams))
            counted = texts.mapInArrow(_counts(items, wanted), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            documents = {r.gram: r.n for r in counted.collect()}  # a row per n-gram of the block at most
            yield items, [rare_seeds(g, documents) for g in items.grams]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, begin, stop) of every passage from word ``begin`` to ``stop`` that copies an item."""
    texts = _texts(docs)
    parts = [texts.mapInArrow(_search(items, seeds, threshold), FOUND) for items, seeds in _prepared(texts, benchmark)]
    return reduce(DataFrame.unionByName, parts, docs.sparkSession.createDataFrame([], FOUND))


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that hold no test item; texts stay where they are read."""
    kept = docs
    for items, seeds in _prepared(_texts(docs), benchmark):
        kept = kept.mapInArrow(_clean(items, seeds, threshold, docs.columns.index("text")), docs.schema)
    return kept


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # The best passage of each pair, the first among equals.
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("begin")).alias("back"), "stop")).alias("p"))
    return best.select("doc_id", "item_id", "p.score", (-F.col("p.back")).alias("begin"), "p.stop")
