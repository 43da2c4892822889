"""Removal of long word sequences that an earlier document has, by prefix-partitioned suffix trees.

A window is SIZE consecutive words. Its anchor is the leftmost smallest CORE-word gram in
it, which depends on the window's own words only, so equal windows have equal anchors.
Suffixes are kept as fragments: a run of window starts that share an anchor, with the
words of all their windows. They are partitioned by the words that all windows of a
cell of anchor distances have in common, at first the CORE words of the anchor. A
partition with more than GROUP different fragments is split by longer such prefixes
(the cell is halved: 8, then 29, 39, 44, 47, 48, 50 words), at the end by whole windows, where
one partition holds one fragment. So each partition fits in memory at any input size.

In a partition the suffix tree is built level by level, by prefix doubling: the classes
of equal 1, 2, 4, ... word prefixes are its nodes at these depths. The nodes at depth
SIZE with several suffixes are the roots of the subtrees of deep repeats; each gets the
smallest doc_id below it, and a window that has a smaller one than its own document's
is covered. The union of such windows spans the maximal repeats.

Anchors whose prefix occurs in one document only are dropped before any words are sent.
Copies of a whole word sequence are settled by a digest first, and equal fragments are
merged, so that large groups of copies cost one row of work.

Edge cases: null and blank texts have no words and the digest of nothing; texts of under
SIZE words lose nothing; repeats within one document, or between rows of one doc_id, are
not removed; a row with a null doc_id neither loses words nor takes any from others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_safe_lookup, table, text_batches, written

SIZE, CORE = 50, 8
#: Different fragments of a partition that are put into one tree; more are split.
GROUP = 20_000
#: Suffixes whose trees are built together.
BUNDLE = 1 << 21
NOTHING = hashlib.sha256(b"").hexdigest()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, tokens), np.uint64, len(tokens))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchored_runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, one past the last, anchor) of each run of windows with one anchor; and see gram_hashes."""
    if len(h) < SIZE:
        none = np.empty(0, np.int64)
        return none, none, none
    grams = gram_hashes(h, CORE)
    view = np.lib.stride_tricks.sliding_window_view(grams, SIZE - CORE + 1)
    anchors = view.argmin(axis=1) + np.arange(len(view))
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    return first, np.concatenate([first[1:], [len(anchors)]]), anchors[first]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text); tk tells apart rows of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches, 2):
        sizes, digests, prefixes = [], [], []
        for text in b.column(2).to_pylist():
            tokens = text.encode().split()
            h = word_hashes(tokens) if len(tokens) >= SIZE else np.empty(0, np.uint64)
            sizes.append(len(tokens))
            digests.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            prefixes.append(gram_hashes(h, CORE).view(np.int64)[anchored_runs(h)[2]])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "tk", "n_words", "sha", "prefixes"])


FRAGMENT = "doc_id long, tk long, s0 long, far long, near long, key long, frag binary, words binary"


def _fragment_row(words: np.ndarray, far: int, near: int, lo: int, hi: int) -> tuple[int, bytes]:
    """Partition key of a cell [lo, hi] of anchor distances, and the digest of the fragment.

    ``words`` run from distance ``far`` before the anchor to the end of the window at distance ``near``.
    """
    core = words[far - lo : far - hi + SIZE].tobytes()
    tag = bytes([lo, hi, far, near])
    return xxhash.xxh64_intdigest(tag[:2] + core) - (1 << 63), xxhash.xxh3_128_digest(tag + words.tobytes())


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches, 2):
        rows = []
        for doc_id, tk, text, chosen in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            h = word_hashes(text.encode().split())
            first, end, anchor = anchored_runs(h)
            for k in chosen:
                s, e, a = int(first[k]), int(end[k]), int(anchor[k])
                words = h[s : e - 1 + SIZE]
                rows.append((doc_id, tk, s, a - s, a - e + 1, *_fragment_row(words, a - s, a - e + 1, 0, SIZE - CORE), words.tobytes()))
        yield _rows_batch(rows, FRAGMENT)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _rows_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def depth_classes(words: np.ndarray) -> np.ndarray:
    """For each place, the suffix tree's node at depth SIZE on its path: equal numbers mean SIZE equal words.

    Places with fewer than SIZE words after them get a meaningless node and are not asked for.
    """
    node = np.unique(words, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < SIZE:
        step = min(depth, SIZE - depth)  # the last step overlaps
        ahead = np.concatenate([node[step:], np.zeros(step, np.int64)])
        node = np.unique(node * (int(node.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        depth += step
    return node


TREE = "frag binary, least_at binary"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, frag, least, words) in order of key; gives the smallest doc_id of each fragment's windows."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[3]) // 8 for r in rows])
        words = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counts = sizes - SIZE + 1
        starts = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        node = np.unique(depth_classes(words)[starts], return_inverse=True)[1]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, np.repeat(np.array([r[2] for r in rows], np.int64), counts))
        found = np.split(least[node], np.cumsum(counts)[:-1])
        return _rows_batch([(r[1], x.tobytes()) for r, x in zip(rows, found, strict=True)], TREE)

    held, size, key = [], 0, None
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if row[0] != key and size >= BUNDLE:
                yield solve(held)
                held, size = [], 0
            key = row[0]
            held.append(row)
            size += len(row[3]) // 8
    if held:
        yield solve(held)


def _halves(lo: int, hi: int):
    """Cuts the fragments of cell [lo, hi] into those of its two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid = (lo + hi) // 2
        for b in batches:
            rows = []
            for parent, shift, far, near, least, words in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                w = np.frombuffer(words, np.uint64)
                for a, z in ((lo, mid), (mid + 1, hi)):
                    f, n = min(far, z), max(near, a)
                    if f >= n:
                        own = w[far - f : far - n + SIZE]
                        rows.append((parent, shift + far - f, f, n, *_fragment_row(own, f, n, a, z), least, own.tobytes()))
            yield _rows_batch(rows, PART)

    return run


PART = "parent binary, shift long, far long, near long, key long, frag binary, least long, words binary"


def _least_of_windows(parts: DataFrame, lo: int = 0, hi: int = SIZE - CORE) -> DataFrame:
    """(parent, shift, least_at): smallest doc_ids of the windows of each fragment, from window ``shift`` on."""
    merged = parts.groupBy("frag").agg(F.min("least").alias("least"), F.first("key").alias("key"), F.first("words").alias("words"), F.first("far").alias("far"), F.first("near").alias("near"))
    merged = written(merged, "op5-fragments")
    sizes = merged.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    large = written(sizes.filter(F.col("m") > GROUP), "op5-large") if hi > lo else None
    split = large is not None and not large.isEmpty()
    small = merged
    if split:  # at most rows / GROUP keys are large, so this side of the join is small against the other
        total = merged.count()
        flagged = hot_safe_lookup(merged, sizes.withColumn("n", F.col("m")), "key", "n", total)
        small, over = flagged.filter(F.col("m") <= GROUP), flagged.filter(F.col("m") > GROUP)
    trees = small.select("key", "frag", "least", "words").repartition("key").sortWithinPartitions("key").mapInArrow(_trees, TREE)
    trees = trees.select("frag", F.lit(0).cast("long").alias("more"), "least_at")
    if split:
        mid = (lo + hi) // 2
        halves = written(over.select(F.col("frag").alias("parent"), F.lit(0).cast("long").alias("shift"), "far", "near", "least", "words").mapInArrow(_halves(lo, hi), PART), "op5-halves")
        for a, z in ((lo, mid), (mid + 1, hi)):
            own = halves.filter((F.col("near") >= a) & (F.col("far") <= z))
            trees = trees.unionByName(_least_of_windows(own, a, z).selectExpr("parent AS frag", "shift AS more", "least_at"))
    links = parts.select("parent", "shift", "frag")
    counts = links.groupBy("frag").agg(F.count(F.lit(1)).alias("n"))
    found = written(trees.join(counts, "frag"), "op5-trees")
    # A fragment that was split has several rows here, so the hot side is looked up for each part.
    hot = max(1000, links.count() // 1000)
    packed = found.groupBy("frag", "n").agg(F.collect_list(F.struct("more", "least_at")).alias("parts"))
    out = hot_safe_lookup(links, packed, "frag", "n", hot * 1000)
    return out.select("parent", "shift", F.explode("parts").alias("p")).select("parent", (F.col("shift") + F.col("p.more")).alias("shift"), F.col("p.least_at").alias("least_at"))


RANGE = "doc_id long, tk long, begin long, stop long"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges [begin, stop) of covered windows, from (doc_id, tk, first start, smallest doc_id of each window)."""
    for b in batches:
        rows = []
        for doc_id, tk, s0, least_at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            hit = np.flatnonzero(np.frombuffer(least_at, np.int64) < doc_id)
            for run in np.split(hit, np.flatnonzero(np.diff(hit) >= SIZE) + 1) if len(hit) else ():
                rows.append((doc_id, tk, s0 + int(run[0]), s0 + int(run[-1]) + SIZE))
        yield _rows_batch(rows, RANGE)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches, 2):
        rows = []
        for doc_id, tk, text, begins, stops in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            tokens = text.encode().split()
            change = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(change, begins, 1)
            np.add.at(change, stops, -1)
            gone = np.cumsum(change[:-1]) > 0
            left = b" ".join(t for t, g in zip(tokens, gone.tolist(), strict=True) if not g)
            rows.append((doc_id, tk, int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()))
        yield _rows_batch(rows, KEPT)


KEPT = "doc_id long, tk long, n_gone long, left_sha string, left string"


def covered_ranges(texts: DataFrame, profile: DataFrame) -> DataFrame:
    """(doc_id, tk, begins, stops): covered word ranges of the documents in ``profile``."""
    anchors = profile.select("doc_id", "tk", F.posexplode("prefixes").alias("place", "prefix"))
    prefixes = anchors.groupBy("prefix").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count(F.lit(1)).alias("n")).filter("_a < _b").select("prefix", "n")
    total = profile.agg(F.sum(F.size("prefixes"))).first()[0] or 0
    repeated = hot_safe_lookup(anchors, prefixes, "prefix", "n", total)
    chosen = repeated.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set("place")).alias("chosen"))
    records = written(texts.join(chosen, ["doc_id", "tk"]).select("doc_id", "tk", "text", "chosen").mapInArrow(_fragments, FRAGMENT), "op5-records")
    parts = records.select(F.col("frag").alias("parent"), F.lit(0).cast("long").alias("shift"), "far", "near", "key", "frag", F.col("doc_id").alias("least"), "words")
    fragments = parts.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("shift", "far", "near", "key", "frag", "words")])
    fragments = written(fragments, "op5-distinct")
    windows = _least_of_windows(fragments.drop("n")).groupBy("parent").agg(F.collect_list(F.struct("shift", "least_at")).alias("parts"))
    windows = windows.join(fragments.select("parent", "n"), "parent").withColumnRenamed("parent", "frag")
    members = records.select("frag", "doc_id", "tk", "s0")
    found = hot_safe_lookup(members, windows, "frag", "n", members.count())
    starts = found.select("doc_id", "tk", "s0", F.explode("parts").alias("p")).select("doc_id", "tk", (F.col("s0") + F.col("p.shift")).alias("s0"), F.col("p.least_at").alias("least_at"))
    return starts.mapInArrow(_covered, RANGE).groupBy("doc_id", "tk").agg(F.collect_list("begin").alias("begins"), F.collect_list("stop").alias("stops"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; ``kept`` is null where all words stay."""
    texts = _texts(docs)
    profile = written(texts.mapInArrow(_profile, "doc_id long, tk long, n_words long, sha string, prefixes array<long>"), "op5-profile")
    long_enough = profile.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= SIZE))
    firsts = written(long_enough.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "op5-firsts")
    total = profile.count()
    others = hot_safe_lookup(long_enough.select("doc_id", "tk", "n_words", "sha", "prefixes"), firsts, "sha", "n", total)
    ranges = covered_ranges(texts, others.filter("doc_id = least").drop("least"))
    changed = texts.join(ranges, ["doc_id", "tk"]).select("doc_id", "tk", "text", "begins", "stops").mapInArrow(_kept, KEPT).dropDuplicates(["doc_id", "tk"])
    copies = others.select("doc_id", "n_words", "tk", "sha", (F.col("doc_id") > F.col("least")).alias("copy"))
    short = profile.filter(F.col("doc_id").isNull() | (F.col("n_words") < SIZE)).select("doc_id", "n_words", "tk", "sha", F.lit(False).alias("copy"))
    rows = copies.unionByName(short).join(changed, ["doc_id", "tk"], "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(NOTHING)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("left")).alias("kept"),
    )


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
