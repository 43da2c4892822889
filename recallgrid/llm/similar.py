"""Near-duplicates by the Jaccard similarity of their shingle sets, each link verified exactly.

Documents with equal sets of five-word shingles are one class (sets are told apart by a
64-bit hash). Two methods propose. SimHash with deletion variants (``simhash.py``) gives
every pair of classes whose 64-bit fingerprints, of the sets, differ in 3 bits or fewer.
Pairs at 0.8 differ in more, so MinHash bands propose as well: the classes of a band's
bucket are joined to its smallest one. The connected parts of all proposals hold every
pair that either names. Then the texts of each part come together and all its pairs are compared on their
whole sets; links are pairs with a similarity of 4/5 or more and nothing else, and a group
is a connected component of links. A pair with a similarity of s shares no bucket with
probability (1 - s ** ROWS) ** BANDS: 1.5e-4 at 0.8, below 1e-12 from 0.9 on.

A part with more than TILE shingles is cut into pieces, and every two pieces meet in a
task, so a task holds about two pieces whatever the size of a part; a part in k pieces
is sent k times. Within a task a class whose part is already joined is compared no more.

Edge cases: null and blank texts are one class of their own and link to no other; fewer
words than a shingle make one shingle of all words; rows that share a doc_id are told
apart by a hash of their text; rows without a doc_id all stay; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_safe_lookup, release_memory, text_batches, written
from .components import connected_components, spanning

#: Shingles of a part that are compared in one task.
TILE = 1 << 20
#: Shingles whose MinHash values are computed at a time.
CHUNK = 1 << 11


@dataclass(frozen=True)
class Similar:
    """Shingle width, least similarity as a fraction, bands and rows a band."""

    shingle: int
    least: tuple[int, int]
    bands: int
    rows: int


SIMILAR = Similar(5, (4, 5), 48, 8)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased, joined by spaces."""
    tokens = text.encode().lower().split()  # bytes: splits at space and 0x09-0x0D only, lowers A-Z only
    if not tokens:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.array([[xxhash.xxh32_intdigest(b"minhash", 2 * k + j) for j in range(2)] for k in range(n)], np.uint32)
    return made[:, :1] | np.uint32(1), made[:, 1:]


def band_keys(shingles: np.ndarray, plan: Similar) -> np.ndarray:
    """The bucket of each band; an empty set is in none."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    times, plus = _TABLES.setdefault(plan, _multipliers(plan.bands * plan.rows))
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), CHUNK):
        np.minimum(least, (x[None, k : k + CHUNK] * times + plus).min(axis=1), out=least)
    raw, size = least.astype("<u4").tobytes(), 4 * plan.rows
    return np.array([xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(plan.bands)], np.uint64)


_TABLES: dict[Similar, tuple[np.ndarray, np.ndarray]] = {}


def _sets(plan: Similar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .simhash import majority  # which imports this module

        for b in text_batches(batches, 2):
            cls, size, bands, lo = [], [], [], []
            for text in b.column(2).to_pylist():
                own = np.unique(shingle_hashes(text, plan.shingle))
                cls.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), 1))
                size.append(len(own))
                lo.append(majority(own))
                bands.append(band_keys(own, plan).astype("<u8").tobytes())
            made = [pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(bands, pa.binary()), pa.array(np.array(lo, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "tk", "cls", "size", "bands", "lo"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [np.frombuffer(raw, "<i8") for raw in b.column(1).to_pylist()]
        cls = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *keys])), pa.array(cls)], names=["key", "cls"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class of a bucket with the bucket's smallest; rows come sorted by key and class."""
    last = None
    for b in batches:
        key, cls = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(key):
            continue
        new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        least = np.where(begin >= 0, cls[begin], last[1] if last else 0)
        last = (key[-1], least[-1])
        found = cls != least
        yield pa.RecordBatch.from_arrays([pa.array(cls[found]), pa.array(least[found])], names=["a", "b"])


def similar_links(sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of pairs with the least similarity that span each connected part, found breadth first; exact."""
    size = np.array([len(s) for s in sets])
    token, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    count = np.bincount(code, minlength=len(token))
    first = np.cumsum(count) - count
    begin = np.cumsum(size) - size
    open_, links, waiting = np.ones(len(sets), bool), [], []
    n_open, at, (p, q) = len(sets), 0, least
    while n_open:
        if not waiting:
            while not open_[at]:
                at += 1
            waiting, open_[at], n_open = [at], False, n_open - 1
        u = waiting.pop()
        own = code[begin[u] : begin[u] + size[u]]
        n = count[own]
        places = np.repeat(first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[places], minlength=len(sets))
        found = np.flatnonzero(open_ & ((p + q) * both >= p * (size + size[u]))).tolist()  # both / (size + size[u] - both) >= p / q
        links += [(u, v) for v in found]
        waiting += found
        open_[found] = False
        n_open -= len(found)
    return links


def _exact(plan: Similar):
    """(class, smallest class of its part) by the links within each tile; rows (root, i, j, cls, text) come sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, cls, sets = None, [], []

        def whole() -> list[tuple[int, int]]:
            return spanning((cls[u], cls[v]) for u, v in similar_links(sets, plan.least)) if len(sets) > 1 else []

        def batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            made = np.array(rows, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], names=["a", "b"])

        for b in batches:
            rows = []
            for k in range(b.num_rows):
                now = tuple(b.column(c)[k].as_py() for c in range(3))
                if now != tile:
                    rows += whole()
                    tile, cls, sets = now, [], []
                cls.append(b.column(3)[k].as_py())
                sets.append(np.unique(shingle_hashes(b.column(4)[k].as_py(), plan.shingle)))
            yield batch(rows)
        yield batch(whole())
        sets.clear()
        release_memory()

    return run


def _tiles(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, tk, cls, root, i, j): the tiles that each class of a proposed part is sent to."""
    members = roots.unionByName(roots.selectExpr("root AS node", "root").distinct())
    members = written(members.join(classes.select(F.col("cls").alias("node"), "size", "doc_id", "tk"), "node"), "similar-members")
    parts = members.groupBy("root").agg(F.sum("size").alias("shingles"), F.count(F.lit(1)).alias("n"))
    parts = written(parts.select("root", F.ceil(F.col("shingles") / TILE).cast("int").alias("k"), "n"), "similar-parts")
    placed = hot_safe_lookup(members, parts, "root", "n", members.count(), most=parts.agg(F.max("n")).first()[0] or 0).withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return each.select("doc_id", "tk", F.col("node").alias("cls"), "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text")).filter("doc_id IS NOT NULL")


def similar_groups(docs: DataFrame, plan: Similar = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, cls) of every row with a doc_id, and (cls, doc_id, tk, grp) of every class with its least row."""
    from .simhash import print_proposals  # which imports this module

    rows = _keyed(docs)
    prints = written(rows.mapInArrow(_sets(plan), "doc_id long, tk long, cls long, size long, bands binary, lo long"), "similar")
    classes = prints.groupBy("cls").agg(F.min(F.struct("doc_id", "tk")).alias("r"), *[F.first(c).alias(c) for c in ("size", "bands", "lo")])
    classes = written(classes.select("cls", "r.doc_id", "r.tk", "size", "bands", "lo"), "similar-classes")
    index = classes.select("cls", "bands").mapInArrow(_index, "key long, cls long")
    stars = index.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_stars, "a long, b long").distinct()
    near = written(print_proposals(classes.filter("size > 0")), "similar-prints")
    tiles = _tiles(classes, connected_components(near.unionByName(stars)))
    # Equal rows of a doc_id have one text.
    texts = rows.join(tiles.select("doc_id", "tk").distinct(), ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"])
    sent = tiles.join(texts, ["doc_id", "tk"]).select("root", "i", "j", "cls", "text")
    links = written(sent.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_exact(plan), "a long, b long").distinct(), "similar-links")
    roots = connected_components(links)
    named = classes.join(roots, classes.cls == roots.node, "left").select("cls", "doc_id", "tk", F.coalesce("root", "cls").alias("grp"))
    return prints.select("doc_id", "tk", "cls"), named


def one_of_each(docs: DataFrame, plan: Similar = SIMILAR) -> DataFrame:
    """The documents, with all their columns, that have the smallest doc_id (then text hash) of their group.

    Of equal rows one stays; rows without a doc_id all stay.
    """
    rows, named = similar_groups(docs, plan)
    kept = named.groupBy("grp").agg(F.min(F.struct("doc_id", "tk")).alias("r")).select("r.doc_id", "r.tk")
    often = rows.groupBy("doc_id", "tk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = written(kept.join(often, ["doc_id", "tk"], "left").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), F.coalesce("n", F.lit(1)).alias("_n")), "similar-kept")
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_tk"))
    found = docs.filter("doc_id IS NOT NULL").join(kept, same)
    single = found.filter("_n = 1")
    if not kept.filter("_n > 1").isEmpty():
        order = W.partitionBy("_id", "_tk").orderBy(F.to_json(F.struct(*docs.columns)))
        single = single.unionByName(found.filter("_n > 1").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r"))
    return single.drop("_id", "_tk", "_n").unionByName(docs.filter("doc_id IS NULL"))
