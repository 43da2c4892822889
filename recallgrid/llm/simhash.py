"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint is cut into so few segments that, within the allowed distance, some
segment of two fingerprints differs in at most one bit. Each segment is indexed once
per bit with that bit deleted (a wildcard); fingerprints that agree on a variant meet by
an equality exchange and are verified on all their bits. ``contract`` parameters: 64
bits, 3-word shingles, two segments of 32 bits, at most 3 differing bits (3 // 2 = 1,
so no pair is missed).

Documents with the same fingerprint are one class. Within a bucket only a spanning
forest of its links is emitted, never all its pairs. A bucket of more than BUCKET
fingerprints is dealt out again by variants of its remaining bits, with the same
guarantee; for the contract parameters the second buckets hold at most 2**18 distinct
fingerprints, as 46 of 64 bits are then fixed.

Edge cases: null and blank texts have the fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle of all words; repeated doc_ids are
rows of their own; a row with a null doc_id gets a fingerprint but a null component and
links nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_safe_lookup, table, text_batches, written
from .components import connected_components
from .similar import SIMILAR, one_of_each, shingle_hashes  # noqa: F401

#: Fingerprints of a bucket that are compared in one go; larger buckets are dealt out again.
BUCKET = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


@dataclass(frozen=True)
class Plan:
    """Shingle width, bits (64 or 128), allowed distance, and the first bit and length of each segment."""

    shingle: int
    bits: int
    distance: int
    segments: tuple[tuple[int, int], ...]
    again: tuple[tuple[int, int], ...]  # segments, by their place among the bits outside the first one


#: Every pair within 3 of 64 bits meets: 3 // 2 = 1.
CONTRACT = Plan(3, 64, 3, ((0, 32), (32, 32)), ((0, 16), (16, 16)))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash from the first: the finalizer of the public SplitMix64 generator."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, plan: Plan) -> tuple[int, int]:
    """Upper and lower 64 bits; the upper ones are 0 for a 64-bit plan."""
    hashes = shingle_hashes(text, plan.shingle)
    return (0 if plan.bits == 64 else majority(_mixed(hashes))), majority(hashes)


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, hi, lo) of every row; one map-only pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            made = np.array([fingerprint(t, plan) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], names=["doc_id", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, hi long, lo long")


def _bits(hi: np.ndarray, lo: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at ``places`` of each fingerprint, packed into one integer."""
    out = np.zeros(len(lo), np.uint64)
    for k, p in enumerate(places.tolist()):
        word = lo if p < 64 else hi
        out |= ((word >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def _variants(hi: np.ndarray, lo: np.ndarray, segments: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the segment and deleted bit, remaining bits) for every one-wildcard variant."""
    n = 0
    for places in segments:
        value = _bits(hi, lo, places)
        for k in range(len(places)):
            yield n, value & ~np.uint64(1 << k)
            n += 1


def _index(plan: Plan):
    places = [np.arange(s, s + size) % plan.bits for s, size in plan.segments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = (b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            for n, rest in _variants(hi, lo, places):
                key = (np.uint64(n) << np.uint64(32)) | rest
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), b.column(1)], names=["key", "hi", "lo"])

    return run


def _index_again(plan: Plan):
    """Second keys of (key, hi, lo): variants of the bits outside the first key's segment."""
    owner = [s for s, (_, size) in enumerate(plan.segments) for _ in range(size)]
    rest = []
    for start, size in plan.segments:
        others = np.setdiff1d(np.arange(plan.bits), np.arange(start, start + size) % plan.bits)
        rest.append([others[np.arange(s, s + n) % len(others)] for s, n in plan.again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, hi, lo = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            segment = np.array(owner)[key >> 32] if len(key) else key
            for s in np.unique(segment).tolist():
                own = segment == s
                for n, value in _variants(hi[own].view(np.uint64), lo[own].view(np.uint64), rest[s]):
                    second = (np.uint64(n) << np.uint64(32)) | value
                    yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(second.view(np.int64)), pa.array(hi[own]), pa.array(lo[own])], names=["key", "second", "hi", "lo"])

    return run


def _forest(hi: np.ndarray, lo: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Places of linked pairs that span each connected part, found breadth first."""
    left, links = np.arange(1, len(lo)), []
    waiting = [0]
    while waiting or len(left):
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        u = waiting.pop()
        near = np.bitwise_count(lo[left] ^ lo[u]).astype(np.int16) + np.bitwise_count(hi[left] ^ hi[u]) <= distance
        found = left[near].tolist()
        links += [(u, v) for v in found]
        waiting += found
        left = left[~near]
    return links


class _Out:
    """Collects rows (kind, a1, a2, b1, b2); kind 0 is a link of two fingerprints, kind 1 a row of a large bucket."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def links(self, hi, lo, pairs: np.ndarray) -> None:
        a, b = pairs[:, 0], pairs[:, 1]
        self.parts.append(np.column_stack([np.zeros(len(a), np.int64), hi[a], lo[a], hi[b], lo[b]]))

    def large(self, key: int, hi, lo) -> None:
        none = np.zeros(len(lo), np.int64)
        self.parts.append(np.column_stack([none + 1, none + key, none, hi, lo]))

    def batch(self) -> pa.RecordBatch:
        all_rows = np.concatenate(self.parts) if self.parts else np.empty((0, 5), np.int64)
        self.parts = []
        return pa.RecordBatch.from_arrays([pa.array(all_rows[:, k].copy()) for k in range(5)], names=["kind", "a1", "a2", "b1", "b2"])


def _compare(distance: int, n_keys: int, limit: int | None):
    """Streams rows sorted by key; a bucket over ``limit`` is passed on instead of compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, large_key = _Out(), None, None

        def whole(cols: list[np.ndarray]) -> None:
            """All buckets in ``cols`` are complete."""
            key, hi, lo = cols[0], cols[-2], cols[-1]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:n_keys]], axis=0)) + 1
            starts = np.concatenate([[0], cut])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            two = starts[sizes == 2]
            near = np.bitwise_count((hi[two] ^ hi[two + 1]).view(np.uint64)).astype(np.int16) + np.bitwise_count((lo[two] ^ lo[two + 1]).view(np.uint64)) <= distance
            if near.any():
                out.links(hi, lo, np.column_stack([two[near], two[near] + 1]))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if limit is not None and n > limit:
                    out.large(int(key[s]), hi[s : s + n], lo[s : s + n])
                elif pairs := _forest(hi[s : s + n].view(np.uint64), lo[s : s + n].view(np.uint64), distance):
                    out.links(hi[s : s + n], lo[s : s + n], np.array(pairs))

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys + 2)]
            if large_key is not None:  # the bucket that is being passed on goes on
                more = int(np.searchsorted(cols[0], large_key, side="right"))
                out.large(large_key, cols[-2][:more], cols[-1][:more])
                cols = [c[more:] for c in cols]
                if len(cols[0]):
                    large_key = None
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
                held = None
            if len(cols[0]):
                last = np.flatnonzero(np.any([c != c[-1] for c in cols[:n_keys]], axis=0))
                end = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
                if end:
                    whole([c[:end] for c in cols])
                held = [c[end:] for c in cols]
                if limit is not None and len(held[0]) > limit:
                    large_key = int(held[0][0])
                    out.large(large_key, held[-2], held[-1])
                    held = None
            yield out.batch()
        if held is not None:
            whole(held)
        yield out.batch()

    return run


ROWS = "kind long, a1 long, a2 long, b1 long, b2 long"


def fingerprint_links(classes: DataFrame, plan: Plan) -> DataFrame:
    """Links (a1, a2, b1, b2) between distinct fingerprints (hi, lo) that keep every connected part connected."""
    index = classes.select("hi", "lo").mapInArrow(_index(plan), "key long, hi long, lo long")
    first = written(index.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(plan.distance, 1, BUCKET), ROWS), "simhash-links")
    near = first.filter("kind = 0").drop("kind")
    if first.filter("kind = 1").isEmpty():
        return near.distinct()
    again = first.filter("kind = 1").selectExpr("a1 AS key", "b1 AS hi", "b2 AS lo").mapInArrow(_index_again(plan), "key long, second long, hi long, lo long")
    second = again.repartition("key", "second").sortWithinPartitions("key", "second").mapInArrow(_compare(plan.distance, 2, None), ROWS)
    return near.unionByName(second.filter("kind = 0").drop("kind")).distinct()


def print_proposals(classes: DataFrame, plan: Plan = CONTRACT) -> DataFrame:
    """(a, b) pairs of classes (cls, lo) that keep those connected whose fingerprints differ in ``plan.distance`` bits or fewer."""
    prints = written(classes.groupBy("lo").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("n")), "print-classes")
    links = fingerprint_links(prints.select(F.lit(0).cast("long").alias("hi"), "lo"), plan)
    end = lambda p: prints.select(F.col("lo").alias(f"{p}2"), F.col("least").alias(p))
    same = hot_safe_lookup(classes.select("cls", "lo"), prints, "lo", "n", classes.count(), most=prints.agg(F.max("n")).first()[0] or 0).filter("cls <> least")
    return links.join(end("a"), "a2").join(end("b"), "b2").select("a", "b").unionByName(same.selectExpr("cls AS a", "least AS b"))


def simhash_components(docs: DataFrame, plan: Plan = CONTRACT) -> DataFrame:
    """(doc_id, hi, lo, component_id) of every row of (doc_id, text)."""
    prints = written(fingerprints(docs, plan), "simhash")
    known = prints.filter("doc_id IS NOT NULL")
    total = known.count()
    classes = written(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    links = fingerprint_links(classes, plan)
    # Nodes of the graph are the classes' smallest doc_ids; a class has few links, its own forest's.
    end = lambda p: classes.select(F.col("hi").alias(f"{p}1"), F.col("lo").alias(f"{p}2"), F.col("least").alias(p))
    pairs = links.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).select("a", "b")
    roots = connected_components(pairs)
    named = classes.join(roots, classes.least == roots.node, "left").select(F.struct("hi", "lo").alias("fp"), "n", F.coalesce("root", "least").alias("component_id"))
    rows = known.select("doc_id", F.struct("hi", "lo").alias("fp"))
    found = hot_safe_lookup(rows, named, "fp", "n", total).select("doc_id", "fp.hi", "fp.lo", "component_id")
    return found.unionByName(prints.filter("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("lo")), 16, "0").alias("fingerprint"), "component_id")
