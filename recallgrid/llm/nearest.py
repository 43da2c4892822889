"""Nearest neighbours by a block matrix join over int8 product tiles.

Vectors are packed into blocks. A block keeps each vector as int8 steps of its own scale,
with the exact norm of what rounding lost. A tile is one block of queries against one
block of all vectors: the integer product gives an approximate distance d', and the true
one lies within d' plus or minus the two rounding norms. Pairs whose lower bound exceeds
the k-th smallest upper bound of their query in the tile cannot be among its k nearest;
the pairs that survive are recomputed in double precision from the original vectors, and
per-tile results are merged by heaps. The result is exact.

Tiles come from an equality join on the number of the candidate block: query blocks are
copied once per candidate block, candidate blocks are sent once. Both kinds of block have
a greatest number of rows and a tile is computed in strips of queries, so a task holds one
strip at a time at any size of the table. Where squares of the largest component could
overflow or vanish, the bounds are taken on vectors scaled by a power of two, and so are
the distances that leave the range of doubles on the way.

Edge cases: vectors that are null, empty, zero or hold null or non-finite values take no
part; rows with a null id neither; vectors of different lengths are never compared; of
several rows with one id the one with the smallest vector (in array order) counts; ties
go to the smaller id; a query with fewer candidates than k gets them all; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Greatest number of rows of a candidate block, of a query block, and of the strips of queries in a tile.
BLOCK, QUERY_BLOCK, STRIP = 8192, 1024, 256
#: Binary exponents of components that may be squared and added as they are.
PLAIN = 400
PACKED = "number long, dim long, ids binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part, one per id."""
    v = F.col("embedding")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, vec_id, embedding), sorted by block and dimension."""
        key, ids, rows = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"number": pa.array([key[0]], pa.int64()), "dim": pa.array([key[1]], pa.int64()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([np.array(rows, np.float64).tobytes()], pa.binary())})

        for b in batches:
            for number, vec_id, vector in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if ids and (key != (number, len(vector)) or len(ids) >= size):
                    yield block()
                    ids, rows = [], []
                key = (number, len(vector))
                ids.append(vec_id)
                rows.append(vector)
        if ids:
            yield block()

    return run


def block_count(total: int, size: int) -> int:
    """Numbers of blocks that leave room for an uneven deal, so that few numbers need a second block."""
    return max(1, -(-total * 9 // (size * 8)))


def blocks(vectors: DataFrame, total: int, size: int) -> DataFrame:
    """Vectors in blocks of at most ``size`` rows, numbered below block_count; see PACKED."""
    n = block_count(total, size)
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("number"), "vec_id", "embedding")
    return dealt.repartition("number").sortWithinPartitions("number", F.size("embedding"), "vec_id").mapInArrow(_pack(size), PACKED)


class Int8Block:
    """Vectors as int8 steps of a scale of their own, and the norm of what rounding lost."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.exact = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.exponent = int(np.frexp(np.abs(self.exact).max())[1])
        self.down = None

    def scaled(self, down: int) -> Int8Block:
        """Sets the steps of the vectors divided by 2 ** ``down``."""
        if down == self.down:
            return self
        self.down, near = down, np.ldexp(self.exact, -down) if down else self.exact
        self.scale = np.abs(near).max(axis=1) / 127
        self.scale[self.scale < 1e-300] = 1.0  # magnitudes that underflow: all steps are 0 and all is lost to rounding
        self.steps = np.rint(near / self.scale[:, None]).astype(np.int8)
        kept = self.steps * self.scale[:, None]
        self.square = np.einsum("ij,ij->i", kept, kept)
        self.lost = np.sqrt(np.einsum("ij,ij->i", near - kept, near - kept))
        # 127 * 127 * dim must stay below 2**24 for single precision to hold the integers exactly.
        self.product_form = self.steps.astype(np.float32 if near.shape[1] <= 1000 else np.float64)
        return self


def distances(differences: np.ndarray) -> np.ndarray:
    """Euclidean norms of the rows; squares that overflow or vanish are taken of scaled rows."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((differences * differences).sum(axis=1))
        largest = np.abs(differences).max(axis=1)
        odd = np.flatnonzero(np.isfinite(largest) & (largest > 0) & ((largest > 2.0**PLAIN) | (largest < 2.0**-PLAIN)))
        if len(odd):
            power = np.frexp(largest[odd])[1]
            near = np.ldexp(differences[odd], -power[:, None])
            out[odd] = np.ldexp(np.sqrt((near * near).sum(axis=1)), power)
    return out


def tile(queries: Int8Block, others: Int8Block, k: int) -> Iterator[tuple[int, int, float]]:
    """(query, vector, distance) of the k nearest within the tile, ties by id, and nobody but them."""
    top = max(queries.exponent, others.exponent)
    down = top if abs(top) > PLAIN else 0
    queries, others = queries.scaled(down), others.scaled(down)
    for s in range(0, len(queries.ids), STRIP):
        ids, e = queries.ids[s : s + STRIP], slice(s, s + STRIP)
        product = (queries.product_form[e] @ others.product_form.T) * (queries.scale[e, None] * others.scale)
        about = np.sqrt(np.maximum(queries.square[e, None] + others.square - 2 * product, 0))
        # Room for rounding in the double arithmetic above, far wider than it can be.
        slack = queries.lost[e, None] + others.lost + 1e-6 * (np.sqrt(queries.square)[e, None] + np.sqrt(others.square)) + 1e-12
        low, high = about - slack, about + slack
        own = ids[:, None] == others.ids
        low[own] = high[own] = np.inf
        limit = np.partition(high, k - 1, axis=1)[:, k - 1 : k] if high.shape[1] > k else np.full((len(high), 1), np.inf)
        for q, c in _rows(np.argwhere((low <= limit) & ~own)):
            with np.errstate(over="ignore"):
                distance = distances(others.exact[c] - queries.exact[s + q])
            best = np.lexsort((others.ids[c], distance))[:k]
            yield from zip([int(ids[q])] * len(best), others.ids[c][best].tolist(), distance[best].tolist(), strict=True)


def _rows(pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Groups (row, columns) of argwhere's result."""
    if len(pairs):
        cut = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        for part in np.split(pairs, cut):
            yield int(part[0, 0]), part[:, 1]


FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    q, c, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, others = None, None
        for b in batches:
            for dim, q_ids, q_vectors, ids, vectors in zip(*(b.column(i) for i in range(5)), strict=True):
                if last is None or not ids.equals(last):
                    last, others = ids, Int8Block(ids.as_py(), vectors.as_py(), dim.as_py())
                yield _found(list(tile(Int8Block(q_ids.as_py(), q_vectors.as_py(), dim.as_py()), others, k)))

    return run


def _merge(k: int):
    """Streams rows sorted by query; a heap of at most k holds the query's nearest so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []  # the heap's top is the farthest: (-distance, -id)

        def close() -> list[tuple]:
            best = sorted((-d, -v) for d, v in heap)
            return [(now, r, v, d) for r, (d, v) in enumerate(best, 1)]

        for b in batches:
            done = []
            for q, v, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if q != now:
                    done += close()
                    now, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -v))
                else:
                    heapq.heappushpop(heap, (-d, -v))
            yield _ranked(done)
        yield _ranked(close())

    return run


RANKED = "query_id long, rank int, vec_id long, score double"


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    q, r, v, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest others, by Euclidean distance, of every row for which ``is_query`` holds; see RANKED."""
    good = written(usable(vectors), "vectors")
    total = good.count()
    queries = good.filter(is_query)
    left = blocks(queries, queries.count(), query_block)
    right = blocks(good, total, block).withColumnRenamed("ids", "c_ids").withColumnRenamed("vectors", "c_vectors")
    n = block_count(total, block)
    # Copies of a query block: one per number of a candidate block.
    copies = left.select("dim", "ids", "vectors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("number"))
    pairs = copies.join(right, ["number", "dim"])
    tiles = pairs.select("dim", "ids", "vectors", "c_ids", "c_vectors").mapInArrow(_tiles(k), FOUND)
    return tiles.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), RANKED)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
    WITH good AS (
        SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
            sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
        FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 10"""
