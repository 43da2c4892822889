"""Products of sparse vectors by tiles.

The rows of a group are dealt into blocks of bounded size by a hash of their id; each block
of one side meets each block of the other in a task of its own, where products are made as
matrices. Pairs are chosen there and never shuffled, but for the few a row keeps of a tile
where only its best are asked for. Nothing is left out. The work grows with the product of
both sides' rows, what moves with that product over the rows of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from recallgrid.functions.lineage import settle
from recallgrid.functions.vectors import quantize

#: Rows of a block: where a row keeps a few pairs of a tile, and where it may keep them all.
ROWS, ROWS_ALL = 8192, 2048
#: So many times the rows a block of the right has where few features are in use and a row of the left keeps a few pairs;
#: the left, whose rows are the longer ones, is then sent less often.
BROAD = 8
#: Features of a matrix and pairs of rows that are held at once.
WIDE, HELD = 1024, 1 << 22
#: Partitions that tiles are dealt into at most.
PARTS = 4096


def packed(vectors: dict[str, DataFrame], keys: list[str], value: str = "w", marks: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., features, an array for each name): rows (keys..., feature, value) of several vectors, one row an id.

    An array of ``marks`` holds 1 where its vector has an entry, of whatever value.
    """
    every = None
    for name, df in vectors.items():
        one = [(F.lit(1.0) if n in marks else F.col(value)) if n == name else F.lit(0.0) for n in vectors]
        rows = df.select(*keys, "feature", *[c.cast("float" if n in marks else "double").alias(n) for c, n in zip(one, vectors, strict=True)])
        every = rows if every is None else every.unionByName(rows)
    summed = every.repartition(*keys).groupBy(*keys, "feature").agg(*[(F.max(n) if n in marks else F.sum(n)).alias(n) for n in vectors])
    lists = summed.groupBy(*keys).agg(F.collect_list(F.struct("feature", *vectors)).alias("_e"))
    return lists.select(*keys, F.col("_e.feature").alias("features"), *[F.col(f"_e.{n}").alias(n) for n in vectors])


class _Side:
    """The rows of a block with the places of their entries among the features that both sides have."""

    def __init__(self, table: pa.Table, common: np.ndarray, names: set[str]):
        lists = table["features"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        features = lists.flatten().to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(common, features), max(len(common) - 1, 0))
        known = common[place] == features if len(common) else np.zeros(len(features), bool)
        self.n, self.row, self.place = len(table), np.repeat(np.arange(len(table)), lengths)[known], place[known]
        self.values = {n: table[n].combine_chunks().flatten().to_numpy(zero_copy_only=False)[known] for n in names}

    def matrix(self, name: str, lo: int, hi: int, first: int, last: int) -> np.ndarray:
        """Rows lo to hi over the common features first to last."""
        a, b = np.searchsorted(self.row, (lo, hi))
        place = self.place[a:b]
        at = (place >= first) & (place < last)
        out = np.zeros((hi - lo, last - first), self.values[name].dtype)
        out[self.row[a:b][at] - lo, place[at] - first] = self.values[name][a:b][at]
        return out


def _unique(table: pa.Table) -> np.ndarray:
    return np.unique(table["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False))


def largest(key: np.ndarray, ok: np.ndarray, limit: int) -> np.ndarray:
    """Where the ``limit`` largest keys of each row stand among those that are ok, ties to the first."""
    n = key.shape[1]
    if limit >= n:
        return ok
    key = np.where(ok, key, -np.inf)
    least = np.partition(key, n - limit, axis=1)[:, n - limit][:, None]
    above = key > least
    tied = (key == least) & ok
    return above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= limit - above.sum(axis=1, keepdims=True)))


def pairs(
    left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, products: dict[str, tuple[str, str]], present: str,
    by: str | None = None, limit: int | None = None, digits: int | None = None, least: float | None = None, floor: float | None = None, span: tuple[str, str, str] | None = None, half: bool = False, earliest: bool = False,
    also: tuple[str, str, int, float] | None = None,
) -> DataFrame:
    """(keys..., a, b, products...) of pairs of ``packed`` rows of a group with more than 0 of the product ``present``.

    ``products`` names a vector of each side. With ``limit`` a row of the left keeps so many,
    by the product ``by``, raised to ``floor`` and rounded to ``digits``, ties to the smaller b. ``least`` is a bound of
    ``by``. ``span`` names a time of the left and two of the right, of which the first must be
    earlier and the second not, or null. ``earliest`` keeps the smallest b instead of the best. With ``half`` both sides are the same rows, and pairs have a < b.
    ``also`` (present, by, digits, floor) is another choice of ``limit`` pairs, without span or bound: what either
    chooses in a tile leaves it once, and the caller ranks it.
    """
    by = by or present
    rows = ROWS if limit is not None else ROWS_ALL
    groups = keys or ["_all"]
    if not keys:
        left, right = left.withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0))
    count = lambda df, name, n=rows: df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    broad = rows
    if limit is not None:  # so that a matrix of the right is no larger than one of ROWS rows and WIDE features
        wide = right.select(F.explode("features").alias("f")).agg(F.approx_count_distinct("f")).first()[0] or 1
        broad = rows * max(1, min(BROAD, WIDE // (wide + wide // 4)))
    sizes = settle(count(left, "_m").join(count(right, "_n", broad), groups), "blocks")
    tiles, most = sizes.agg(F.sum(F.col("_m") * F.col("_n")), F.max("_n")).first()
    tiles = tiles or 0
    parts = max(1, min(PARTS, int(tiles)))
    block = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
    every = lambda first, n: F.explode(F.sequence(first, F.col(n) - 1))
    if half:  # the rows of block i go to the tiles (i, j) with i <= j on the left, (j, i) with j <= i on the right
        ours = left.join(sizes, groups).withColumn("_i", block(a, "_n")).withColumn("_j", every(F.col("_i"), "_n"))
        theirs = right.join(sizes, groups).withColumn("_j", block(b, "_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
    else:
        ours = left.join(sizes, groups).withColumn("_i", block(a, "_m")).withColumn("_j", every(F.lit(0), "_n"))
        theirs = right.join(sizes, groups).withColumn("_j", block(b, "_n")).withColumn("_i", every(F.lit(0), "_m"))
    where = [*groups, "_i", "_j"]
    kinds = {c: left.schema[c].dataType for c in [*keys, a]} | {b: right.schema[b].dataType}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [T.StructField(n, T.DoubleType()) for n in products])
    names = [{p[side] for p in products.values()} for side in (0, 1)]
    outs = [*kinds, *products]

    def chosen(x: pa.Table, y: pa.Table) -> Iterator[pa.Table]:
        common = np.intersect1d(_unique(x), _unique(y))
        p, q = _Side(x, common, names[0]), _Side(y, common, names[1])
        slices = [(f, min(f + WIDE, len(common))) for f in range(0, len(common), WIDE)]
        known = {(n, s): q.matrix(n, 0, q.n, *s) for n in names[1] for s in slices} if len(slices) == 1 else {}
        right_of = lambda n, s: known[n, s] if known else q.matrix(n, 0, q.n, *s)
        inner = half and x["_i"][0] == x["_j"][0]
        ids = (x[a].to_numpy(), y[b].to_numpy()) if half else None
        if span:
            at, after = x[span[0]].to_numpy(), y[span[1]].to_numpy()
            until = np.array([np.inf if u is None else u for u in y[span[2]].to_pylist()])
        step = max(1, HELD // max(q.n, WIDE))
        for lo in range(0, p.n, step):
            hi = min(lo + step, p.n)
            full = lambda name: sum((p.matrix(products[name][0], lo, hi, *s) @ right_of(products[name][1], s).T for s in slices), np.zeros((hi - lo, q.n), np.float32))  # noqa: E731, B023
            ok = full(present)
            value = ok if by == present else full(by)
            ok = ok > 0
            if span:
                ok &= (after[None, :] < at[lo:hi, None]) & (at[lo:hi, None] <= until[None, :])
            if least is not None:
                ok &= value >= least
            if inner:
                ok &= ids[0][lo:hi, None] < ids[1][None, :]
            if limit is not None:
                rank = np.zeros_like(value) if earliest else value
                key = rank if floor is None else np.maximum(rank, floor)
                ok = largest(key if digits is None else np.floor(key * 10.0**digits + 0.5), ok, limit)
            if also:
                key = np.maximum(full(also[1]), also[3])
                ok |= largest(np.floor(key * 10.0 ** also[2] + 0.5), full(also[0]) > 0, limit)
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            made = {}
            for name, (mine, yours) in products.items():
                if name == by:
                    made[name] = value[r, c].astype(float)
                    continue
                made[name] = np.zeros(len(r))
                for s in slices:
                    m, t = p.matrix(mine, lo, hi, *s), right_of(yours, s)
                    for k in range(0, len(r), 8192):
                        made[name][k : k + 8192] += np.einsum("ij,ij->i", m[r[k : k + 8192]], t[c[k : k + 8192]])
            first, second = x[a].take(pa.array(r + lo)), y[b].take(pa.array(c))
            if half and not inner:
                swap = ids[0][r + lo] > ids[1][c]
                first, second = pa.array(np.where(swap, ids[1][c], ids[0][r + lo])), pa.array(np.where(swap, ids[0][r + lo], ids[1][c]))
            same = pa.array(np.zeros(len(r), np.int64))
            yield pa.table([*[x[k].take(same) for k in keys], first, second, *[pa.array(v) for v in made.values()]], names=outs)

    form = to_arrow_schema(schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return form.empty_table()
        y = y.sort_by([(b, "ascending")])
        found = list(chosen(x, y))
        return pa.concat_tables(found) if found else form.empty_table()

    # Aliases, as a cogroup of tables with a common ancestor takes their columns for the same.
    dealt = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns if c not in ("_m", "_n")]).repartition(parts, *where).groupBy(*where)
    made = dealt(ours).cogroup(dealt(theirs)).applyInArrow(run, schema)
    if limit is None or also or (most or 0) <= 1:  # a row of the left has met all of the right in one tile
        return made
    key = F.col(by) if floor is None else F.greatest(by, F.lit(floor))
    order = W.partitionBy(*keys, a).orderBy(b) if earliest else W.partitionBy(*keys, a).orderBy((key if digits is None else quantize(key, digits)).desc(), b)
    return made.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")
