"""Sparse vectors as structs of (dimension, indices, values), and as rows (id, feature, w).

The struct form keeps a vector in one row and needs no shuffle; the row form is for joins
and aggregations. Indices ascend and are unique. Ties in a top-k go to the smaller index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import bound

CODE = "struct<dimension:int,indices:array<int>,values:array<double>>"
EPS = 1e-12


def _pack(dimension: Column, items: Column) -> Column:
    """A code from an array of (i, v) structs in any order, which are sorted once."""
    code = lambda x: F.struct(x["n"].alias("dimension"), F.transform(x["o"], lambda e: e["i"]).alias("indices"), F.transform(x["o"], lambda e: e["v"]).alias("values"))
    return bound(F.struct(dimension.cast("int").alias("n"), F.array_sort(items).alias("o")), code)


def _items(code: Column) -> Column:
    return F.transform(F.arrays_zip(code["indices"].alias("i"), code["values"].alias("v")), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))


def _largest(items: Column, k: int) -> Column:
    """The k items of largest magnitude, ties to the smaller index."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct((-F.abs(x["v"])).alias("m"), x["i"].alias("i"), x["v"].alias("v"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))


def make_code(dimension: int, indices: Column, values: Column) -> Column:
    """A validated code: equal lengths, positive dimension, unique indices in range; else the query fails."""
    good = (F.size(indices) == F.size(values)) & (F.size(F.array_distinct(indices)) == F.size(indices)) & F.forall(indices, lambda i: (i >= 0) & (i < dimension)) & F.lit(dimension > 0)
    items = F.transform(F.arrays_zip(indices.alias("i"), values.alias("v")), lambda x: F.struct(x["i"].cast("int").alias("i"), x["v"].cast("double").alias("v")))
    return F.when(good, _pack(F.lit(dimension), items)).otherwise(F.raise_error(F.lit("invalid sparse code")).cast(CODE))


def empty_code(dimension: int) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))


def from_dense(vector: Column, k: int, positive_only: bool = False, normalize: bool = True, threshold: float = 0.0) -> Column:
    """The k entries of largest magnitude of a dense array, of those that reach the threshold."""
    items = F.transform(vector, lambda v, i: F.struct(i.alias("i"), (F.greatest(v.cast("double"), F.lit(0.0)) if positive_only else v.cast("double")).alias("v")))
    kept = F.filter(items, lambda x: (x["v"] != 0) & (F.abs(x["v"]) >= threshold))
    code = _pack(F.size(vector), _largest(kept, k))
    return normalized(code) if normalize else code


def from_map(dimension: int, entries: Column) -> Column:
    items = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].cast("double").alias("v")))
    return _pack(F.lit(dimension), F.filter(items, lambda x: x["v"] != 0))


def as_map(code: Column) -> Column:
    return F.map_from_arrays(code["indices"], code["values"])


def to_dense(code: Column) -> Column:
    m = as_map(code)
    return F.transform(F.sequence(F.lit(0), code["dimension"] - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def norm(code: Column) -> Column:
    return F.sqrt(F.aggregate(code["values"], F.lit(0.0), lambda a, v: a + v * v))


def scaled(code: Column, by: Column) -> Column:
    return F.struct(code["dimension"].alias("dimension"), code["indices"].alias("indices"), F.transform(code["values"], lambda v: v * by).alias("values"))


def normalized(code: Column, eps: float = EPS) -> Column:
    """Unit length; left alone where the norm is ``eps`` or less. Code and norm are computed once a row, not for each entry."""

    def divided(x: Column) -> Column:
        c, size = x["c"], x["n"]
        return F.struct(c["dimension"].alias("dimension"), c["indices"].alias("indices"), F.transform(c["values"], lambda v: F.when(size > eps, v / size).otherwise(v)).alias("values"))

    return bound(code, lambda c: bound(F.struct(c.alias("c"), norm(c).alias("n")), divided))


def topk(code: Column, k: int, positive_only: bool = False) -> Column:
    """The k largest magnitudes. A code with no more than k entries comes back as it is, negatives included."""
    items = F.filter(_items(code), lambda x: x["v"] > 0) if positive_only else _items(code)
    return F.when(F.size(code["indices"]) <= k, code).otherwise(_pack(code["dimension"], _largest(items, k)))


def dot(a: Column, b: Column) -> Column:
    m = as_map(b)
    terms = F.transform(_items(a), lambda x: x["v"] * F.coalesce(F.try_element_at(m, x["i"]), F.lit(0.0)))
    same = a["dimension"] == b["dimension"]
    return F.when(same, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)).otherwise(F.raise_error(F.lit("dimensions differ")).cast("double"))


def code_bytes(code: Column) -> Column:
    """12 bytes an entry: an index and a value."""
    return F.size(code["indices"]) * 12


def to_text(code: Column) -> Column:
    """The code as a JSON object of dimension, indices and values."""
    return F.to_json(code)


def from_text(text: Column) -> Column:
    return F.from_json(text, CODE)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["indices"], b["indices"]))


def rows(df: DataFrame, code: str, *keep: str) -> DataFrame:
    """One row (keep..., feature, w) per entry."""
    return df.select(*keep, F.inline(F.arrays_zip(F.col(code)["indices"].alias("feature"), F.col(code)["values"].alias("w"))))


# --- the row form ---------------------------------------------------------------------------


def rows_topk(df: DataFrame, keys: list[str], k: int, value: str = "w") -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.abs(value).desc(), "feature")
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def rows_normalized(df: DataFrame, keys: list[str], value: str = "w") -> DataFrame:
    size = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(*keys)))
    return df.withColumn(value, F.when(size > EPS, F.col(value) / size).otherwise(F.col(value)))


def quantize(value: Column, digits: int = 6) -> Column:
    """Rounds half up by plain arithmetic, which other engines repeat exactly."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
