"""Running sums over groups of any size, by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settle


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Adds _before, the sum of ``value`` over the rows of the group before this one, and _total over all of it.

    ``order`` must be total within a group. Rows are dealt to ranges of (keys, order), so
    that a group of a third of all rows lies in many of them; the ranges' sums, at most as
    many as ranges and groups together, are added up first. The dealt rows are written,
    since a range must not change when a task runs again.
    """
    names = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(names, order, strict=True)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(placed.repartitionByRange(n, *keys, *names).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    group = W.partitionBy(*keys)
    offsets = sums.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(group).alias("_total"),
    )
    inner = W.partitionBy(*keys, "_range").orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    within = dealt.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_range"]]
    joined = within.alias("r").join(offsets.alias("o"), same)
    return joined.select("r.*", (F.col("_within") + F.col("_offset")).alias("_before"), "_total").drop(*names, "_range", "_within")
