"""Version ledger of episodes, and when maintenance is due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("observed", "corrected", "superseded", "hypothetical", "rejected")


def register(episodes: DataFrame) -> DataFrame:
    """(memory_id, version_id, status, confidence, authority, checksum) of first versions."""
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("status"))).cast("string"))
    return episodes.select(F.col("episode_id").alias("memory_id"), F.concat(F.col("episode_id").cast("string"), F.lit(":v1")).alias("version_id"), status.alias("status"), "confidence", "authority", "checksum")


def supersede(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ledger after corrections (old_id, new_id): old versions superseded with at most 0.25 confidence; new ones list what they replace."""
    replaced = corrections.groupBy(F.col("new_id").alias("memory_id")).agg(F.sort_array(F.collect_set("old_id")).alias("supersedes"))
    old = corrections.select(F.col("old_id").alias("memory_id")).distinct().withColumn("_old", F.lit(True))
    joined = ledger.join(replaced, "memory_id", "left").join(old, "memory_id", "left")
    gone = F.col("_old").isNotNull()
    joined = joined.withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).withColumn("confidence", F.when(gone, F.least("confidence", F.lit(0.25))).otherwise(F.col("confidence")))
    return joined.drop("_old")


def current(ledger: DataFrame, order: str = "version_id") -> DataFrame:
    """The last version of each memory."""
    return ledger.withColumn("_r", F.row_number().over(W.partitionBy("memory_id").orderBy(F.col(order).desc()))).filter("_r = 1").drop("_r")


def consolidation_due(enabled: bool, count: int, cap: int | None) -> bool:
    """The first engine consolidates only where it is enabled and the episode cap is exceeded; a byte cap alone never does."""
    return bool(enabled and cap is not None and count > cap)


def eviction_due(count: int, cap: int | None, size: int | None = None, byte_cap: int | None = None, engine: int = 1) -> bool:
    """The second engine knows the episode cap only."""
    over = cap is not None and count > cap
    return over if engine == 2 else over or (byte_cap is not None and size is not None and size > byte_cap)
