"""Turning conversations into events, and evidence bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions_to_events(turns: DataFrame) -> DataFrame:
    """One event per session: its turns as ``role: text`` lines."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    made = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("_t"), F.count(F.lit(1)).alias("n_turns"))
    return made.select("conv_id", F.array_join(F.transform("_t", lambda x: x["l"]), "\n").alias("text"), "n_turns")


def turns_to_events(turns: DataFrame) -> DataFrame:
    """One event per turn, numbered within its stream."""
    seq = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("conv_id").cast("string").alias("stream_id"), seq.alias("seq"), F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("text"))


def continual_probes(steps: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Adds the lag, which cycles over ``lags``, and the step whose fact is probed."""
    lag = F.element_at(F.array(*[F.lit(x) for x in lags]), (F.col("step") % len(lags) + 1).cast("int"))
    return steps.withColumn("lag", lag).withColumn("target_step", F.col("step") - F.least("step", F.col("lag").cast("long")))


def remap_evidence(evidence: DataFrame, chunks: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Evidence ids replaced by all their chunks' ids; an id without chunks passes through."""
    joined = evidence.join(chunks.select(old, new), old, "left")
    return joined.select(key, F.coalesce(F.col(new), F.col(old).cast("string")).alias("evidence_id"))
