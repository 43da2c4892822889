"""Resampling statistics; groups are metrics of a run, a value per example."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle

from .metrics import repeated

INTERVAL = "estimate double, lower double, upper double, level double, samples int"


# How many resamples are drawn at a time, which decides the order of the random numbers.
MEAN_DRAWS, SIGN_DRAWS = 512, 1024


#: Numbers that are held at once; a portion is drawn by rows, which takes the same numbers from the stream as at once.
HELD = 1 << 20


def _rows(m: int, n: int) -> list[int]:
    """``m`` draws of ``n`` numbers, as many at a time as ``HELD`` holds."""
    return _portions(m, max(1, HELD // max(n, 1)))


def _portions(samples: int, size: int) -> list[int]:
    return [size] * (samples // size) + ([samples % size] if samples % size else [])


def _interval(estimate: float, means: np.ndarray, level: float, samples: int) -> tuple:
    tail = (1 - level) / 2
    return estimate, float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail)), level, samples


def _means(n: int, samples: int, seed: int, mean) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([mean(rng.integers(0, n, size=(r, n))) for m in _portions(samples, MEAN_DRAWS) for r in _rows(m, n)])


def bootstrap(values: np.ndarray, samples: int = 10_000, level: float = 0.95, seed: int = 0) -> tuple:
    """Mean with a percentile interval; non-finite values are left out, nothing left gives nulls."""
    if samples <= 0:
        raise ValueError("samples must be positive")
    clean = values[np.isfinite(values)]
    if not len(clean):
        return None, None, None, level, samples
    return _interval(float(clean.mean()), _means(len(clean), samples, seed, lambda i: clean[i].mean(axis=1)), level, samples)


def cluster_bootstrap(sums: np.ndarray, counts: np.ndarray, samples: int = 10_000, level: float = 0.95, seed: int = 0) -> tuple:
    if samples <= 0:
        raise ValueError("samples must be positive")
    if not len(sums):
        return None, None, None, level, samples
    means = _means(len(sums), samples, seed, lambda i: sums[i].sum(axis=1) / counts[i].sum(axis=1))
    return _interval(float(sums.sum() / counts.sum()), means, level, samples)


def randomization_p(differences: np.ndarray, samples: int = 100_000, seed: int = 0) -> float | None:
    """Two-sided p-value of a mean difference under random signs."""
    finite = differences[np.isfinite(differences)]
    if finite.size == 0:
        return None
    rng = np.random.default_rng(seed)

    def as_far(m: int) -> int:
        """Of m random sign patterns, those whose mean is at least as far from 0 as the one seen."""
        flipped = rng.choice([-1.0, 1.0], size=(m, finite.size))
        flipped *= finite
        return int(np.count_nonzero(np.abs(flipped.mean(axis=1)) >= abs(finite.mean())))

    return (1 + sum(as_far(r) for m in _portions(samples, SIGN_DRAWS) for r in _rows(m, finite.size))) / (1 + samples)


def bootstrap_ci(df: DataFrame, group: str, value: str, order: str, samples: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(group, INTERVAL); values are taken in ``order``, so that the draw is reproducible."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        values = p.sort_values("_o", kind="stable")["_v"].to_numpy(float)
        return pd.DataFrame([(key[0], *bootstrap(values, samples, level, seed))], columns=["g", "estimate", "lower", "upper", "level", "samples"])

    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("_v"), F.col(order).alias("_o"))
    return rows.groupBy("g").applyInPandas(run, f"g {kind}, {INTERVAL}").withColumnRenamed("g", group)


def cluster_bootstrap_ci(df: DataFrame, group: str, cluster: str, value: str, samples: int = 10_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """As ``bootstrap_ci``, resampling clusters, which are summed up before they leave their task."""
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = finite.groupBy(F.col(group).alias("g"), F.col(cluster).alias("_c")).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_n"))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_c", kind="stable")
        made = cluster_bootstrap(p["_s"].to_numpy(float), p["_n"].to_numpy(float), samples, level, seed)
        return pd.DataFrame([(key[0], *made)], columns=["g", "estimate", "lower", "upper", "level", "samples"])

    kind = df.schema[group].dataType.simpleString()
    return sums.groupBy("g").applyInPandas(run, f"g {kind}, {INTERVAL}").withColumnRenamed("g", group)


def randomization(df: DataFrame, group: str, difference: str, order: str, samples: int = 100_000, seed: int = 0) -> DataFrame:
    """(group, p_value) of paired differences."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], randomization_p(p.sort_values("_o", kind="stable")["_v"].to_numpy(float), samples, seed))], columns=["g", "p_value"])

    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), F.col(difference).cast("double").alias("_v"), F.col(order).alias("_o"))
    return rows.groupBy("g").applyInPandas(run, f"g {kind}, p_value double").withColumnRenamed("g", group)


def comparison(baseline: DataFrame, treatment: DataFrame, metrics: list[str], key: str = "example_id", samples: int = 10_000, signs: int = 100_000, level: float = 0.95, seed: int = 0, listed: int = 20) -> DataFrame:
    """A row per metric that compares two runs example by example.

    Gives how many examples have the metric on each side and on both, the first ``listed``
    keys of those on one side only, the mean of treatment minus baseline with its bootstrap
    interval, and the p-value of a randomization of signs. A null is a missing value; a
    repeated key fails, and so does a metric without a pair.
    """
    for name, df in (("baseline", baseline), ("treatment", treatment)):
        if repeated(df, key):
            raise ValueError(f"repeated {key} in {name}")
    long = lambda df, name: df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", name).filter(F.col(name).isNotNull())
    both = long(baseline, "baseline").join(long(treatment, "treatment"), ["metric", key], "full_outer")
    side = F.when(F.col("baseline").isNull(), "treatment").when(F.col("treatment").isNull(), "baseline").otherwise("both")
    pairs = settle(both.select("metric", key, side.alias("side"), (F.col("treatment") - F.col("baseline")).alias("difference")), "pairs")
    on = lambda *sides: F.count(F.when(F.col("side").isin(*sides), 1))
    counts = pairs.groupBy("metric").agg(on("baseline", "both").alias("baseline_examples"), on("treatment", "both").alias("treatment_examples"), on("both").alias("paired_examples"), on("baseline").alias("baseline_only"), on("treatment").alias("treatment_only"))
    paired = {r.metric for r in counts.filter("paired_examples > 0").select("metric").collect()}  # a row for each metric
    if alone := [m for m in metrics if m not in paired]:
        raise ValueError(f"no paired examples for {', '.join(alone)}")
    order = W.partitionBy("metric", "side").orderBy(key)
    first = pairs.filter("side <> 'both'").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= listed)
    ids = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col(key)))).alias(f"{name}_only_ids")
    missing = first.groupBy("metric").agg(ids("baseline"), ids("treatment"))
    good = pairs.filter("side = 'both'")
    out = counts.join(missing, "metric", "left").join(bootstrap_ci(good, "metric", "difference", key, samples, level, seed), "metric").join(randomization(good, "metric", "difference", key, signs, seed), "metric")
    none = F.array().cast(pairs.select(F.array(key).alias("a")).schema["a"].dataType)
    return out.withColumns({f"{s}_only_ids": F.coalesce(f"{s}_only_ids", none) for s in ("baseline", "treatment")})
