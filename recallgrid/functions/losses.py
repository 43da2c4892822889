"""Loss values of codecs: row-wise ones as expressions, batch-wise ones per batch of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _paired(a: Column, b: Column, term) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: term(z["a"].cast("double"), z["b"].cast("double")))


def reconstruction(prediction: Column, target: Column, kind: str = "mse") -> Column:
    """An aggregate over rows of equal length: mean squared error, smooth L1, or one minus the mean cosine."""
    if kind == "mse":
        terms = _paired(prediction, target, lambda a, b: (a - b) * (a - b))
    elif kind == "smooth_l1":
        terms = _paired(prediction, target, lambda a, b: F.when(F.abs(a - b) < 1, 0.5 * (a - b) * (a - b)).otherwise(F.abs(a - b) - 0.5))
    elif kind == "cosine":
        length = lambda v: F.greatest(F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))), F.lit(1e-8))
        return 1 - F.avg(_sum(_paired(prediction, target, lambda a, b: a * b)) / (length(prediction) * length(target)))
    else:
        raise ValueError(f"unknown reconstruction loss: {kind}")
    return F.sum(_sum(terms)) / F.sum(F.size(prediction))


def _log_softmax(logits: Column, temperature: float) -> Column:
    x = F.transform(logits, lambda v: v.cast("double") / temperature)
    shifted = F.transform(x, lambda v: v - F.array_max(x))
    total = F.log(_sum(F.transform(shifted, lambda v: F.exp(v))))
    return F.transform(shifted, lambda v: v - total)


def distillation_kl(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """An aggregate: the mean divergence of the student from the teacher a row, times the squared temperature."""
    s, t = _log_softmax(student, temperature), _log_softmax(teacher, temperature)
    return F.avg(_sum(_paired(s, t, lambda a, b: F.exp(b) * (b - a)))) * temperature * temperature


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def separation_of(codes: np.ndarray, margin: float = 0.1) -> float:
    """Mean excess over ``margin`` of the cosines between different codes; 0 for a single one."""
    unit = _unit(codes)
    cosines = (unit @ unit.T)[~np.eye(len(codes), dtype=bool)]
    return float(np.maximum(cosines - margin, 0).mean()) if cosines.size else 0.0


def contrast_of(queries: np.ndarray, positives: np.ndarray, temperature: float = 0.07) -> float:
    """Mean cross entropy of finding each query's own positive among those of the batch."""
    logits = _unit(queries) @ _unit(positives).T / temperature
    top = logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - np.diag(logits)).mean())


def batch_losses(df: DataFrame, batch: str, code: str, positive: str, margin: float = 0.1, temperature: float = 0.07) -> DataFrame:
    """(batch, separation, contrast) of each training batch, which is of a size that a task holds."""
    kind = df.schema[batch].dataType.simpleString()

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack([np.asarray(v, np.float64) for v in p[c]]) for c in ("a", "b"))
        return pd.DataFrame([(key[0], separation_of(a, margin), contrast_of(a, b, temperature))], columns=["g", "separation", "contrast"])

    rows = df.select(F.col(batch).alias("g"), F.col(code).alias("a"), F.col(positive).alias("b"))
    return rows.groupBy("g").applyInPandas(run, f"g {kind}, separation double, contrast double").withColumnRenamed("g", batch)
