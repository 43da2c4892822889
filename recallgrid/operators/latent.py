"""Codes of token activations by a top-k linear codec, and encoders by name."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.vectors import rows_normalized, rows_topk

from . import encode as E
from . import store as S


#: Bytes of weights that an executor may get, and of activations that a task holds at a time.
MOST_BYTES, BLOCK_BYTES = 1 << 31, 1 << 26


def token_topk(name: str, default: int = 50) -> int:
    """The number behind L0 in a codec's name, the entries that it keeps of each token."""
    found = re.search(r"L0[_-]?(\d+)", name, re.IGNORECASE)
    return int(found[1]) if found else default


def topk_codes(df: DataFrame, key: str, order: str, vector: str, weights: np.ndarray, bias: np.ndarray, token_k: int, pooling: str = "positive_max", k: int = 128) -> DataFrame:
    """(key, feature, w): the codes of token vectors, pooled over the tokens of a key, the k largest, unit length.

    Each token keeps the ``token_k`` largest of weights @ x + bias, ties to the smaller
    feature; all others count 0. Pooling is positive_max, max_abs (max), mean, sum or last.
    Tokens are encoded in Arrow batches and pooled by a partial aggregation, so a text of
    any length is never in one place; the weights, of fixed size, go to each executor once.
    """
    width, depth = weights.shape
    if bias.shape != (width,) or not 0 < token_k <= width:
        raise ValueError("weights, bias and the entries of a token do not fit together")
    pooling = "max_abs" if pooling == "max" else pooling
    if pooling not in ("positive_max", "max_abs", "mean", "sum", "last"):
        raise ValueError(f"unknown pooling: {pooling}")
    if weights.nbytes > MOST_BYTES:
        raise ValueError(f"weights of {weights.nbytes} bytes; at most {MOST_BYTES} go to each executor")
    shared = df.sparkSession.sparkContext.broadcast((weights, bias))
    together = max(1, BLOCK_BYTES // (8 * width))

    @F.pandas_udf("array<struct<feature:int,v:double>>")
    def encoded(vectors: pd.Series) -> pd.Series:
        w, b = shared.value
        if any(v is None or len(v) != depth for v in vectors):
            raise ValueError(f"a token has no vector of {depth} entries")
        out = []
        for at in range(0, len(vectors), together):
            made = np.stack(vectors.iloc[at : at + together].to_list()).astype(np.float64) @ w.T + b
            best = np.argsort(-made, axis=1, kind="stable")[:, :token_k]  # ties to the smaller feature
            kept = np.take_along_axis(made, best, 1)
            out += [[{"feature": i, "v": v} for i, v in zip(*row, strict=True)] for row in zip(best.tolist(), kept.tolist(), strict=True)]
        return pd.Series(out, dtype=object)

    tokens = df.select(key, F.col(order).alias("_o"), F.col(vector).cast("array<double>").alias("_x"))
    if pooling == "last":
        tokens = tokens.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col("_o").desc()))).filter("_r = 1")
    entries = tokens.select(key, "_o", F.inline(encoded("_x")))
    value = {
        "positive_max": F.greatest(F.max("v"), F.lit(0.0)),
        "max_abs": F.min_by("v", F.struct(-F.abs("v"), "_o")),
        "last": F.sum("v"),
        "sum": F.sum("v"),
        "mean": F.sum("v"),
    }[pooling]
    pooled = entries.groupBy(key, "feature").agg(value.alias("w"))
    if pooling == "mean":
        pooled = pooled.join(tokens.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key).select(key, "feature", (F.col("w") / F.col("_n")).alias("w"))
    return rows_normalized(rows_topk(pooled.filter("w <> 0"), [key], k), [key])


# Names of the encoders.
HASHING = ("hash", "hashing", "feature_hashing")
PRECOMPUTED = ("precomputed", "precomputed_sparse", "feature_artifact")
BY_MODEL = ("sentence_transformer", "sentence_transformers", "hf_hidden", "hidden_state", "activation", "transformer_lens_hook", "tl_hook", "hook_activation", "sae", "sae_lens", "qwen_scope", "qwenscope", "qwen_sae")


def encoder(kind: str, **params) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function of (texts, key column, text column) that gives (key, feature, w); hyphens count as underscores.

    Hashing takes the options of ``hash_codes`` with words and chars; precomputed takes
    ``features`` (textsha256, code). Encoders that run a model are not offered, but
    ``topk_codes`` and ``pool`` take what such a model has put out.
    """
    name = kind.lower().replace("-", "_")
    if name in HASHING:
        grams = {n: params.pop(n) for n in ("words", "chars") if n in params}
        options = {"dimension": 65_536, "k": 128} | params
        return lambda df, key, text: E.hash_codes(E.text_features(df, key, text, **grams), key, **options)
    if name in PRECOMPUTED:
        features = params["features"]
        found = lambda df, key, text: S.feature_lookup(df.select(key, text), features.select("textsha256", "code"), text)
        return lambda df, key, text: found(df, key, text).select(key, F.inline(F.arrays_zip(F.col("code.indices").alias("feature"), F.col("code.values").alias("w"))))
    if name in BY_MODEL:
        raise NotImplementedError(f"the encoder {kind} runs a model, which is not offered")
    raise ValueError(f"unknown encoder type: {kind}")
