"""Public checkpoints of natural-language autoencoders, as a table; the models themselves are not run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, base_model string, layer int, d_model int, av_checkpoint string, ar_checkpoint string"
# Names and shapes of the published checkpoints.
CHECKPOINTS = (
    ("qwen2.5-7b-l20", "Qwen/Qwen2.5-7B-Instruct", 20, 3584, "kitft/nla-qwen2.5-7b-L20-av", "kitft/nla-qwen2.5-7b-L20-ar"),
    ("gemma3-12b-l32", "google/gemma-3-12b-it", 32, 3840, "kitft/nla-gemma3-12b-L32-av", "kitft/nla-gemma3-12b-L32-ar"),
    ("gemma3-27b-l41", "google/gemma-3-27b-it", 41, 5376, "kitft/nla-gemma3-27b-L41-av", "kitft/nla-gemma3-27b-L41-ar"),
    ("llama3.3-70b-l53", "meta-llama/Llama-3.3-70B-Instruct", 53, 8192, "kitft/Llama-3.3-70B-NLA-L53-av", "kitft/Llama-3.3-70B-NLA-L53-ar"),
)


def checkpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHECKPOINTS, SCHEMA)


def checkpoint(name: str) -> dict:
    """A checkpoint by its name in any case; an unknown name fails with those known."""
    for row in CHECKPOINTS:
        if row[0] == name.lower():
            return dict(zip((f.split(" ")[0] for f in SCHEMA.split(", ")), row, strict=True))
    raise KeyError(f"unknown checkpoint {name!r}; known are {', '.join(r[0] for r in CHECKPOINTS)}")
