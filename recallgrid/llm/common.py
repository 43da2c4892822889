"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.lineage import scratch_dir

#: Bytes that separate words: space and 0x09-0x0D; everything else belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Spark's setting that removes shuffle files at the end of an execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, as its package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors.

    The shuffle files of the write are not needed after it and are removed at once.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it, for a URI or a plain path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


#: Bytes of text that a task turns into Python objects at a time.
TOGETHER = 1 << 19


def release_memory() -> None:
    """Gives what a finished task no longer uses back to the system; its Python worker lives on for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], place: int, limit: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of the text in column ``place``, one row at least; an empty batch stays."""
    for b in batches:
        column = b.column(place)
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else None
        begin = 0
        while begin < len(column):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1)
            yield b.slice(begin, end - begin)
            begin = end
        if not len(column):
            yield b
    release_memory()


def words(text: Column) -> Column:
    """Words of a text as a native expression; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


#: A key with more than this share of the rows is joined by broadcast; at most 1/share keys can be so.
HOT_SHARE = 1 / 1000


def hot_safe_lookup(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """Join ``rows`` with ``lookup`` (unique on ``key``, with the number of matching rows in ``count``).

    Keys that hold over HOT_SHARE of ``total`` rows, of which there can be no more than
    1 / HOT_SHARE, go by broadcast, so that no task gets all rows of such a key; the
    others are joined by a shuffle in which each key is small. ``most`` is the largest
    ``count``, where it is known: without a hot key a plain join is planned.
    """
    least = max(1000, int(total * HOT_SHARE))
    if most is not None and most < least:
        return rows.join(lookup.drop(count), key, how)
    hot = F.broadcast(lookup.filter(F.col(count) >= least).drop(count).withColumn("_hot", F.lit(True)))
    cold = lookup.filter(F.col(count) < least).drop(count)
    values = [c for c in lookup.columns if c not in (key, count)]
    marked = rows.join(hot.select(key, "_hot", *[F.col(v).alias(f"_h_{v}") for v in values]), key, "left")
    by_hot = marked.filter(F.col("_hot")).select(*rows.columns, *[F.col(f"_h_{v}").alias(v) for v in values])
    by_key = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key, how)
    return by_hot.unionByName(by_key.select(*rows.columns, *values))
