"""Cutting lineage by tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, below the warehouse until the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_scratch/{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, urlparse(base).path, ignore_errors=True)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again: plans stay small and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
