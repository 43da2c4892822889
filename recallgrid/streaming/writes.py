"""The ordered write fold as a stream, with state for each graph row between micro-batches.

State of a namespace is a map from graph row to its entries, a map from feature to its
moving averages, and a clock. A micro-batch reads and writes the rows that its events touch
and emits those alone, so its cost follows the batch and not the graph. Rows carry the
write number of their last change; readers age them to the namespace's clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from recallgrid.operators import graph as G

#: A graph row after write ``version``; without ``src`` the clock; with ``late`` an event that came too late to be folded.
CHANGES = "ns {ns}, src long, version long, seq long, dst array<long>, w array<double>, late boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class WriteFold(StatefulProcessor):
    """Folds rows (ns, seq, code of (feature, w)) in order of seq; an event behind the last one folded goes out as late."""

    def __init__(self, rule: str = "hebb", rate: float = G.RATE, decay: float = G.DECAY, interval: int = G.INTERVAL, max_degree: int = G.MAX_DEGREE, max_pairs: int = G.MAX_PAIRS, cap: bool = True):
        if rule not in ("hebb", "covariance", "bcm", "oja"):
            raise ValueError(f"unknown plasticity rule: {rule}")
        self.rule, self.rate, self.decay, self.interval, self.max_degree, self.max_pairs, self.cap = rule, rate, decay, interval, max_degree, max_pairs, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "writes long, last long")
        self.rows = handle.getMapState("rows", "src long", "version long, dst array<long>, w array<double>")
        self.averages = handle.getMapState("averages", "feature long", "mu double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        writes, last = self.clock.get() if self.clock.exists() else (0, -1)
        events = sorted(((int(seq), code) for p in rows for seq, code in zip(p["seq"], p["code"], strict=True)), key=lambda e: e[0])
        held: dict[int, tuple[int, dict[int, float]]] = {}
        means: dict[int, tuple[float, float]] = {}
        late = []
        for seq, code in events:
            if seq <= last:
                late.append(seq)
                continue
            writes, last = writes + 1, seq
            self._write(writes, [(int(x["feature"]), float(x["w"])) for x in code], held, means)
        for feature, pair in means.items():
            self.averages.updateValue((feature,), pair)
        for src, (version, row) in held.items():
            self.rows.updateValue((src,), (version, list(row), list(row.values())))
        self.clock.update((writes, last))
        changed = [(key[0], src, version, None, list(row), list(row.values()), False) for src, (version, row) in held.items()]
        changed += [(key[0], None, None, seq, None, None, True) for seq in late]
        changed.append((key[0], None, writes, last, None, None, False))
        yield pd.DataFrame(changed, columns=["ns", "src", "version", "seq", "dst", "w", "late"]).astype({"src": "Int64", "version": "Int64", "seq": "Int64"})

    def _row(self, src: int, held: dict) -> tuple[int, dict[int, float]]:
        if src not in held:
            if not self.rows.containsKey((src,)):
                return 0, {}
            version, dst, w = self.rows.getValue((src,))
            held[src] = version, dict(zip(map(int, dst), map(float, w), strict=True))
        return held[src]

    def _mean(self, feature: int, means: dict) -> tuple[float, float]:
        if feature not in means:
            means[feature] = tuple(self.averages.getValue((feature,))) if self.averages.containsKey((feature,)) else (0.0, 0.0)
        return means[feature]

    def _write(self, t: int, code: list[tuple[int, float]], held: dict, means: dict) -> None:
        top = sorted(code, key=lambda p: (-abs(p[1]), p[0]))[: self.max_pairs]
        names, values = [i for i, _ in top], np.array([v for _, v in top])
        rows = []
        for i in names:
            version, row = self._row(i, held)
            rows.append(G.aged_row(row, G.decays_between(version, t, self.interval), self.decay))
        old = np.array([[row.get(j, 0.0) for j in names] for row in rows]) if self.rule == "oja" else None
        known = [self._mean(i, means) for i in names] if self.rule in ("covariance", "bcm") else [(0.0, 0.0)] * len(names)
        deltas = G.pair_matrix(self.rule, self.rate, values, np.array([m for m, _ in known]), np.array([m for _, m in known]), old)
        for i, row, own in zip(names, rows, deltas.tolist(), strict=True):
            held[i] = t, G.settled_row(G.grown_row(row, i, names, own), self.max_degree, self.cap)
        r = G.mean_rate(self.rate)
        if self.rule in ("covariance", "bcm"):
            for (i, v), (mu, m2) in zip(top, known, strict=True):
                means[i] = (1 - r) * mu + r * abs(v), (1 - r) * m2 + r * v * v

    def close(self) -> None:
        pass


def edge_changes(stream: DataFrame, **options) -> DataFrame:
    """CHANGES of a stream of rows (ns, seq, code); needs the RocksDB state store."""
    schema = CHANGES.format(ns=stream.schema["ns"].dataType.simpleString())
    return stream.groupBy("ns").transformWithStateInPandas(WriteFold(**options), schema, "Append", "None")


def latest_edges(changes: DataFrame, decay: float = G.DECAY, interval: int = G.INTERVAL) -> DataFrame:
    """(ns, src, dst, w): the last version of each row, aged to its namespace's clock."""
    clocks = changes.filter("src IS NULL AND NOT late").groupBy("ns").agg(F.max("version").alias("_now"))
    last = changes.filter("src IS NOT NULL").groupBy("ns", "src").agg(F.max_by(F.struct("dst", "w"), "version").alias("row"), F.max("version").alias("_then"))
    each = last.join(clocks, "ns").select("ns", "src", "_now", "_then", F.explode(F.arrays_zip(F.col("row.dst").alias("dst"), F.col("row.w").alias("w"))).alias("x"))
    steps = F.floor(F.col("_now") / interval) - F.floor(F.col("_then") / interval) if interval > 0 else F.lit(0)
    aged = each.select("ns", "src", F.col("x.dst").alias("dst"), (F.col("x.w") * F.pow(F.lit(max(0.0, 1 - decay)), steps)).alias("w"), (steps > 0).alias("_aged"))
    return aged.filter(~F.col("_aged") | (F.abs("w") >= G.GONE)).drop("_aged")


def late_writes(changes: DataFrame) -> DataFrame:
    """(ns, seq) of the events that came behind later ones and were left out; a rebuild in batch takes them in."""
    return changes.filter("late").select("ns", "seq")


def run_changes(spark: SparkSession, source: str, place: str, schema: StructType, **options) -> DataFrame:
    """Runs the fold over all new files in ``source``, one a micro-batch, resuming from ``place``; gives all changes so far."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = edge_changes(stream, **options).writeStream.format("parquet").option("path", f"{place}/changes").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{place}/changes")


def streaming_edges(spark: SparkSession, source: str, place: str, schema: StructType, **options) -> DataFrame:
    """The edges after ``run_changes``."""
    aged = {k: v for k, v in options.items() if k in ("decay", "interval")}
    return latest_edges(run_changes(spark, source, place, schema, **options), **aged)
