"""A durable episode table: write batches, bases by hash bucket, and a manifest that names what is live.

Episodes are rows of Parquet in buckets by the hash of their id, postings beside them. A
write adds one batch of its own size: new versions of episodes, or marks of deleted ones.
Compaction merges the batches into new bases of the buckets that they touch, and of no
others. Each change ends with a numbered manifest, moved into place as a whole; a reader
takes the latest and sees that version only, whatever is written meanwhile. Two writers
of one version: the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recallgrid.operators.store import EPISODE, candidate_votes

ROWS = f"{EPISODE}, version long, deleted boolean"
POSTINGS = "episode_id string, feature int, w double, version long"


class ConcurrentWrite(RuntimeError):
    """Another writer has claimed the next version."""


class EpisodeTable:
    """Episodes with the columns of EPISODE at ``place``, a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = 64):
        self.spark, self.place = spark, place.rstrip("/")
        manifest = self._latest()
        if manifest["version"] and manifest["buckets"] != buckets:
            raise ValueError(f"{place} has {manifest['buckets']} buckets")
        self.buckets = buckets

    # --- files -----------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")

    def _fs(self):
        return self._path("manifest").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict:
        fs, folder = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "base": {}, "batches": []}
        return json.loads(self.spark.read.text(f"{self.place}/manifest/{max(numbers):012d}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, number = self._fs(), manifest["version"]
        if not fs.createNewFile(self._path(f"manifest/{number:012d}.claim")):
            raise ConcurrentWrite(f"version {number} of {self.place}")
        draft = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest | {"buckets": self.buckets}).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"manifest/{number:012d}.json")):
            raise ConcurrentWrite(f"version {number} of {self.place}")

    def _write(self, df: DataFrame, kind: str, batch: str) -> None:
        bucket = F.pmod(F.xxhash64("episode_id"), F.lit(self.buckets)).cast("int")
        df.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "episode_id").write.partitionBy("bucket").parquet(f"{self.place}/{kind}/{batch}")

    def _read(self, kind: str, schema: str, paths: list[str]) -> DataFrame:
        """The files of some batches, or of single buckets of them; those without rows have no folder."""
        fs = self._fs()
        found = [f"{self.place}/{kind}/{p}" for p in paths if fs.exists(self._path(f"{kind}/{p}"))]
        if not found:
            return self.spark.createDataFrame([], StructType.fromDDL(schema))
        return self.spark.read.option("basePath", f"{self.place}/{kind}").schema(schema).parquet(*found).select(*StructType.fromDDL(schema).names)

    # --- writes ----------------------------------------------------------------------------

    def _add(self, rows: DataFrame, manifest: dict, postings: DataFrame | None) -> int:
        batch = f"batch=write-{uuid.uuid4().hex}"
        self._write(rows, "episodes", batch)
        if postings is not None:
            self._write(postings, "postings", batch)
        version = manifest["version"] + 1
        self._commit({"version": version, "base": manifest["base"], "batches": [*manifest["batches"], batch]})
        return version

    def upsert(self, episodes: DataFrame) -> int:
        """Adds or replaces episodes; ids must be unique within the batch. Gives the new version."""
        manifest = self._latest()
        version = F.lit(manifest["version"] + 1).cast("long")
        kinds = {f.name: f.dataType for f in StructType.fromDDL(EPISODE)}
        have = [F.col(c).cast(k) if c in episodes.columns else F.lit(None).cast(k) for c, k in kinds.items()]
        rows = episodes.select(*[c.alias(n) for c, n in zip(have, kinds, strict=True)], version.alias("version"), F.lit(False).alias("deleted"))
        return self._add(rows, manifest, _posted(rows))

    def delete(self, ids: DataFrame) -> int:
        """Removes the episodes of ``ids`` (episode_id). Gives the new version."""
        manifest = self._latest()
        rows = ids.select("episode_id").distinct()
        for f in StructType.fromDDL(ROWS):
            if f.name != "episode_id":
                rows = rows.withColumn(f.name, F.lit({"version": manifest["version"] + 1, "deleted": True}.get(f.name)).cast(f.dataType))
        return self._add(rows, manifest, None)

    def compact(self) -> int:
        """Merges the batches into the bases of the buckets that they touch. Gives the version after it."""
        manifest = self._latest()
        if not manifest["batches"]:
            return manifest["version"]
        touched = sorted(r[0] for r in self._read("episodes", f"{ROWS}, bucket int", manifest["batches"]).select("bucket").distinct().collect())
        batch = f"batch=base-{uuid.uuid4().hex}"
        rows = self._live(manifest, touched)
        self._write(rows, "episodes", batch)
        self._write(_posted(rows), "postings", batch)
        base = manifest["base"] | {str(k): batch for k in touched}
        self._commit({"version": manifest["version"] + 1, "base": base, "batches": []})
        return manifest["version"] + 1

    def vacuum(self) -> list[str]:
        """Deletes the batches that the latest manifest does not name; readers of older versions lose them."""
        manifest, fs, gone = self._latest(), self._fs(), []
        kept = {*manifest["base"].values(), *manifest["batches"]}
        for kind in ("episodes", "postings"):
            folder = self._path(kind)
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if (name := s.getPath().getName()) not in kept:
                    fs.delete(s.getPath(), True)
                    gone.append(name)
        return sorted(set(gone))

    # --- reads -----------------------------------------------------------------------------

    def _newest(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        """(episode_id, version, deleted): what the batches say last of each episode that they name."""
        paths = [p if buckets is None else f"{p}/bucket={k}" for p in manifest["batches"] for k in ([0] if buckets is None else buckets)]
        named = self._read("episodes", ROWS, paths).groupBy("episode_id")
        return named.agg(F.max("version").alias("version"), F.max_by("deleted", "version").alias("deleted"))

    def _merged(self, manifest: dict, kind: str, schema: str, buckets: list[int] | None) -> DataFrame:
        """Base rows that no batch names, and the newest rows of the batches; only the ids of the batches are joined."""
        of = range(self.buckets) if buckets is None else buckets
        base = self._read(kind, schema, [f"{manifest['base'][str(k)]}/bucket={k}" for k in of if str(k) in manifest["base"]])
        if not manifest["batches"]:
            return base
        newest = self._newest(manifest, buckets)
        paths = [p if buckets is None else f"{p}/bucket={k}" for p in manifest["batches"] for k in ([0] if buckets is None else buckets)]
        new = self._read(kind, schema, paths).join(newest.filter("NOT deleted").drop("deleted"), ["episode_id", "version"], "left_semi")
        return base.join(newest.select("episode_id"), "episode_id", "left_anti").unionByName(new)

    def _live(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        return self._merged(manifest, "episodes", ROWS, buckets)

    def all(self) -> DataFrame:
        """All episodes of the latest version, with the version that wrote them."""
        return self._live(self._latest()).drop("deleted")

    def postings(self) -> DataFrame:
        """(episode_id, feature, w) of all episodes."""
        return self._merged(self._latest(), "postings", POSTINGS, None).drop("version")

    def get(self, ids: list[str]) -> DataFrame:
        """The named episodes; reads their buckets alone."""
        rows = self.spark.createDataFrame([(i,) for i in ids], "episode_id string")
        buckets = sorted({r[0] for r in rows.select(F.pmod(F.xxhash64("episode_id"), F.lit(self.buckets))).collect()})
        return self._live(self._latest(), buckets).join(rows, "episode_id", "left_semi").drop("deleted")

    def candidates(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query_id, episode_id, votes, rank) for queries (query_id, feature), by number of shared features, ties by id."""
        return candidate_votes(queries, self.postings(), limit)

    def stats(self) -> DataFrame:
        """One row: episodes, posting_features, posting_entries, and the live batches and bases."""
        manifest = self._latest()
        counts = self.postings().agg(F.countDistinct("feature").alias("posting_features"), F.count(F.lit(1)).alias("posting_entries"))
        live = self._live(manifest).agg(F.count(F.lit(1)).alias("episodes"))
        return live.join(counts).withColumns({"version": F.lit(manifest["version"]), "batches": F.lit(len(manifest["batches"])), "bases": F.lit(len(set(manifest["base"].values())))})


def _posted(rows: DataFrame) -> DataFrame:
    each = F.inline(F.arrays_zip(F.col("code.indices").alias("feature"), F.col("code.values").alias("w")))
    return rows.filter("code IS NOT NULL").select("episode_id", "version", each).select("episode_id", "feature", "w", "version")
