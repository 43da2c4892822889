"""Feature artefacts: JSON lines in the shared file system, made visible by a manifest.

A task attempt writes a file of its own and removes it if it fails; the driver commits by
writing the manifest, which names the files of the attempts that won. A reader takes the
files of the manifest, so it sees a whole export or none. A new export is written beside
the files of the old one, which go once the manifest names the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from recallgrid.functions.lineage import settle

MANIFEST = "manifest.json"
#: A row of an artefact.
FEATURES = "textsha256 string, dimension int, indices array<int>, values array<double>, payload map<string,string>, diagnostics struct<nonzero:long>, text string"


def _open(folder: str):
    """(file system, path in it) of a path or URI that all executors share."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs.LocalFileSystem(), folder


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, about: dict, overwrite: bool):
        self.folder, self.about, self.overwrite = folder, about, overwrite

    def write(self, iterator: Iterator) -> Written:
        store, base = _open(self.folder)
        store.create_dir(base, recursive=True)
        name, rows = f"part-{uuid.uuid4().hex}.jsonl", 0
        try:
            with store.open_output_stream(f"{base}/{name}") as out:
                for batch in iterator:
                    lines = batch.column(0).to_pylist()
                    out.write("".join(line + "\n" for line in lines).encode())
                    rows += len(lines)
        except BaseException:
            store.delete_file(f"{base}/{name}")
            raise
        if not rows:
            store.delete_file(f"{base}/{name}")
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files in the manifest, by a rename; whatever it does not name goes after that."""
        from pyarrow import fs

        store, base = _open(self.folder)
        store.create_dir(base, recursive=True)
        done = [m for m in messages if m is not None]
        old = _manifest(store, base)
        if old is not None and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.folder} holds an export")
        manifest = self.about | {"rows": sum(m.rows for m in done), "files": sorted(m.file for m in done if m.file)}
        draft = f"{base}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(manifest, indent=2, sort_keys=True, default=str).encode())
        store.move(draft, f"{base}/{MANIFEST}")
        named = set(manifest["files"])
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.base_name.startswith("part-") and info.base_name not in named:
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _open(self.folder)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{base}/{m.file}")


class LinesSource(DataSource):
    """Takes one column of texts, a line each; options are folder and about (a JSON object for the manifest)."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("committed lines take one column of strings")
        return LinesWriter(self.options["folder"], json.loads(self.options.get("about", "{}")), overwrite)


def _manifest(store, base: str) -> dict | None:
    try:
        with store.open_input_stream(f"{base}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def read_manifest(folder: str) -> dict:
    found = _manifest(*_open(folder))
    if found is None:
        raise FileNotFoundError(f"no export at {folder}")
    return found


def write_lines(lines: DataFrame, folder: str, about: dict, overwrite: bool = False) -> dict:
    """Writes a column of strings as committed lines; gives the manifest."""
    if not overwrite and _manifest(*_open(folder)) is not None:
        raise ValueError(f"{folder} holds an export")
    lines.sparkSession.dataSource.register(LinesSource)
    lines.write.format("committed_lines").option("folder", folder).option("about", json.dumps(about, default=str)).mode("overwrite" if overwrite else "append").save()
    return read_manifest(folder)


def example_texts(examples: DataFrame, events_only: bool = False) -> DataFrame:
    """(example_id, role, place, text) of all events, and of the queries, which follow the events of their example."""
    events = examples.select("example_id", F.posexplode("events").alias("place", "e")).select("example_id", F.lit("event").alias("role"), "place", F.col("e.text").alias("text"))
    if events_only:
        return events
    return events.unionByName(examples.select("example_id", F.lit("query").alias("role"), F.lit(0).alias("place"), F.col("query").alias("text")))


def export_codes(texts: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame], dimension: int, folder: str, include_text: bool = False, about: dict | None = None, overwrite: bool = False) -> dict:
    """Codes of all distinct texts as an artefact that ``read_codes`` and the precomputed encoder read; gives the manifest.

    ``encode`` is one of ``operators.latent.encoder``. Equal texts are brought together
    before they are encoded, null ones are left out, a text without features has an empty
    code. An ``encode`` that names features outside the dimension fails the export.
    """
    digest = F.sha2("text", 256).alias("textsha256")
    unique = settle(texts.filter(F.col("text").isNotNull()).select(digest, "text").groupBy("textsha256").agg(F.any_value("text").alias("text")), "unique-texts")
    entry = F.struct(F.col("feature").cast("int").alias("feature"), F.col("w").cast("double").alias("w"))
    codes = encode(unique, "textsha256", "text").groupBy("textsha256").agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    pick = lambda name: F.coalesce(F.transform("_c", lambda x: x[name]), F.array().cast("array<int>" if name == "feature" else "array<double>"))
    rows = unique.join(codes, "textsha256", "left").withColumns({"indices": pick("feature"), "values": pick("w")})
    outside = F.exists("indices", lambda i: (i < 0) | (i >= dimension))
    rows = rows.withColumn("dimension", F.when(outside, F.raise_error(F.lit("a feature is outside the dimension")).cast("int")).otherwise(F.lit(dimension)))
    rows = rows.withColumns({"payload": F.create_map().cast("map<string,string>"), "diagnostics": F.struct(F.size("indices").cast("long").alias("nonzero"))})
    names = ["textsha256", "dimension", "indices", "values", "payload", "diagnostics"] + (["text"] if include_text else [])
    lines = rows.select(F.to_json(F.struct(*names)).alias("value"))
    return write_lines(lines, folder, {"dimension": dimension, "contains_raw_text": include_text} | (about or {}), overwrite)


def read_codes(spark: SparkSession, folder: str, dimension: int | None = None) -> DataFrame:
    """(textsha256, code, text) of an artefact; fails if it is of another dimension."""
    manifest = read_manifest(folder)
    if dimension is not None and manifest["dimension"] != dimension:
        raise ValueError(f"the artefact has dimension {manifest['dimension']}, not {dimension}")
    files = [f"{folder.rstrip('/')}/{f}" for f in manifest["files"]]
    rows = spark.read.schema(FEATURES).option("mode", "FAILFAST").json(files) if files else spark.createDataFrame([], FEATURES)
    return rows.select("textsha256", F.struct("dimension", "indices", "values").alias("code"), "text")
