"""Feature artefacts: commit by manifest, failed tasks, and reading them back as an encoder."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import latent as L
from recallgrid.sources import artifacts as AR
from recallgrid.sources import checkpoints as CP

EVENTS = "example_id string, query string, events array<struct<event_id:string,text:string>>"


def _examples(spark):
    rows = [("a", "where is it", [("a1", "it is here"), ("a2", "")]), ("b", "it is here", [("b1", "it is here"), ("b2", None), ("b3", "over there")])]
    return spark.createDataFrame(rows, EVENTS)


def test_export_reads_back(spark, tmp_path):
    encode = L.encoder("hashing", dimension=512, k=16)
    folder = str(tmp_path / "features")
    texts = AR.example_texts(_examples(spark))
    manifest = AR.export_codes(texts, encode, 512, folder, include_text=True, about={"encoder": "hashing"})
    assert manifest["rows"] == 4 and manifest["encoder"] == "hashing" and manifest["contains_raw_text"] is True
    found = {r.text: r for r in AR.read_codes(spark, folder, 512).collect()}
    assert set(found) == {"where is it", "it is here", "", "over there"}
    assert all(r.textsha256 == hashlib.sha256(t.encode()).hexdigest() and r.code.dimension == 512 for t, r in found.items())
    assert list(found[""].code.indices) == []
    known = L.encoder("precomputed", features=AR.read_codes(spark, folder))
    asked = spark.createDataFrame([(1, "over there"), (2, "it is here")], "id int, text string")
    as_set = lambda df: {(r.id, r.feature, r.w) for r in df.collect()}
    assert as_set(known(asked, "id", "text")) == as_set(encode(asked, "id", "text")) != set()
    assert AR.export_codes(AR.example_texts(_examples(spark), events_only=True), encode, 512, folder, overwrite=True)["rows"] == 3
    assert {r.text for r in AR.read_codes(spark, folder).collect()} == {None}
    with pytest.raises(ValueError, match="dimension"):
        AR.read_codes(spark, folder, 256)
    with pytest.raises(ValueError, match="holds an export"):
        AR.export_codes(texts, encode, 512, folder)


def test_failed_export_leaves_the_old_one(spark, tmp_path):
    folder = tmp_path / "lines"
    lines = spark.range(0, 400, 1, 4).select(F.format_string('{"n":%d}', "id").alias("value"))
    assert AR.write_lines(lines, str(folder), {})["rows"] == 400
    before = {p.name: p.read_bytes() for p in folder.iterdir()}
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="lost"):
        AR.write_lines(bad, str(folder), {}, overwrite=True)
    assert {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith(".")} == {n: b for n, b in before.items() if not n.startswith(".")}
    manifest = json.loads((folder / AR.MANIFEST).read_text())
    assert sum(len((folder / f).read_text().splitlines()) for f in manifest["files"]) == 400


def test_empty_export(spark, tmp_path):
    folder = str(tmp_path / "none")
    encode = L.encoder("hashing", dimension=64, k=4)
    assert AR.export_codes(AR.example_texts(_examples(spark).limit(0)), encode, 64, folder)["files"] == []
    assert AR.read_codes(spark, folder).count() == 0


def test_features_outside_the_dimension_fail(spark, tmp_path):
    wide = lambda df, key, text: df.select(key, F.lit(64).alias("feature"), F.lit(1.0).alias("w"))
    with pytest.raises(Exception, match="outside the dimension"):
        AR.export_codes(AR.example_texts(_examples(spark)), wide, 64, str(tmp_path / "wide"))
    assert not (tmp_path / "wide" / AR.MANIFEST).exists()


def test_checkpoints(spark):
    assert CP.checkpoint("Gemma3-12B-L32")["d_model"] == 3840 and CP.checkpoints(spark).count() == 4
    with pytest.raises(KeyError, match="unknown checkpoint"):
        CP.checkpoint("none")
