"""Datasets by name, and a few driver-side connectors."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import generators as G
from . import readers as R

DATASETS: dict[str, Callable[..., DataFrame]] = {
    "synthetic": G.synthetic,
    "continual": G.continual,
    "contextual": G.contextual,
    "overlap_identity": G.overlapping,
    "prospection": G.prospective,
    "neurogenesis": G.novelty_stream,
    "state_tensor": G.state_tensors,
    "session_qa": R.session_qa,
    "flexible_qa": R.flexible_qa,
    "dialogue_qa": R.dialogue_qa,
    "long_context": R.long_context,
    "multiple_choice": R.multiple_choice,
    "prompts": R.prompts,
}


def dataset(spark: SparkSession, kind: str, chunk: dict | None = None, limit: int | None = None, **params) -> DataFrame:
    """Examples of a named dataset, chunked and limited on demand; hyphens count as underscores."""
    name = kind.lower().replace("-", "_")
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {kind}")
    out = DATASETS[name](spark, **params)
    out = R.chunked(out, **chunk) if chunk else out
    return out if limit is None else out.limit(limit)


def run_external(command: list[str], request: dict, timeout: float = 600) -> dict:
    """Hands a JSON request to a program by file and reads its JSON response; ``{input}`` and ``{output}`` are the paths."""
    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, "request.json"), Path(folder, "response.json")
        source.write_text(json.dumps(request))
        argv = [a.replace("{input}", str(source)).replace("{output}", str(target)) for a in command]
        done = subprocess.run(argv, capture_output=True, text=True, timeout=timeout)
        if done.returncode:
            raise RuntimeError(f"external program failed ({done.returncode}): {done.stderr[-500:]}")
        return json.loads(target.read_text())


def write_run(rows: DataFrame, summary: dict, folder: str) -> None:
    """Per-example rows as JSON lines and a small summary beside them."""
    rows.write.mode("overwrite").json(f"{folder}/per_example")
    write_text(rows.sparkSession, json.dumps(summary, sort_keys=True, default=str), f"{folder}/summary")


def write_text(spark: SparkSession, text: str, folder: str) -> None:
    """A small text of the driver, as a folder of the shared file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def kv_injection(*_, **__):
    raise NotImplementedError("injection into a model's key-value memory is not offered")


def activation_beacon(*_, **__):
    raise NotImplementedError("no activation beacon is offered")
