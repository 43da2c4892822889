"""Configuration, ablation grids and run comparison on the driver; data stays in DataFrames."""

from __future__ import annotations

import hashlib
import importlib.util
import itertools
import json
import os
import platform
import re
import subprocess
import sys
from copy import deepcopy
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from recallgrid.operators.capsules import BoundSettings
from recallgrid.operators.graph import condition
from recallgrid.operators.latent import HASHING
from recallgrid.operators.memory import Settings
from recallgrid.operators.upkeep import Upkeep

#: Defaults of the sections whose unknown keys are errors; fixed values.
SECTIONS = {
    "encoder": {"type": "hashing", "params": {}},
    "graph": {"learningrate": 0.12, "temporallearningrate": 0.08, "decay": 0.001, "decayinterval": 100, "rule": "covariance", "maxdegree": 128, "normalizeafterwrite": True, "allownegativeedges": False, "hubpenalty": 0.5, "maxpairfeatures": 128, "edgecondition": "learned", "edgeseed": 0},
    "retrieval": {"topk": 5, "candidatelimit": 500, "recurrencesteps": 2, "featuretopk": 128, "queryanchor": 1.0, "associationstrength": 0.65, "temporalstrength": 0.15, "exactweight": 0.65, "associativeweight": 0.3, "temporalweight": 0.05, "recencyweight": 0.0, "confidenceweight": 0.0, "threshold": 0.0, "normalizemessages": True, "use_signed_messages": False},
    "salience": {"base": 0.5, "surpriseweight": 0.25, "taskweight": 0.15, "userweight": 0.2, "noveltyweight": 0.25, "redundancyweight": 0.15, "minimum": 0.05, "maximum": 2.0},
}
_ENV = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expand_env(value):
    """``${NAME:-default}`` in any string of a nested configuration; a missing name without default is an error."""
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in os.environ:
            return os.environ[m[1]]
        if m[2] is None:
            raise KeyError(m[1])
        return m[2]

    return _ENV.sub(one, value)


def load_config(path: str) -> dict:
    """A JSON or YAML file, expanded and filled with defaults."""
    p = Path(path)
    if p.suffix == ".json":
        raw = json.loads(p.read_text())
    elif p.suffix in (".yaml", ".yml"):
        if importlib.util.find_spec("yaml") is None:
            raise RuntimeError("reading YAML needs the yaml package")
        import yaml

        raw = yaml.safe_load(p.read_text())
    else:
        raise ValueError(f"unsupported configuration file: {p.suffix}")
    return resolve(expand_env(raw or {}))


def resolve(raw: dict) -> dict:
    config = {"name": "unnamed", "seed": 0, "dataset": {}, "memory": {}, "generator": {"type": "none"}, "evaluation": {}, "outputdir": "runs/unnamed", "notes": ""} | {k: v for k, v in raw.items()}
    memory = {"variant": "v1", "store": {"type": "memory"}} | dict(config["memory"])
    for section, defaults in SECTIONS.items():
        given = dict(memory.get(section, {}))
        if unknown := set(given) - set(defaults):
            raise ValueError(f"unknown keys in {section}: {', '.join(sorted(unknown))}")
        memory[section] = deepcopy(defaults) | given
    return config | {"memory": memory}


def set_path(root: dict, path: str, value) -> None:
    *above, last = path.split(".")
    for name in above:
        root = root.setdefault(name, {})
    root[last] = value


def overlay(base: dict, *fragments: dict) -> dict:
    """Fragments laid over a configuration, key by key."""
    out = deepcopy(base)
    for f in fragments:
        for k, v in f.items():
            out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def ablation_configs(base: dict, factors: dict[str, list], paths: dict[str, str]) -> list[tuple[str, dict, list[str]]]:
    """(name, configuration, factors without a path) for every combination of factor values."""
    out = []
    for values in itertools.product(*factors.values()):
        config, missed = deepcopy(base), []
        for factor, value in zip(factors, values, strict=True):
            if factor in paths or "." in factor:
                set_path(config, paths.get(factor, factor), value)
            else:
                missed.append(factor)
        out.append(("-".join(map(str, values)), config, missed))
    return out


def ablation_grid(spark: SparkSession, factors: dict[str, list]) -> DataFrame:
    """A row per combination, with its name; the factors are literals of a configuration."""
    rows = [(*v, "-".join(map(str, v))) for v in itertools.product(*factors.values())]
    kinds = ", ".join(f"{k} {'int' if isinstance(v[0], int) else 'string'}" for k, v in factors.items())
    return spark.createDataFrame(rows, f"{kinds}, name string")


def commit_id() -> str | None:
    """The commit that the working directory is at, if it is in a repository."""
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True)
    except (FileNotFoundError, subprocess.CalledProcessError):
        return None
    return found.stdout.strip()


def environment(config: dict) -> dict:
    import pyspark

    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    return {"python": platform.python_version(), "executable": sys.executable, "pyspark": pyspark.__version__, "platform": platform.platform(), "git_commit": commit_id(), "config_sha256": digest}


#: Names of the second engine; fixed values.
SECOND = ("aam_v2", "hippocampal", "hippocampal_activation", "memory_as_activations", "v2")


def engine(config: dict) -> int:
    return 2 if str(config["memory"].get("variant", "v1")).lower() in SECOND else 1


def settings(config: dict) -> Settings:
    """The settings of a memory that a resolved configuration asks for.

    What an engine does not do fails, where a value other than the usual one asks for it.
    """
    memory, second = config["memory"], engine(config) == 2
    graph, retrieval, given = memory["graph"], memory["retrieval"], dict(memory["encoder"]["params"])
    if memory["encoder"]["type"].lower() not in HASHING:
        raise NotImplementedError(f"a memory encodes by hashing, not by {memory['encoder']['type']}")
    usual = SECTIONS["retrieval"], SECTIONS["graph"]
    missing = [n for n in ("recencyweight",) if not second and retrieval[n] != usual[0][n]]
    missing += [n for n in ("normalizeafterwrite", "allownegativeedges") if second and graph[n] != usual[1][n]]
    if missing:
        raise NotImplementedError(f"not offered by engine {engine(config)}: {', '.join(missing)}")
    made = BoundSettings() if second else Settings()
    grams = {ours: tuple(given.pop(theirs)) for ours, theirs in (("words", "wordngrams"), ("chars", "charngrams")) if theirs in given}
    made.dimension, made.topk = given.pop("dimension", made.dimension), given.pop("topk", made.topk)
    made.hash_mode = given.pop("hashmode", "blake2b")
    names = {"sublineartf": "sublinear", "signed": "signed", "seed": "seed", "positiveonly": "positive_only"}
    if unknown := sorted(set(given) - set(names)):
        raise ValueError(f"unknown parameters of the encoder: {', '.join(unknown)}")
    made.grams, made.hashing = grams, {names[k]: v for k, v in given.items()}
    made.rule, made.rate, made.temporal_rate = graph["rule"], graph["learningrate"], graph["temporallearningrate"]
    made.decay, made.interval, made.max_degree = graph["decay"], graph["decayinterval"], graph["maxdegree"]
    made.max_pairs, made.cap, made.allow_negative = graph["maxpairfeatures"], graph["normalizeafterwrite"], graph["allownegativeedges"]
    made.edges, made.edge_seed = condition(graph["edgecondition"]), graph["edgeseed"]
    made.results, made.candidates, made.steps = retrieval["topk"], retrieval["candidatelimit"], retrieval["recurrencesteps"]
    renamed = {"k": "featuretopk", "anchor": "queryanchor", "beta": "associationstrength", "gamma": "temporalstrength", "threshold": "threshold", "normalize": "normalizemessages", "signed": "use_signed_messages"}
    made.recall = {ours: retrieval[theirs] for ours, theirs in renamed.items()} | {"hub": graph["hubpenalty"]}
    made.weights = {"exact": retrieval["exactweight"], "associative": retrieval["associativeweight"], "temporal": retrieval["temporalweight"], "recency_weight": retrieval["recencyweight"], "confidence_weight": retrieval["confidenceweight"]}
    gate = memory["salience"]
    made.salience = {"base": gate["base"], "surprise": gate["surpriseweight"], "task_relevance": gate["taskweight"], "user_importance": gate["userweight"], "novelty": gate["noveltyweight"], "redundancy": -gate["redundancyweight"]}
    made.salience_range = (gate["minimum"], gate["maximum"])
    if second:
        made.hub = graph["hubpenalty"]
    made.upkeep = upkeep(memory)
    return made


def upkeep(memory: dict) -> Upkeep:
    """Maintenance as the sections replay and consolidation ask for it."""
    out, replay, merge = Upkeep(), memory.get("replay") or {}, memory.get("consolidation") or {}
    if replay.get("enabled"):
        out.replay_every, out.replay_budget = max(1, int(replay.get("intervalwrites", 500))), int(replay.get("budgetpercycle", out.replay_budget))
        out.replay_strategy, out.replay_scale = str(replay.get("strategy", out.replay_strategy)), float(replay.get("learningscale", out.replay_scale))
    out.consolidate = bool(merge.get("enabled", False))
    out.similarity, out.group = float(merge.get("similaritythreshold", out.similarity)), int(merge.get("minimumgroupsize", out.group))
    out.capacity, out.capacity_bytes = int(merge.get("fixedcapacityepisodes", merge.get("max_episodes", 0)) or 0), int(merge.get("fixedcapacitybytes", 0) or 0)
    out.policy = str(merge.get("evictionpolicy", out.policy))
    return out


def doctor() -> dict[str, bool]:
    """Which optional packages can be imported."""
    return {n: importlib.util.find_spec(n) is not None for n in ("pyspark", "pandas", "numpy", "pyarrow", "yaml", "duckdb", "xxhash", "tokenizers", "regex")}
