"""Ways into a memory: by kind of store, as a backend for benchmark harnesses, and over a suite of configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from recallgrid.functions.ranges import running_sum
from recallgrid.operators.capsules import BoundMemory, BoundSettings
from recallgrid.operators.memory import Memory, Settings

from .registry import DATASETS, dataset


def open_memory(spark: SparkSession, store: str = "memory", path: str | None = None, engine: int = 1, settings: Settings | None = None) -> Memory:
    """An empty memory, or for a durable store (parquet, sqlite) the one saved at ``path``, if there is one."""
    if engine not in (1, 2):
        raise ValueError(f"unknown engine: {engine}")
    kind = Memory if engine == 1 else BoundMemory
    made = kind(settings or (Settings() if engine == 1 else BoundSettings()))
    name = store.lower()
    if name in ("memory", "in_memory", "ram"):
        return made
    if name not in ("parquet", "sqlite"):
        raise ValueError(f"unknown episode store: {store}")
    if path is None:
        raise ValueError("a durable store needs a path")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/episodes/_SUCCESS")
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return kind.load(spark, path, settings) if known else made


class Backend:
    """Batches of documents in, ranked documents out; ids are unique within ``ns``."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings
        self.reset()

    def reset(self) -> None:
        self.memory = Memory(self.settings)
        self._next = 0

    def insert(self, documents: DataFrame, ns: str = "default") -> DataFrame:
        """Documents have (id, content) and may have order, else they are written in order of id; content is a text or an array of (role, content). Gives (id, stored)."""
        content = F.col("content")
        if isinstance(documents.schema["content"].dataType, ArrayType):
            turn = lambda x: F.concat(F.coalesce(x["role"], F.lit("unknown")), F.lit(": "), F.coalesce(x["content"], F.lit("")))
            content = F.array_join(F.transform(content, turn), "\n")
        order = [F.col("order")] if "order" in documents.columns else []
        rows = documents.select("id", *order, F.coalesce(content, F.lit("")).alias("text"), F.lit(1).cast("long").alias("_one"))
        placed = running_sum(rows, [], [*order, F.col("id").cast("string")], "_one")
        rows = placed.select(F.lit(ns).alias("ns"), F.col("id").cast("string").alias("episode_id"), (F.col("_before") + self._next).alias("seq"), "text")
        self.memory.write(rows)
        self._next = self.memory.episodes.agg(F.max("seq")).first()[0] + 1
        return documents.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("stored"))

    def query(self, queries: DataFrame, k: int | None = None, ns: str = "default") -> DataFrame:
        """Queries have (query_id, text); gives (query_id, rank, id, text, score)."""
        usual = self.memory.settings.results
        self.memory.settings.results = usual if k is None else k
        try:
            found = self.memory.ask(queries.select(F.lit(ns).alias("ns"), "query_id", "text"))
        finally:
            self.memory.settings.results = usual
        return found.select("query_id", "rank", F.col("episode_id").alias("id"), "text", "score")


def run_suite(configs: list[str], run: Callable[[str, str], object], out: str, start: int = 0, stop: int | None = None, dry_run: bool = False) -> list[dict]:
    """The plan of a list of configurations, numbered by place; unless dry, each is handed with its folder to ``run`` in turn."""
    plan = []
    for place, config in list(enumerate(configs))[start:stop]:
        stem = config.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        plan.append({"index": place, "config": config, "outputdir": f"{out.rstrip('/')}/{place:02d}_{stem}"})
    for step in [] if dry_run else plan:
        run(step["config"], step["outputdir"])
    return plan


def prepare_datasets(spark: SparkSession, names: dict[str, dict], rows: int = 1) -> dict[str, int]:
    """Reads the first rows of each named dataset as a check of its schema; gives how many there were."""
    wanted = {n.lower().replace("-", "_"): p for n, p in names.items()}
    unknown = sorted(set(wanted) - set(DATASETS))
    if unknown:
        raise ValueError(f"unknown datasets: {unknown}")
    needed = ("example_id", "query", "events")
    found = {}
    for name, params in wanted.items():
        examples = dataset(spark, name, limit=rows, **params)
        missing = [c for c in needed if c not in examples.columns]
        if missing:
            raise ValueError(f"{name} lacks {missing}")
        found[name] = examples.count()
    return found
