"""Runs a memory over examples: one DataFrame program, a namespace per example."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle
from recallgrid.operators import metrics as A
from recallgrid.operators import stats as B
from recallgrid.operators import upkeep as U
from recallgrid.operators.capsules import BoundMemory, BoundSettings
from recallgrid.operators.gates import metadata, number
from recallgrid.operators.memory import Memory, Settings

from . import answers as AN
from . import experiment as X
from .registry import dataset, write_text

#: Columns of the results that a row of a run lists in order of rank, where the engine gives them.
LISTED = ("episode_id", "score", "exact", "associative", "temporal")


def opened(settings: Settings | None = None) -> Memory:
    return BoundMemory(settings) if isinstance(settings, BoundSettings) else Memory(settings)


def _events(rows: DataFrame) -> DataFrame:
    """The events of examples as a memory takes them; confidence and stream are what their metadata say."""
    given = lambda name: F.try_element_at("_m", F.lit(name))
    events = rows.select(F.col("example_id").alias("ns"), F.posexplode("events").alias("seq", "e"))
    events = events.select("ns", F.col("e.event_id").alias("episode_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("e.text", F.lit("")).alias("text"), "e.timestamp", F.coalesce("e.metadata", F.lit("{}")).alias("metadata"))
    told = events.withColumn("_m", metadata(F.col("metadata")))
    return told.withColumns({"confidence": number(given("confidence"), default=1.0), "stream": F.coalesce(given("stream_id"), F.lit("default"))}).drop("_m")


def run_examples(examples: DataFrame, settings: Settings | None = None, reader: AN.Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row of metrics per example, means per task and overall) of examples as the readers give them."""
    per_example, means, _, _ = measured(examples, settings, reader)
    return per_example, means


def measured(examples: DataFrame, settings: Settings | None = None, reader: AN.Reader | None = None) -> tuple[DataFrame, DataFrame, Memory, dict[str, float]]:
    """As ``run_examples``, with the memory and the seconds of writing and reading.

    The settings choose the engine. All examples are written and asked together, so seconds
    belong to the run, not to an example. A row lists what was retrieved, the steps, active
    features and edge visits of recall, and the bytes of its memory; with a ``reader`` its
    answer and the scores of that.
    """
    rows = settle(examples, "examples")
    queries = rows.select(F.col("example_id").alias("ns"), F.col("example_id").alias("query_id"), F.col("query").alias("text"))
    memory, began = opened(settings), time.perf_counter()
    memory.write(_events(rows))
    wrote = time.perf_counter()
    results = settle(memory.ask(queries), "results")
    seconds = {"write_seconds": wrote - began, "read_seconds": time.perf_counter() - wrote}
    ids = lambda column: rows.select(F.col("example_id").alias("query_id"), F.explode(column).alias("episode_id"))
    gold, negative = ids("evidence_ids"), ids("negative_ids")
    answers = rows.select(F.col("example_id").alias("query_id"), F.explode("answers").alias("answer"))
    listed = [c for c in LISTED if c in results.columns]
    ranked = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *listed))).alias("_r"))  # as many as the settings' results
    ranked = ranked.select("query_id", *[F.col(f"_r.{c}").alias("retrieved_ids" if c == "episode_id" else f"retrieved_{c}s") for c in listed])
    scored = queries.select("query_id").withColumn("recall_steps", F.lit(memory.settings.steps))
    trail = memory.visits().select("query_id", F.col("active").alias("recall_active_features"), F.col("visits").alias("recall_message_edge_visits"))
    size = U.sizes(memory).select(F.col("ns").alias("query_id"), F.col("episode_bytes").alias("memory_episode_bytes"), F.col("graph_bytes").alias("memory_graph_bytes"), (F.col("episode_bytes") + F.col("graph_bytes")).alias("memory_bytes_total"))
    graphs = memory.stats().drop("episodes").withColumnRenamed("ns", "query_id")
    for part in (
        A.retrieval_metrics(results, gold, queries),
        A.share_in(results, negative, "negative_hit_rate", queries=queries),
        A.top_in(results, gold, "source_attribution", queries),
        A.any_in(results, gold, "hidden_state_accuracy", queries=queries),
        A.false_association(results, gold, negative, queries).withColumnRenamed("rate", "false_association"),
        A.answer_in_retrieved(results, answers).withColumnRenamed("found", "answer_in_retrieved"),
        trail,
        size,
        graphs,
    ):
        scored = scored.join(part, "query_id", "left")
    counts = [c for part in (trail, size, graphs) for c in part.columns if c != "query_id"]
    scored = scored.fillna(0, [*counts, "answer_in_retrieved"]).join(ranked, "query_id", "left")
    if reader is not None:
        scored = scored.join(_answered(rows, queries, results, reader), "query_id", "left")
    per_example = rows.select(F.col("example_id").alias("query_id"), "task", "query", "answers", "evidence_ids", "negative_ids").join(scored, "query_id").withColumnRenamed("query_id", "example_id")
    per_example = settle(per_example, "per_example")
    return per_example, A.task_means(per_example, "task", A.metric_names(per_example)), memory, seconds


def _answered(rows: DataFrame, queries: DataFrame, results: DataFrame, reader: AN.Reader) -> DataFrame:
    """(query_id, prediction, exact_match, substring_match, token_f1)."""
    told = results.withColumn("source", F.col("episode_id").cast("string"))
    made = AN.augmented_answers(queries.select("query_id", F.col("text").alias("question")), told, reader)
    said = settle(made.join(rows.select(F.col("example_id").alias("query_id"), F.col("answers").alias("_a")), "query_id"), "answers").withColumn("answer", F.coalesce("answer", F.lit("")))
    f1 = A.token_f1(said.select("query_id", "answer", F.explode("_a").alias("_one")), "query_id", "answer", "_one").withColumnRenamed("f1", "token_f1")
    scores = {"exact_match": A.exact_match(F.col("answer"), F.col("_a")), "substring_match": A.substring_match(F.col("answer"), F.col("_a"))}
    return said.select("query_id", F.col("answer").alias("prediction"), *[v.alias(n) for n, v in scores.items()]).join(f1, "query_id", "left").fillna(0.0, ["token_f1"])


def run_experiment(spark: SparkSession, config: dict, out: str | None = None, limit: int | None = None, reader: AN.Reader | None = None) -> dict:
    """Runs a resolved configuration; writes resolved_config, environment, per_example, summary and graph below ``out``, and gives the summary."""
    folder = (out or config["outputdir"]).rstrip("/")
    evaluation = dict(config["evaluation"])
    most = limit if limit is not None else evaluation.get("limit")
    if evaluation.get("resume_store") or not evaluation.get("resetbetweenexamples", True):
        raise NotImplementedError("a run has a memory for each example")
    if reader is None and config["generator"].get("type", "none") != "none":
        raise ValueError("a generator needs a reader")
    about = X.environment(config)
    write_text(spark, json.dumps(config, indent=2, default=str), f"{folder}/resolved_config")
    write_text(spark, json.dumps(about, indent=2), f"{folder}/environment")
    given = dict(config["dataset"])
    examples = dataset(spark, given["type"], chunk=given.get("chunk"), limit=most, **named(given.get("params", {})))
    per_example, means, memory, seconds = measured(examples, X.settings(config), reader)
    per_example.write.mode("overwrite").json(f"{folder}/per_example")
    memory.save(f"{folder}/graph")
    names = A.metric_names(per_example)
    long = per_example.select("example_id", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["example_id"], names, "metric", "value")
    intervals = B.bootstrap_ci(long, "metric", "value", "example_id", int(evaluation.get("bootstrapsamples", 2000)), seed=int(config["seed"]))
    by_task: dict[str, dict[str, float]] = {}
    for r in means.filter("task IS NOT NULL").collect():  # a row for each task and metric
        by_task.setdefault(r.task, {})[r.metric] = r["mean"]
    aggregate = {"examples": per_example.count(), "bootstrap_unit": "example", "by_task": by_task} | seconds
    aggregate |= {r.metric: {k: r[k] for k in ("estimate", "lower", "upper", "level", "samples")} for r in intervals.collect()}  # a row for each metric
    summary = {"name": config["name"], "created_at": datetime.now(UTC).isoformat(), "config": config, "environment": about, "aggregate": aggregate}
    write_text(spark, json.dumps(summary, indent=2, default=str), f"{folder}/summary")
    return summary


#: Names that configurations use for the parameters of the generators.
PARAMETERS = {"examplespertask": "n", "examples": "n"}


def named(params: dict) -> dict:
    return {PARAMETERS.get(k, k): v for k, v in params.items()}


#: A run without files or packages beyond the engine's own.
SMOKE = {
    "name": "smoke",
    "seed": 7,
    "dataset": {"type": "synthetic", "params": {"tasks": ["paired_associate", "multi_hop", "hub_distractor"], "n": 2, "distractors": 5, "seed": 7}},
    "memory": {"encoder": {"type": "hashing", "params": {"dimension": 8192, "topk": 64}}, "graph": {"rule": "hebb", "maxdegree": 96, "maxpairfeatures": 64}, "retrieval": {"candidatelimit": 200, "featuretopk": 96}},
    "evaluation": {"bootstrapsamples": 500},
    "outputdir": "runs/smoke",
}
