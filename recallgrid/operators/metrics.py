"""Answer and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.text import normalize_answer


def exact_match(prediction: Column, answers: Column) -> Column:
    return F.exists(answers, lambda a: normalize_answer(a) == normalize_answer(prediction)).cast("double")


def substring_match(prediction: Column, answers: Column) -> Column:
    """An answer that normalises to nothing, such as an article, is in every prediction; an empty one is left out."""
    return F.exists(answers, lambda a: (a != "") & F.contains(normalize_answer(prediction), normalize_answer(a))).cast("double")


def token_f1(pairs: DataFrame, key: str, prediction: str, answer: str) -> DataFrame:
    """(key, f1): multiset overlap of normalised tokens, the best over the answers of a key."""
    toks = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != "")
    cut = pairs.select(key, answer, toks(prediction).alias("_p"), toks(answer).alias("_a"))
    shared = F.aggregate(F.array_distinct("_a"), F.lit(0), lambda s, w: s + F.least(F.size(F.filter("_a", lambda x: x == w)), F.size(F.filter("_p", lambda x: x == w))))
    sized = cut.withColumn("_o", shared).withColumn("_np", F.size("_p")).withColumn("_na", F.size("_a"))
    precision, recall = F.col("_o") / F.col("_np"), F.col("_o") / F.col("_na")
    score = F.when((F.col("_np") == 0) | (F.col("_na") == 0), ((F.col("_np") == 0) & (F.col("_na") == 0)).cast("double")).when(F.col("_o") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return sized.withColumn("_f", score).groupBy(key).agg(F.max("_f").alias("f1"))


def retrieval_metrics(results: DataFrame, relevance: DataFrame, queries: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) of ranked results (query_id, rank, episode_id).

    ``relevance`` has (query_id, episode_id); a query without any has null metrics. With
    ``sizes`` (query_id, n), the number of relevant episodes, it may leave out what no result names.
    """
    gold = relevance.select("query_id", "episode_id").distinct()
    hits = results.join(gold.withColumn("_hit", F.lit(1)), ["query_id", "episode_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    gain = 1 / F.log2(F.col("rank") + 1.0)
    got = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_hit").alias("_h"),
        F.countDistinct(F.when(F.col("_hit") == 1, F.col("episode_id"))).alias("_d"),
        F.max(F.when(F.col("_hit") == 1, 1 / F.col("rank"))).alias("_rr"),
        F.sum(F.when(F.col("_hit") == 1, gain).otherwise(0.0)).alias("_dcg"),
    )
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("_gold")) if sizes is None else sizes.select("query_id", F.col("n").alias("_gold"))
    all_ = queries.select("query_id").distinct().join(got, "query_id", "left").join(sizes, "query_id", "left").fillna(0, ["_n", "_h", "_d"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("_gold", "_n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    known = F.col("_gold").isNotNull()
    some = F.col("_n") > 0
    return all_.select(
        "query_id",
        F.when(known, F.col("_d") / F.col("_gold")).alias("recall"),
        F.when(known, F.when(some, F.col("_h") / F.col("_n")).otherwise(0.0)).alias("precision"),
        F.when(known, F.coalesce("_rr", F.lit(0.0))).alias("mrr"),
        F.when(known, F.when(some, F.col("_dcg") / ideal).otherwise(0.0)).alias("ndcg"),
    )


def _every(found: DataFrame, queries: DataFrame | None, name: str) -> DataFrame:
    """Adds the queries without results, with 0."""
    if queries is None:
        return found
    return queries.select("query_id").distinct().join(found, "query_id", "left").fillna(0.0, [name])


def share_in(results: DataFrame, ids: DataFrame, name: str, keys: tuple[str, ...] = ("query_id", "episode_id"), queries: DataFrame | None = None) -> DataFrame:
    """(query_id, name): the share of a query's results that are in ``ids`` (hub capture, negative hits); 0 without results."""
    on = [k for k in keys if k in ids.columns]
    hit = results.join(ids.select(*on).distinct().withColumn("_hit", F.lit(1.0)), on, "left")
    return _every(hit.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias(name)), queries, name)


def top_in(results: DataFrame, relevance: DataFrame, name: str = "attributed", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, name): whether the first result is relevant; 0 without results."""
    gold = relevance.select("query_id", "episode_id").distinct().withColumn("_hit", F.lit(1.0))
    first = results.filter("rank = 1").join(gold, ["query_id", "episode_id"], "left").select("query_id", F.coalesce("_hit", F.lit(0.0)).alias(name))
    return _every(first, queries, name)


def any_in(results: DataFrame, relevance: DataFrame, name: str = "found", hidden_id: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, name): whether any result, or the hidden state it names, is relevant; 0 without results."""
    gold = relevance.select("query_id", F.col("episode_id").alias("_g")).distinct()
    ids = [F.col("episode_id")] + ([F.col(hidden_id)] if hidden_id else [])
    long = results.select("query_id", F.explode(F.array(*ids)).alias("_g"))
    hit = long.join(gold.withColumn("_hit", F.lit(1.0)), ["query_id", "_g"], "left")
    return _every(hit.groupBy("query_id").agg(F.max(F.coalesce("_hit", F.lit(0.0))).alias(name)), queries, name)


def false_association(results: DataFrame, relevance: DataFrame, negatives: DataFrame, queries: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """(query_id, rate): results that are negative, or not relevant where anything is; 0 without results.

    With ``judged`` (query_id), the queries for which anything is relevant, ``relevance`` and
    ``negatives`` may leave out what no result names.
    """
    pos = relevance.select("query_id", "episode_id").distinct().withColumn("_p", F.lit(True))
    neg = negatives.select("query_id", "episode_id").distinct().withColumn("_n", F.lit(True))
    some = (relevance if judged is None else judged).select("query_id").distinct().withColumn("_s", F.lit(True))
    j = results.join(pos, ["query_id", "episode_id"], "left").join(neg, ["query_id", "episode_id"], "left").join(some, "query_id", "left")
    wrong = F.col("_n").isNotNull() | (F.col("_s").isNotNull() & F.col("_p").isNull())
    return _every(j.groupBy("query_id").agg(F.avg(wrong.cast("double")).alias("rate")), queries, "rate")


def answer_in_retrieved(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, found): an answer is in the results' texts, joined in order of rank and normalised."""
    texts = results.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    asked = answers.groupBy("query_id").agg(F.collect_list("answer").alias("_a"))
    return texts.join(asked, "query_id").select("query_id", substring_match(F.col("_t"), F.col("_a")).alias("found"))


def bytes_per_fact(size: Column, retained: Column) -> Column:
    return F.when(retained > 0, size / retained).otherwise(F.lit(float("inf")))


def forgetting_curve(rows: DataFrame, distance: str, score: str) -> DataFrame:
    return rows.groupBy(distance).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def task_means(rows: DataFrame, task: str, metrics: list[str]) -> DataFrame:
    """(task, metric, mean, n) for each task and, with a null task, overall; non-finite values are left out."""
    long = rows.select(task, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([task], metrics, "metric", "value")
    finite = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    both = finite.cube(task, "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("metric").alias("_g"))
    return both.filter("_g = 0").drop("_g")


def metric_names(df: DataFrame, without: tuple[str, ...] = ("recall_steps",)) -> list[str]:
    """Numeric and boolean columns, the metrics of a result table."""
    kinds = ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint")
    return [n for n, k in df.dtypes if k in kinds and n not in without]


def repeated(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).count().filter("count > 1").isEmpty()


def paired(baseline: DataFrame, treatment: DataFrame, key: str = "example_id", score: str = "score") -> DataFrame:
    """(key, baseline, treatment, side): a full outer pairing that tells what is unpaired; repeated keys fail."""
    for name, df in (("baseline", baseline), ("treatment", treatment)):
        if repeated(df, key):
            raise ValueError(f"repeated {key} in {name}")
    b, t = baseline.select(key, F.col(score).alias("baseline")), treatment.select(key, F.col(score).alias("treatment"))
    joined = b.withColumn("_b", F.lit(True)).join(t.withColumn("_t", F.lit(True)), key, "full_outer")
    side = F.when(F.col("_b").isNull(), "treatment").when(F.col("_t").isNull(), "baseline").otherwise("both")
    return joined.select(key, "baseline", "treatment", side.alias("side"))


def holm(p_values: DataFrame, name: str = "name", p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds adjusted p-value, threshold and rejection of the step-down procedure."""
    finite = p_values.filter(F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf"))))
    order = W.partitionBy(F.lit(0)).orderBy(p, name)  # a row per tested hypothesis
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    ranked = finite.withColumn("_left", n - F.row_number().over(order) + 1).withColumn("threshold", alpha / F.col("_left"))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.withColumn("adjusted_p_value", F.max(F.least(F.lit(1.0), F.col("_left") * F.col(p))).over(upto))
    return ranked.withColumn("reject", F.min((F.col(p) <= F.col("threshold")).cast("int")).over(upto) == 1).drop("_left")


def text_primary_violations(rows: DataFrame) -> DataFrame:
    """Rows of a run that used text for scoring."""
    return rows.filter(F.coalesce(F.col("text_used_for_scoring"), F.lit(False)))
