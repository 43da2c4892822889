"""Scores, ranking, feedback and prompt injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXACT, ASSOCIATIVE, TEMPORAL = 0.65, 0.30, 0.05


def recency_score(ts: Column, as_of: Column, half_life_days: float = 30.0) -> Column:
    """Halves every ``half_life_days``; 0 for a missing time, 1 for one in the future."""
    age = F.greatest(F.lit(0.0), (as_of.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 86400.0)
    return F.when(ts.isNotNull(), F.pow(F.lit(2.0), -age / max(half_life_days, 1e-6))).otherwise(0.0)


def score_parts(candidates: DataFrame, codes: DataFrame, states: dict[str, DataFrame]) -> DataFrame:
    """(ns, query_id, episode_id, and one dot product per named state): one join for all states."""
    tagged = None
    for name, state in states.items():
        rows = state.select("ns", "query_id", "feature", *[(F.col("v") if n == name else F.lit(0.0)).alias(n) for n in states])
        tagged = rows if tagged is None else tagged.unionByName(rows)
    packed = tagged.groupBy("ns", "query_id", "feature").agg(*[F.sum(n).alias(n) for n in states])
    episodes = candidates.select("ns", "query_id", "episode_id").join(codes.select("ns", "episode_id", "feature", "w"), ["ns", "episode_id"])
    hit = episodes.join(packed, ["ns", "query_id", "feature"], "left")
    return hit.groupBy("ns", "query_id", "episode_id").agg(*[F.coalesce(F.sum(F.col("w") * F.col(n)), F.lit(0.0)).alias(n) for n in states])


def ranked(scored: DataFrame, k: int, score: str = "score", keys: tuple[str, ...] = ("ns", "query_id")) -> DataFrame:
    finite = scored.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))))
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), "episode_id")
    return finite.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_v1(parts: DataFrame, recency: Column | float = 0.0, confidence: Column | float = 0.0, recency_weight: float = 0.0, confidence_weight: float = 0.0, exact: float = EXACT, associative: float = ASSOCIATIVE, temporal: float = TEMPORAL) -> DataFrame:
    value = exact * F.col("exact") + associative * F.col("associative") + temporal * F.col("temporal")
    return parts.withColumn("score", value + recency_weight * F.lit(recency) + confidence_weight * F.lit(confidence))


def score_v2(parts: DataFrame, episode_weight: float = 0.20, context_weight: float = 0.10, risk_weight: float = 0.20, recency_weight: float = 0.0, confidence_weight: float = 0.0, exact: float = EXACT, associative: float = ASSOCIATIVE, temporal: float = TEMPORAL, rejected: bool = False) -> DataFrame:
    """Adds score from exact, associative, temporal, recency, confidence, episode_node, context, risk, authority and status; rejected rows go unless ``rejected``."""
    factor = F.when(F.col("status") == "hypothetical", 0.1).when(F.col("status") == "superseded", 0.2).otherwise(1.0)
    trust = F.when(F.col("status") == "superseded", 0.2).otherwise(1.0)
    value = (
        exact * F.col("exact") + associative * F.col("associative") + temporal * F.col("temporal")
        + recency_weight * F.col("recency") + confidence_weight * F.col("confidence") * trust
        + episode_weight * F.col("episode_node") + context_weight * F.col("context") - risk_weight * F.col("risk")
    )
    kept = parts if rejected else parts.filter("status <> 'rejected'")
    return kept.withColumn("score", value * F.greatest(F.lit(0.0), F.col("authority") * factor))


def access_record(episodes: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Access counts and times after a batch of results."""
    hits = results.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_hits"))
    joined = episodes.join(hits, "episode_id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0).cast("long"))).withColumn("last_access", F.when(F.col("_hits").isNotNull(), as_of).otherwise(F.col("last_access"))).drop("_hits")


def after_use(results: DataFrame, verified: bool | None = None) -> DataFrame:
    """(episode_id, confidence and authority changes) from rank (from 1) and has_checksum.

    Verified results, or without a verdict those with a checksum, gain by rank; failed ones lose.
    """
    if verified is False:
        return results.groupBy("episode_id").agg(F.sum(F.lit(-0.10)).alias("confidence_change"), F.sum(F.lit(-0.05)).alias("authority_change"))
    good = F.lit(True) if verified else F.col("has_checksum")
    gain = lambda most: F.sum(F.when(good, most * (1.0 / F.col("rank"))).otherwise(0.0))
    return results.groupBy("episode_id").agg(gain(0.02).alias("confidence_change"), gain(0.01).alias("authority_change"))


def with_feedback(episodes: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Episodes after ``after_use``: confidence and authority stay within 0 and 2, used ones count an access and become labile."""
    joined = episodes.join(changes, "episode_id", "left")
    used = F.col("confidence_change").isNotNull()
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col(c) + F.coalesce(f"{c}_change", F.lit(0.0))))
    return (
        joined.withColumn("confidence", within("confidence"))
        .withColumn("authority", within("authority"))
        .withColumn("access_count", F.col("access_count") + used.cast("long"))
        .withColumn("last_access", F.when(used, as_of).otherwise(F.col("last_access")))
        .withColumn("labile", used)
        .drop("confidence_change", "authority_change")
    )


# Fixed texts of the prompt.
INSTRUCTION = (
    "Use the retrieved memories only when relevant. Cite memory IDs in the answer. "
    "Do not treat an associative match as verified unless its source text supports the claim."
)
CUT, NOTHING = "\n[TRUNCATED]", "[No memory retrieved]"


def inject(queries: DataFrame, results: DataFrame, budget: int = 24_000) -> DataFrame:
    """(query_id, prompt, memory_characters, n_memories, truncated).

    ``queries`` has (query_id, question); ``results`` has (query_id, rank, episode_id,
    score, source, text). Blocks go in by rank while they fit the budget of characters;
    the first that does not is cut and marked if its header and 16 characters fit.
    """
    source = F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.concat(F.lit("; source="), F.col("source"))).otherwise("")
    header = F.concat(F.lit("[Memory "), F.col("rank").cast("string"), F.lit("; id="), F.col("episode_id").cast("string"), F.lit("; score="), F.format_string("%.4f", F.col("score")), source, F.lit("]"))
    sized = results.withColumn("_h", header).withColumn("_b", F.concat("_h", F.lit("\n"), "text"))
    sized = sized.withColumn("_end", F.sum(F.length("_b")).over(W.partitionBy("query_id").orderBy("rank")))
    sized = sized.withColumn("_left", F.lit(budget) - (F.col("_end") - F.length("_b")))
    room = F.greatest(F.lit(0), F.col("_left") - F.length("_h") - len(CUT) - 1).cast("int")
    short = F.concat("_h", F.lit("\n"), F.substring(F.col("text"), F.lit(1), room), F.lit(CUT))
    whole = F.col("_end") <= budget
    edge = ~whole & (F.col("_left") >= 0)
    parts = sized.withColumn("_p", F.when(whole, F.col("_b")).when(edge & (F.col("_left") > F.length("_h") + 16), short))
    made = parts.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("rank", "_p")))).alias("_a"),
        F.sum(F.length("_p")).alias("memory_characters"),
        F.count("_p").alias("n_memories"),
        F.max(~whole).alias("truncated"),
    )
    context = F.when(F.size("_a") > 0, F.array_join(F.transform("_a", lambda x: x["_p"]), "\n\n")).otherwise(NOTHING)
    joined = queries.join(made, "query_id", "left").withColumn("_c", F.coalesce(context, F.lit(NOTHING)))
    prompt = F.concat(F.lit(INSTRUCTION + "\n\n"), F.col("_c"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAnswer:"))
    zero = F.lit(0).cast("long")
    return joined.select("query_id", prompt.alias("prompt"), F.coalesce("memory_characters", zero).alias("memory_characters"), F.coalesce("n_memories", zero).alias("n_memories"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
