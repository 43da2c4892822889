"""Episode store operators: upsert, delete, postings, candidate votes and the full-scan fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .postings import top_votes


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key, by ``order``."""
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc())))
    return ranked.filter("_r = 1").drop("_r")


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


EPISODE = "episode_id string, text string, code struct<dimension:int,indices:array<int>,values:array<double>>, timestamp string, salience double, confidence double, source map<string,string>, payload string, metadata string"


def episodes_to_json(episodes: DataFrame) -> DataFrame:
    """(episode_id, json): an episode with all the columns of EPISODE that the table has, null ones left out."""
    names = [c.split(" ")[0] for c in EPISODE.split(", ") if c.split(" ")[0] in episodes.columns]
    return episodes.select("episode_id", F.to_json(F.struct(*names)).alias("json"))


def episodes_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """The columns of EPISODE; salience and confidence are 1 where they are missing, a text that is no object fails."""
    read = F.from_json(column, EPISODE, {"mode": "FAILFAST"})
    rows = texts.select(read.alias("e")).select("e.*")
    return rows.fillna(1.0, ["salience", "confidence"])


def scan(episodes: DataFrame, order: str = "seq") -> DataFrame:
    """All episodes in store order, ties by id: a range exchange, no single task."""
    return episodes.orderBy(order, "episode_id")


def posting_stats(postings: DataFrame, episode: str = "episode_id") -> DataFrame:
    return postings.agg(F.countDistinct(episode).alias("episodes"), F.count(F.lit(1)).alias("entries"), F.countDistinct("feature").alias("features"))


def candidate_votes(queries: DataFrame, postings: DataFrame, limit: int, on: list[str] = ["feature"], query: str = "query_id", episode: str = "episode_id") -> DataFrame:  # noqa: B006
    """(query, episode, votes, rank): episodes by number of shared features, ties by id, ``limit`` a query; hot features by bounds and blocks."""
    return top_votes(queries.select(*on, query), postings.select(*on, episode), limit, on, query, episode)


def candidate_union(votes: DataFrame, scores: DataFrame, limit: int, query: str = "query_id", episode: str = "episode_id") -> DataFrame:
    """(query, episode): the voted candidates and the ``limit`` episodes with the highest scores of a query."""
    order = W.partitionBy(query).orderBy(F.col("score").desc(), episode)
    best = scores.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)
    return votes.select(query, episode).unionByName(best.select(query, episode)).distinct()


def with_fallback(votes: DataFrame, queries: DataFrame, episodes: DataFrame, limit: int, query: str = "query_id", episode: str = "episode_id") -> DataFrame:
    """(query, episode): the votes, and all episodes for a query without any if the store holds no more than ``limit``.

    The fallback pairs at most ``limit`` episodes with a query: the size is counted first.
    """
    found = votes.select(query, episode)
    store = episodes.select(episode).limit(limit + 1)
    if store.count() > limit:
        return found
    missed = queries.select(query).distinct().join(found.select(query).distinct(), query, "left_anti")
    every = store.agg(F.collect_list(episode).alias("_all"))
    return found.unionByName(missed.join(F.broadcast(every)).select(query, F.explode("_all").alias(episode)))


def not_rejected(episodes: DataFrame, status: str = "status") -> DataFrame:
    return episodes.filter(F.coalesce(F.col(status), F.lit("observed")) != "rejected")


def source_checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def feature_lookup(texts: DataFrame, features: DataFrame, text: str = "text", checksum: str = "textsha256") -> DataFrame:
    """Joins precomputed features by the text's digest; fails if a text has none or a digest is repeated."""
    if not features.groupBy(checksum).count().filter("count > 1").isEmpty():
        raise ValueError("a digest has several feature rows")
    keyed = texts.withColumn(checksum, F.sha2(F.col(text), 256))
    missing = keyed.join(features, checksum, "left_anti").limit(1).collect()
    if missing:
        raise KeyError(missing[0][checksum])
    return keyed.join(features, checksum)


def export_features(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per distinct text, the first by ``key``, with its digest."""
    hashed = texts.withColumn("textsha256", F.sha2(F.col(text), 256))
    first = hashed.groupBy("textsha256").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    return first
