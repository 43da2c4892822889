"""Joins over posting lists that hold features of any frequency.

A feature is hot if its list has a ten-thousandth of all postings or more, ``LEAST`` at
least; there can be no more than ten thousand of them, so what is known of them goes by
broadcast. Their lists are dealt into blocks of that size by a hash of the row, so no
task gets a whole hot list. Nothing is left out: where a search can stop early, it does so
by a bound that what it has not seen cannot pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle

from .tiles import packed, pairs

#: Pairs that an equality join may make for each row that goes into it; beyond them tiles are cheaper, as nothing is shuffled for a pair.
DENSE = 64
#: Postings of a hot feature at least, and the share of all postings that makes one hot.
LEAST, SHARE = 4096, 1 / 10_000


def hot_features(postings: DataFrame, on: list[str]) -> tuple[DataFrame | None, int]:
    """((on..., _blocks) of the hot features, or None where there are none; postings in a block)."""
    sizes = postings.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    size = max(LEAST, int((total or 0) * SHARE))
    if (most or 0) < size:
        return None, size
    hot = sizes.filter(F.col("_n") >= size).select(*on, F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    return settle(hot, "hot-features"), size


def dense(a: DataFrame, b: DataFrame, on: list[str]) -> bool:
    """Whether the equality join of ``a`` and ``b`` makes more than ``DENSE`` pairs for each of their rows."""
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(name))
    met = count(a, "_a").join(count(b, "_b"), on, "full").fillna(0, ["_a", "_b"])
    made, rows = met.agg(F.sum(F.col("_a") * F.col("_b")), F.sum(F.col("_a") + F.col("_b"))).first()
    return (made or 0) > DENSE * (rows or 0)


def _block(row: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(row), F.coalesce(blocks, F.lit(1))).cast("int")


def tiled_join(a: DataFrame, b: DataFrame, on: list[str], a_row: str, b_row: str) -> DataFrame:
    """The join of ``a`` and ``b`` on ``on``, keys that are hot on a side by tiles: blocks of its list, each met by all blocks of the other's."""
    hot_a, _ = hot_features(a, on)
    hot_b, _ = hot_features(b, on)
    if hot_a is None and hot_b is None:
        return a.join(b, on)

    def marked(df: DataFrame) -> DataFrame:
        for hot, name in ((hot_a, "_in_a"), (hot_b, "_in_b")):
            df = df.withColumn(name, F.lit(1)) if hot is None else df.join(F.broadcast(hot.withColumnRenamed("_blocks", name)), on, "left").fillna(1, [name])
        return df

    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = marked(a).withColumn("_i", _block(F.col(a_row), F.col("_in_a"))).withColumn("_j", every("_in_b")).drop("_in_a", "_in_b")
    right = marked(b).withColumn("_j", _block(F.col(b_row), F.col("_in_b"))).withColumn("_i", every("_in_a")).drop("_in_a", "_in_b")
    return left.join(right, [*on, "_i", "_j"]).drop("_i", "_j")


def top_votes(queries: DataFrame, postings: DataFrame, limit: int, on: list[str], query: str, episode: str, span: tuple[str, str, str] | None = None) -> DataFrame:
    """(query, episode, votes, rank): the ``limit`` episodes that share most features with a query, ties by id.

    Rare features vote first. With h hot features in a query and a limit-th best count of
    more than h, an episode that no rare feature names cannot come in, and one whose votes
    and h together stay below that count neither; only the others are looked up in the
    hot lists, by feature and episode. Queries whose rare features do not decide this go
    through all their lists, by tiles, and so do all where most features are shared by many. ``span`` names a time of the queries and two of the
    postings, of which the first must be earlier and the second not, or null.
    """
    seen = None if span is None else F.expr("{1} < {0} AND ({2} IS NULL OR {0} <= {2})".format(*span))
    asked = queries.dropDuplicates([*on, query])
    counted = lambda df: (df if seen is None else df.filter(seen)).groupBy(query, episode).agg(F.count(F.lit(1)).alias("votes"))
    order = W.partitionBy(query).orderBy(F.col("votes").desc(), episode)
    if dense(asked, postings, on):
        return _tiled_votes(asked, postings, limit, on, query, episode, span).withColumn("rank", F.row_number().over(order))
    hot, _ = hot_features(postings, on)
    if hot is None:
        votes = counted(asked.join(postings, on))
    else:
        heat = F.broadcast(hot.select(*on))
        rare = settle(counted(asked.join(heat, on, "left_anti").join(postings.join(heat, on, "left_anti"), on)), "rare-votes")
        hot_asked = settle(asked.join(heat, on, "left_semi"), "hot-asked")
        ranked = rare.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == limit).select(query, F.col("votes").alias("_least"))
        many = hot_asked.groupBy(query).agg(F.count(F.lit(1)).alias("_h"))
        known = asked.select(query).distinct().join(many, query, "left").join(ranked, query, "left").fillna(0, ["_h", "_least"])
        known = settle(known.withColumn("_done", (F.col("_h") == 0) | (F.col("_least") > F.col("_h"))), "bounds")
        done = known.filter("_done").select(query, "_h", "_least")
        near = rare.join(done, query).filter(F.col("votes") + F.col("_h") >= F.col("_least")).select(query, episode, "votes")
        near = settle(near, "near")
        probes = near.select(query, episode).join(hot_asked, query)
        more = counted(probes.join(postings.join(heat, on, "left_semi"), [*on, episode])).withColumnRenamed("votes", "_more")
        closed = near.join(more, [query, episode], "left").select(query, episode, (F.col("votes") + F.coalesce("_more", F.lit(0))).alias("votes"))
        left = asked.join(known.filter("NOT _done").select(query), query, "left_semi")
        votes = closed.unionByName(_tiled_votes(left, postings, limit, on, query, episode, span))
    return votes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(query, episode, "votes", "rank")


def _tiled_votes(asked: DataFrame, postings: DataFrame, limit: int, on: list[str], query: str, episode: str, span: tuple[str, str, str] | None) -> DataFrame:
    """(query, episode, votes): the ``limit`` best of each query, whose pairs with all episodes are made and counted in tiles."""
    groups, kept = on[:-1], (list(span[:1]), list(span[1:])) if span else ([], [])
    sided = lambda df, row, times: df.select(*groups, row, *times, F.col(on[-1]).alias("feature"), F.lit(1.0).alias("w"))
    left, right = sided(asked, query, kept[0]), sided(postings, episode, kept[1])
    right = right.join(left.select(*groups).distinct(), groups, "left_semi") if groups else right
    one = lambda df, row, times: packed({"m": df}, [*groups, row, *times], marks=("m",))
    found = pairs(one(left, query, kept[0]), one(right, episode, kept[1]), groups, query, episode, {"votes": ("m", "m")}, "votes", limit=limit, span=span)
    return found.select(query, episode, F.col("votes").cast("long").alias("votes"))


def row_dots(a: DataFrame, b: DataFrame, a_key: str, b_key: str, on: list[str]) -> DataFrame:
    """(a_key, b_key, dot, overlap) of all pairs of vectors that share an entry; hot features by tiles, with partial sums."""
    left, right = a.select(*on, a_key, F.col("w").alias("_wa")), b.select(*on, b_key, F.col("w").alias("_wb"))
    joined = tiled_join(left, right, on, a_key, b_key)
    return joined.groupBy(a_key, b_key).agg(F.sum(F.col("_wa") * F.col("_wb")).alias("dot"), F.count(F.lit(1)).alias("overlap"))


def own_dots(rows: DataFrame, key: str, least: float | None = None, group: str = "ns") -> DataFrame:
    """(group, a, b, dot, overlap) of the pairs of one table (group, key, feature, w) that share an entry, a < b, with dot of ``least`` or more; made in tiles, so no pair is shuffled."""
    p = packed({"w": rows, "m": rows}, [group, key], marks=("m",))
    p = settle(p.withColumnRenamed(key, "a"), "packed")
    made = pairs(p, p.withColumnRenamed("a", "b"), [group], "a", "b", {"overlap": ("m", "m"), "dot": ("w", "w")}, "overlap", by=None if least is None else "dot", least=least, half=True)
    return made.withColumn("overlap", F.col("overlap").cast("long"))
