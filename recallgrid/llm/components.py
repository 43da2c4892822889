"""Connected components of a link table, by alternating large-star and small-star rounds.

No task holds a component: a round is a partial minimum per node and a join of the links
with it; nodes with a large share of the links go by a broadcast of bounded size. Rounds
grow with the logarithm of the longest path. Every half of a round is written to the shared
folder, so that the driver plans a few joins at a time. They end when only stars are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_safe_lookup, written


def find(parent: dict, x):
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent[up]
        x = up
    return x


def spanning(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its part) for all nodes of the pairs but those smallest ones."""
    parent: dict[int, int] = {}
    for a, b in pairs:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(parent, x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = spanning(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        both = np.array(made, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _stars_only(edges: DataFrame) -> bool:
    """Whether each part is a star whose centre is its smallest node, which a round would leave as it is."""
    ends = edges.selectExpr("a AS x", "1 AS up", "0 AS down").unionByName(edges.selectExpr("b AS x", "0 AS up", "1 AS down"))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _toward_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each pair with m, the smallest of u and its partners."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m")), "least")
    return hot_safe_lookup(pairs, least, "u", "_n", total, most=least.agg(F.max("_n")).first()[0] or 0)


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) long pairs to (node, root): every node that has a link to another, with its part's smallest node."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contract, "a long, b long").distinct()
    edges = written(edges, "links")
    while not _stars_only(edges):
        total = edges.count()
        both = edges.selectExpr("a AS u", "b AS v").unionByName(edges.selectExpr("b AS u", "a AS v"))
        # Written, as the next step reads it several times and a plan of both would hold each of them over again.
        large = written(_toward_least(both, 2 * total).filter("v > u").selectExpr("v AS u", "m AS v").filter("u <> v").distinct(), "large-stars")
        near = _toward_least(large, total)
        small = near.selectExpr("u AS a", "m AS b").unionByName(near.selectExpr("v AS a", "m AS b")).filter("a <> b").distinct()
        edges = written(small, "links")
    return edges.selectExpr("a AS node", "b AS root")
