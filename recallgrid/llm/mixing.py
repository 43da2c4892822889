"""Mixing sources to target weights with DataFrame functions only.

The tree is domain, language, source. A token budget is handed down: among siblings in
proportion to their weights, but no more to any than its leaves can give (their tokens
times ``max_epochs``). What one child cannot use goes to its siblings; only what a whole
subtree cannot use reaches the siblings of its ancestor, because the capacity of a node
is that of its subtree. This water filling has a closed form: with children in order of
capacity by weight, those that are full form a prefix, found by running sums.

A leaf whose budget is m times its tokens and a rest takes m whole epochs and, of one
more epoch in its own seeded order, the documents whose running token sum stays within
the rest. The running sum is taken in two levels, over hash ranges of the order and
within each range, so that no task gets the whole of a large leaf.

Edge cases: a null domain, language or source is a value of its own and has weight 1 like
every name without a given weight; null and empty texts have no tokens and join every
epoch prefix; rows of a leaf with one doc_id go in together; weights must be positive;
an empty table or a budget of zero gives no rows with tokens; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_safe_lookup, table, words, written

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order hash that make a range: 16 ** 3 ranges in a leaf.
RANGE_DIGITS = 3


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        if w <= 0:
            raise ValueError(f"weight of {level} {name}: {w}")
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _share_out(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Adds ``budget`` to rows (parents, level, capacity, weight, pot): their part of the parent's ``pot``."""
    siblings = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("capacity") / F.col("weight"), F.col(level).asc_nulls_first())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    zero = F.lit(0.0)
    tried = nodes.withColumn("_left", F.col("pot") - F.coalesce(F.sum("capacity").over(before), zero)).withColumn("_weights", F.sum("weight").over(onward))
    tried = tried.withColumn("_full", F.col("capacity") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    rest = tried.withColumn("_pot", F.col("pot") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(siblings), zero)).withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(siblings))
    part = F.when(F.col("_full"), F.col("capacity")).otherwise(F.floor(F.col("_pot") * F.col("weight") / F.col("_open")).cast("double"))
    return rest.withColumn("budget", part).drop("_left", "_weights", "_full", "_pot", "_open")


def leaf_budgets(leaves: DataFrame, budget: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(domain, lang, source, tokens, n) with the ``budget`` of each leaf, handed down level by level."""
    nodes = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    above = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        own = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if above is None:
            own = own.withColumn("pot", F.lit(float(budget)))
        else:
            same = [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in path[:-1]]
            own = own.alias("o").join(above.alias("a"), same).select("o.*", F.col("a.budget").alias("pot"))
        above = _share_out(own, path[:-1], level).select(*path, "budget")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in LEVELS]
    return leaves.alias("o").join(above.alias("a"), same).select("o.*", "a.budget")


def order_key(epochs: Column, doc_id: Column, seed: int) -> Column:
    """Place of a document in the seeded order of one epoch of its leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), doc_id.cast("string")))


def _sized(docs: DataFrame, domain: Column) -> DataFrame:
    name = lambda c: F.col(c).cast("string")
    leaf = F.struct(domain.alias("domain"), name("lang").alias("lang"), name("source").alias("source"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), F.size(words(F.col("text"))).cast("long").alias("tokens"))


def chosen(docs: DataFrame, domain: Column, fraction: float, max_epochs: int, weights: dict[str, dict[str, float]], seed: int = 7) -> DataFrame:
    """(doc_id, leaf, tokens, epochs, key, upto, rest) of all documents: ``epochs`` whole ones, and one more where upto <= rest."""
    sized = written(_sized(docs, domain), "mix-tokens")
    leaves = written(sized.groupBy("leaf.domain", "leaf.lang", "leaf.source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-leaves")
    total = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    budget = float(int((total.tokens or 0) * fraction))
    shared = leaf_budgets(leaves, budget, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = shared.select(F.struct(*LEVELS).alias("leaf"), "n", whole.alias("epochs"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))
    ordered = hot_safe_lookup(sized, plan, "leaf", "n", total.n or 0).withColumn("key", order_key(F.col("epochs"), F.col("doc_id"), seed))
    ordered = ordered.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = ordered.groupBy("leaf", "range").agg(F.sum("tokens").alias("_sum"))
    earlier = W.partitionBy("leaf").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("leaf", "range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long")).alias("before"))
    within = W.partitionBy("leaf", "range").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    return ordered.join(ranges, ["leaf", "range"]).withColumn("upto", F.col("before") + F.sum("tokens").over(within)).drop("range", "before")


def mix(docs: DataFrame, domain: Column, fraction: float, max_epochs: int, weights: dict[str, dict[str, float]], seed: int = 7) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) of the documents chosen for ``fraction`` of all tokens."""
    copies = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return chosen(docs, domain, fraction, max_epochs, weights, seed).select("doc_id", "leaf.*", "tokens", copies.cast("long").alias("copies")).filter("copies > 0")


#: Leaves whose cut-offs are broadcast; with more, they are joined by a shuffle.
BROADCAST_LEAVES = 100_000


def mix_documents(docs: DataFrame, domain: Column, fraction: float, weights: dict[str, dict[str, float]], seed: int = 7) -> DataFrame:
    """The documents themselves, with all their columns, for one epoch at most.

    A leaf's prefix ends at a cut-off key, so whole texts are kept or dropped where they
    are read, by a look at their leaf's cut-off, and are not shuffled.
    """
    picked = chosen(docs, domain, fraction, 1, weights, seed)
    last = F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key")))
    cuts = written(picked.groupBy("leaf").agg(F.max("epochs").alias("_epochs"), last.alias("_last")), "mix-cuts")
    cuts = cuts.withColumnRenamed("leaf", "_leaf")
    if cuts.count() <= BROADCAST_LEAVES:
        cuts = F.broadcast(cuts)
    leaf = F.struct(domain.alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    key = order_key(F.col("_epochs"), F.col("doc_id").cast("long"), seed)
    joined = docs.join(cuts, leaf.eqNullSafe(F.col("_leaf")))
    return joined.filter((F.col("_epochs") > 0) | (key <= F.col("_last"))).select(*[docs[c] for c in docs.columns])


#: Parameters of the query and the pipeline stage.
WEIGHTS = {"domain": {"web": 3.0, "books": 1.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 1.0, "es": 1.0}}
FRACTION, MAX_EPOCHS, SEED = 0.75, 2, 7


def source_domain() -> Column:
    """The query's domains: documents have none, so a digest of the source's name tells."""
    return F.when(F.substring(F.md5(F.coalesce(F.col("source"), F.lit(""))), 1, 1) < "8", "web").otherwise("books")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), source_domain(), FRACTION, MAX_EPOCHS, WEIGHTS, SEED)


def _level_sql(depth: int) -> str:
    """CTEs that hand budgets down to one level; the same operations in the same order as above."""
    level, path, up = LEVELS[depth], ", ".join(LEVELS[: depth + 1]), list(LEVELS[:depth])
    weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v:.1f}" for k, v in WEIGHTS.get(level, {}).items()) + " ELSE 1.0 END" if level in WEIGHTS else "1.0"
    sibling = f"PARTITION BY {', '.join(up)}" if up else ""
    order = f"{sibling} ORDER BY capacity / weight, {level} NULLS FIRST"
    if up:
        join = f"JOIN budget{depth - 1} a ON " + " AND ".join(f"o.{c} IS NOT DISTINCT FROM a.{c}" for c in up)
        pot = "a.budget AS pot"
    else:
        join, pot = "CROSS JOIN total", "total.budget AS pot"
    return f"""
    node{depth} AS (SELECT {path}, sum(capacity) AS capacity, CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {path}),
    pot{depth} AS (SELECT o.*, {pot} FROM node{depth} o {join}),
    tried{depth} AS (
        SELECT *, pot - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remaining,
            sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM pot{depth}),
    full{depth} AS (SELECT *, capacity * weights <= remaining * weight AS is_full FROM tried{depth}),
    open{depth} AS (
        SELECT *, pot - coalesce(sum(capacity) FILTER (WHERE is_full) OVER ({sibling}), 0.0) AS own_pot,
            sum(weight) FILTER (WHERE NOT is_full) OVER ({sibling}) AS own_weights FROM full{depth}),
    budget{depth} AS (SELECT {path}, CASE WHEN is_full THEN capacity ELSE floor(own_pot * weight / own_weights) END AS budget FROM open{depth})"""


OP8_SQL = f"""
    WITH sized AS (
        SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain, lang, source,
            CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {MAX_EPOCHS} AS DOUBLE) AS capacity FROM sized GROUP BY ALL),
    total AS (SELECT CAST(floor(CAST(sum(tokens) AS DOUBLE) * CAST({FRACTION} AS DOUBLE)) AS DOUBLE) AS budget FROM sized),
    {_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
    planned AS (
        SELECT s.*, CASE WHEN l.tokens > 0 THEN CAST(floor(a.budget / l.tokens) AS BIGINT) ELSE 0 END AS epochs, l.tokens AS leaf_tokens, a.budget
        FROM sized s
        JOIN leaves l ON s.domain IS NOT DISTINCT FROM l.domain AND s.lang IS NOT DISTINCT FROM l.lang AND s.source IS NOT DISTINCT FROM l.source
        JOIN budget2 a ON s.domain IS NOT DISTINCT FROM a.domain AND s.lang IS NOT DISTINCT FROM a.lang AND s.source IS NOT DISTINCT FROM a.source),
    summed AS (
        SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '{SEED}', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR)))
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM planned)
    SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN upto <= budget - epochs * leaf_tokens THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM summed WHERE copies > 0"""
