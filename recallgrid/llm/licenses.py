"""License scans by MinHash bands over text windows, with DataFrame functions only.

Texts are cut into lower-case words of a-z and 0-9 and five-word shingles. Templates of
like length share a level: blocks of ``step`` places, and windows of as many blocks as
hold any copy of the template wherever it begins. A window's band is the minimum of one
seeded hash over its own shingles, which is the least of its blocks' minima. A window
retrieves a template when they agree in any band. The number of bands follows from the
smallest Jaccard similarity that a window around a copy of ``contained`` of the template
can have, so that it shares no band with probability MISS at most: short notices beside
others only add to the union that this reckons with. Where so much may be missing that
words can be inserted, windows are twice as long as the template.

Only blocks that hold a band value of some template leave the scan, with the shingles
around them; windows that hold a smaller value are dropped then. What is retrieved is
verified by exact containment in overlapping windows of one size for all templates
(twice the longest template, at half that stride).

The templates' bands go into the plan as literals, in blocks of at most BLOCK_SHINGLES
shingles; more templates take further passes.

Edge cases: null and empty texts match nothing; a template of fewer than five words has
one shingle of all its words and is found as such; null or empty templates match
nothing; a null doc_id is a value of its own; rows that share a doc_id are told apart by
their text and reported once if that is equal too; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH, CONTAINED = 5, 0.8
#: Largest probability that a window around a copy shares no band with its template.
MISS = 1e-6
BLOCK_SHINGLES = 5_000

#: Short notices by SPDX identifier; fixed values.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def scan_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(hashes: Column, width: int) -> Column:
    """A hash of each run of ``width`` word hashes."""
    last = F.size(hashes) - width
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)]))


def _hashes(text: Column) -> Column:
    return F.transform(scan_words(text), lambda w: F.xxhash64(w))


def _template_rows(templates: DataFrame) -> list:
    """(template_id, n words, width, s shingles) of each template that has words; template texts are the bounded side."""
    words = templates.select("template_id", _hashes(F.col("text")).alias("h")).filter(F.size("h") > 0)
    sized = words.withColumn("width", F.least(F.size("h"), F.lit(WIDTH)))
    by_width = [sized.filter(F.col("width") == w).select("template_id", F.size("h").alias("n"), "width", F.array_distinct(_shingles(F.col("h"), w)).alias("s")) for w in range(1, WIDTH + 1)]
    return reduce(DataFrame.unionByName, by_width).orderBy("template_id", "s").collect()


def window_plan(size: int, places: int, width: int, contained: float) -> tuple[int, int, int]:
    """(step, blocks of a window, bands) for a template of ``size`` distinct shingles at ``places`` places.

    A window holds every copy of ``places`` places wherever it begins; where a copy may
    lack as many shingles as an insertion breaks, it is twice as long.
    """
    held = max(1, math.ceil(contained * size - 1e-9))
    if size - held >= width - 1 > 0:
        step = 1 << max(0, int(math.log2(places)) - 2)
        reach = 2 * places + step - 1
    elif held == size:
        step, reach = 1, places
    else:
        step = max(2, 1 << max(0, int(math.log2(places)) - 2))
        reach = places + step - 1
    blocks = -(-reach // step)
    jaccard = held / max(held, size + blocks * step - held)
    return step, blocks, 1 if jaccard >= 1 else math.ceil(math.log(MISS) / math.log(1 - jaccard))


def _band(shingles: Column, seed: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, seed)))


def _banded(spark: SparkSession, rows: list, contained: float) -> list:
    """The templates with their level (width, step), blocks of a window and band values."""
    plans = [(r.template_id, r.width, len(r.s), r.s, *window_plan(len(r.s), r.n - r.width + 1, r.width, contained)) for r in rows]
    df = spark.createDataFrame(plans, "template_id string, width int, size int, s array<long>, step int, blocks int, bands int")
    return df.withColumn("bands", F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda i: _band(F.col("s"), i))).collect()


def _part(shingles: Column, low: Column, high: Column) -> Column:
    """Shingles of the places from ``low`` to below ``high``; unlike ``slice`` it does not copy the whole array each time."""
    end = F.least(high, F.size(shingles))
    places = F.when(low < end, F.sequence(low, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(shingles, i))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Blocks of up to so many places are columns of one row, so that their bands are computed in generated code.
FINE = 4


def _near(shingles: Column, block: Column, step: Column, reach: int, stride: int) -> tuple[Column, Column]:
    """(first place, shingles) of all verifying windows that touch a window of up to ``reach`` places around ``block``."""
    first, last = block * step + step - reach, block * step + reach
    low = F.greatest(F.lit(0), (F.floor(first / stride) - 1) * stride).cast("int")
    high = ((F.floor(last / stride) + 2) * stride).cast("int")
    return low, _part(shingles, low, high)


def _numbers(shingles: Column, step: int) -> Column:
    """Numbers of the blocks of ``step`` places."""
    count = F.ceil(F.size(shingles) / step).cast("int")
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _fine_hits(texts: DataFrame, levels: dict[int, list]) -> DataFrame:
    """(doc_id, tk, S, step, block) of the blocks of at most FINE places that hold a band value of some template."""
    steps = sorted(levels)
    bands = max(len(r.bands) for of in levels.values() for r in of)
    known = {step: sorted({v for r in of for v in r.bands}) for step, of in levels.items()}
    # The last place stands for those beyond it, which changes no minimum.
    at = lambda g, k: F.get(F.col("S"), F.least(g * FINE + k, F.size("S") - 1))
    groups = F.transform(_numbers(F.col("S"), FINE), lambda g: F.struct(g.alias("g"), *[at(g, k).alias(f"s{k}") for k in range(FINE)]))
    rows = texts.select("doc_id", "tk", "S", F.explode(groups).alias("x")).select("doc_id", "tk", "S", "x.*")
    seeded = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("seed"))
    one = {k: F.xxhash64(f"s{k}", "seed") for k in range(FINE)}
    value = lambda step, j: F.least(*[one[k] for k in range(j * step, (j + 1) * step)]) if step > 1 else one[j]
    blocks = [(step, j) for step in steps for j in range(FINE // step)]
    hot = seeded.filter(reduce(or_, [value(step, j).isin(known[step]) for step, j in blocks]))
    found = [F.when(value(step, j).isin(known[step]), F.struct(F.lit(step).alias("step"), (F.col("g") * (FINE // step) + j).alias("block"))) for step, j in blocks]
    return hot.select("doc_id", "tk", "S", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("doc_id", "tk", "S", "x.*")


def _coarse_hits(texts: DataFrame, step: int, rows: list) -> DataFrame:
    """The same for blocks of ``step`` places."""
    values = [sorted({r.bands[i] for r in rows if i < len(r.bands)}) for i in range(max(len(r.bands) for r in rows))]
    known = lambda block: reduce(or_, [_band(block, F.lit(i)).isin(v) for i, v in enumerate(values)])
    hot = F.filter(_numbers(F.col("S"), step), lambda b: _once(_part(F.col("S"), b * step, (b + 1) * step), known))
    return texts.select("doc_id", "tk", "S", F.lit(step).alias("step"), F.explode(hot).alias("block"))


def _hits(docs: DataFrame, width: int, levels: dict[int, list], stride: int) -> DataFrame:
    """(doc_id, tk, width, step, block, low, near) of every block with a band value of a template of this width."""
    shingles = _once(_hashes(F.col("text")), lambda h: _shingles(h, width))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), shingles.alias("S"))
    fine = {step: of for step, of in levels.items() if step <= FINE}
    parts = [_fine_hits(texts, fine)] if fine else []
    parts += [_coarse_hits(texts, step, of) for step, of in levels.items() if step > FINE]
    cut = []
    for part, of in zip(parts, ([fine] if fine else []) + [{step: of} for step, of in levels.items() if step > FINE]):
        reach = max(r.blocks * step for step, rows in of.items() for r in rows)
        low, near = _near(F.col("S"), F.col("block"), F.col("step"), reach, stride)
        cut.append(part.select("doc_id", "tk", F.lit(width).alias("width"), "step", "block", low.alias("low"), near.alias("near")))
    return reduce(DataFrame.unionByName, cut).dropDuplicates(["doc_id", "tk", "width", "step", "block"])


def _scan_block(docs: DataFrame, rows: list, stride: int, contained: float) -> DataFrame:
    spark = docs.sparkSession
    levels: dict[int, dict[int, list]] = {}
    for r in _banded(spark, rows, contained):
        levels.setdefault(r.width, {}).setdefault(r.step, []).append(r)
    doc = reduce(DataFrame.unionByName, [_hits(docs, width, own, stride) for width, own in levels.items()])

    most = max(len(r.bands) for own in levels.values() for of in own.values() for r in of)
    # One block of templates: BLOCK_SHINGLES bounds what is broadcast.
    flat = [(r.template_id, r.width, r.step, r.blocks, r.size, r.s, i, v) for own in levels.values() for of in own.values() for r in of for i, v in enumerate(r.bands)]
    keys = spark.createDataFrame([f[:5] + f[6:] for f in flat], "template_id string, width int, step int, blocks int, size int, seed int, value long").distinct()
    templates = spark.createDataFrame([(f[0], f[1], f[4], f[5]) for f in flat if f[6] == 0], "template_id string, width int, size int, own array<long>").distinct()

    at = F.col("block") * F.col("step") - F.col("low")
    block = F.slice("near", at + 1, F.col("step"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(i.alias("seed"), _band(block, i).alias("value")))
    met = doc.select("*", F.explode(bands).alias("band")).select(*doc.columns, "band.seed", "band.value").join(F.broadcast(keys), ["width", "step", "seed", "value"])
    # Windows in which no other block has a smaller value in the band.
    starts = F.sequence(F.greatest(F.lit(0), F.col("block") - F.col("blocks") + 1), F.col("block"))
    window = lambda b: F.slice("near", b * F.col("step") - F.col("low") + 1, F.col("blocks") * F.col("step"))
    alike = F.filter(starts, lambda b: _band(window(b), F.col("seed")) == F.col("value"))
    first, last = F.array_min(alike) * F.col("step"), (F.array_max(alike) + F.col("blocks")) * F.col("step") - 1
    reached = F.sequence(F.floor(first / stride) - 1, F.floor(last / stride))
    pairs = met.filter(F.size(alike) > 0).select("doc_id", "tk", "template_id", "width", "size", "low", "near", F.explode(reached).alias("window"))

    begin = F.greatest(F.col("window") * stride, F.lit(0)).cast("int")
    length = ((F.col("window") + 2) * stride).cast("int") - begin
    share = F.size(F.array_intersect(F.slice("near", begin - F.col("low") + 1, length), F.col("own"))) / F.col("size")
    shares = pairs.join(F.broadcast(templates), ["template_id", "width", "size"]).select("doc_id", "tk", "template_id", "size", "window", share.alias("containment"))
    good = shares.filter(F.col("containment") >= contained).groupBy("doc_id", "tk", "template_id", "size", "window").agg(F.max("containment").alias("containment"))
    return good.groupBy("doc_id", "tk", "template_id").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows")).drop("tk")


def license_scan(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, template_id, containment, n_windows) of every document and template found in it."""
    blocks, size = [[]], 0
    found = _template_rows(templates)
    stride = max((r.n for r in found), default=1)
    for r in found:
        if size + len(r.s) > BLOCK_SHINGLES and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r.s)
    parts = [_scan_block(docs, rows, stride, contained) for rows in blocks if rows]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, template_id string, containment double, n_windows long")
    return reduce(DataFrame.unionByName, parts, empty)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(NOTICES.items()), "template_id string, text string")
    return license_scan(table(spark, sf_dir, "documents"), templates)


def _notice_values() -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in NOTICES.items())


OP7_SQL = f"""
    WITH templates(template_id, text) AS (VALUES {_notice_values()}),
    t_words AS (SELECT template_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM templates),
    t_shingles AS (
        SELECT DISTINCT template_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s
        FROM (SELECT template_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM t_words)),
    t_size AS (SELECT template_id, count(*) AS n FROM t_shingles GROUP BY template_id),
    stride AS (SELECT max(len(w)) AS n FROM t_words),
    d_words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
    d_shingles AS (
        SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d_words WHERE len(w) >= {WIDTH})),
    hits AS (SELECT doc_id, template_id, s, place // stride.n AS k FROM d_shingles JOIN t_shingles USING (s), stride),
    windows AS (SELECT doc_id, template_id, s, k AS win FROM hits UNION ALL SELECT doc_id, template_id, s, k - 1 FROM hits),
    shares AS (
        SELECT doc_id, template_id, win, count(DISTINCT s) / CAST(any_value(n) AS DOUBLE) AS containment
        FROM windows JOIN t_size USING (template_id) GROUP BY doc_id, template_id, win)
    SELECT doc_id, template_id, max(containment) AS containment, count(*) AS n_windows
    FROM shares WHERE containment >= {CONTAINED} GROUP BY doc_id, template_id"""
