"""Feature graphs learned from ordered writes.

Writes are rows (ns, seq, feature, w). Edges are rows (ns, src, dst, w). Three exact modes
are offered: ``closed_form`` where no pruning or norm cap binds (pure window functions),
``row_fold`` with pruning and cap, one row of the graph per group, and ``namespace_fold``
for rules that couple rows (Oja). Namespaces and graph rows are the units of parallelism.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.functions.lineage import settle
from recallgrid.functions.ranges import running_sum

RATE, TEMPORAL_RATE, DECAY, INTERVAL = 0.12, 0.08, 0.001, 100
MAX_PAIRS, MAX_DEGREE = 128, 128
SMALL, GONE = 1e-12, 1e-9


def mean_rate(rate: float) -> float:
    return min(0.1, max(1e-4, rate * 0.1))


def with_write_number(codes: DataFrame, after: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """Adds t, the number of the write within its namespace, from 1, or from behind the t of ``after`` (ns, t).

    ``numbers`` (ns, seq, t) has them already, which counts writes without entries too.
    """
    if numbers is not None:
        return codes.join(numbers.select("ns", "seq", "t"), ["ns", "seq"])
    if codes.count() <= TASK_ENTRIES:
        numbered = codes.withColumn("t", F.dense_rank().over(W.partitionBy("ns").orderBy("seq")).cast("long"))
    else:
        numbered = _placed(codes, ["ns"], "t")
    if after is None:
        return numbered
    return numbered.join(after.select("ns", F.col("t").alias("_t0")), "ns", "left").withColumn("t", F.col("t") + F.coalesce("_t0", F.lit(0))).drop("_t0")


#: Entries of writes up to which a namespace's are numbered in one task.
TASK_ENTRIES = 1 << 18


def _placed(codes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``codes`` with the number of each write within the keys, from 1, made by ranges, as a namespace may hold most of the writes."""
    writes = codes.select(*keys, "seq").distinct().withColumn("_one", F.lit(1).cast("long"))
    placed = running_sum(writes, keys, [F.col("seq")], "_one").select(*keys, "seq", (F.col("_before") + 1).alias(name))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "seq"]]
    return codes.alias("c").join(placed.alias("p"), same).select("c.*", name)


def activity(codes: DataFrame, rate: float = RATE, known: DataFrame | None = None) -> DataFrame:
    """Adds mu and m2, the moving averages of |w| and w*w of the feature before this write.

    Sorted rows are folded as a stream, so no feature's history is held in memory.
    ``known`` (ns, feature, mu, m2) has the averages before the first of these writes.
    """
    r, begun = mean_rate(rate), known is not None
    if begun:
        codes = codes.join(known.select("ns", "feature", F.col("mu").alias("_mu"), F.col("m2").alias("_m2")), ["ns", "feature"], "left").fillna(0.0, ["_mu", "_m2"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mu, m2 = None, 0.0, 0.0
        for p in parts:
            before, second = np.empty(len(p)), np.empty(len(p))
            starts = zip(p["_mu"], p["_m2"], strict=True) if begun else repeat((0.0, 0.0))
            for k, (ns, feature, w, start) in enumerate(zip(p["ns"], p["feature"], p["w"], starts)):  # noqa: B905
                if (ns, feature) != key:
                    key, (mu, m2) = (ns, feature), start
                before[k], second[k] = mu, m2
                mu, m2 = (1 - r) * mu + r * abs(w), (1 - r) * m2 + r * w * w
            yield p.assign(mu=before, m2=second)

    schema = codes.schema.add("mu", "double").add("m2", "double")
    return codes.repartition("ns", "feature").sortWithinPartitions("ns", "feature", "seq").mapInPandas(run, schema).drop("_mu", "_m2")


def final_activity(codes: DataFrame, rate: float = RATE, known: DataFrame | None = None) -> DataFrame:
    """(ns, feature, mu, m2) after the last write."""
    r = mean_rate(rate)
    last = activity(codes, rate, known).withColumn("_r", F.row_number().over(W.partitionBy("ns", "feature").orderBy(F.col("seq").desc()))).filter("_r = 1")
    return last.select("ns", "feature", ((1 - r) * F.col("mu") + r * F.abs("w")).alias("mu"), ((1 - r) * F.col("m2") + r * F.col("w") * F.col("w")).alias("m2"))


def pair_deltas(codes: DataFrame, rule: str, rate: float = RATE, salience: Column | float = 1.0, max_pairs: int = MAX_PAIRS, after: DataFrame | None = None, known: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """(ns, src, dst, t, delta) of every directed pair of a write: a self-join keyed by the write.

    Writes are numbered behind ``after`` (ns, t) or as ``numbers`` say; ``known`` has the features' averages before them.
    """
    if rule in ("none", "off", "zero"):
        return with_write_number(codes).select("ns", F.col("feature").alias("src"), F.col("feature").alias("dst"), "t", F.lit(0.0).alias("delta")).limit(0)
    if rule not in ("hebb", "covariance", "bcm"):
        raise ValueError(f"unknown plasticity rule: {rule}")
    top = with_write_number(strongest(codes, max_pairs), after, numbers)
    top = top if rule == "hebb" else activity(top, rate, known)
    eta = F.lit(rate) * salience
    names = ["feature", "w"] + ([] if rule == "hebb" else ["mu", "m2"])
    a = top.select("ns", "t", *[F.col(c).alias(f"a_{c}") for c in names])
    b = top.select("ns", "t", *[F.col(c).alias(f"b_{c}") for c in names])
    vi, vj = F.col("a_w"), F.col("b_w")
    if rule == "hebb":
        delta = eta * vi * vj
    elif rule == "covariance":
        delta = eta * (vi - F.col("a_mu")) * (vj - F.col("b_mu"))
    else:
        delta = 0.5 * eta * (vi * vj * (vi - F.col("a_m2")) + vj * vi * (vj - F.col("b_m2")))
    joined = a.join(b, ["ns", "t"]).filter("a_feature <> b_feature")
    return joined.select("ns", F.col("a_feature").alias("src"), F.col("b_feature").alias("dst"), "t", delta.alias("delta"))


def previous_write(codes: DataFrame, stream: list[str]) -> DataFrame:
    """(stream..., seq, previous seq): the as-of link to the write before, within the stream."""
    writes = codes.select(*stream, "seq").distinct()
    if writes.count() <= TASK_ENTRIES:
        return writes.withColumn("previous", F.lag("seq").over(W.partitionBy(*stream).orderBy("seq")))
    placed = settle(_placed(writes, stream, "_k"), "placed")
    before = placed.select(*stream, (F.col("_k") + 1).alias("_k"), F.col("seq").alias("previous"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*stream, "_k"]]
    return placed.alias("w").join(before.alias("b"), same, "left").select("w.*", "b.previous").drop("_k")


def strongest(codes: DataFrame, n: int) -> DataFrame:
    """The n largest entries of each write."""
    order = W.partitionBy("ns", "seq").orderBy(F.abs("w").desc(), "feature")
    return codes.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def temporal_deltas(codes: DataFrame, stream: list[str], rate: float = TEMPORAL_RATE, rule: str = "hebb", max_pairs: int = MAX_PAIRS, after: DataFrame | None = None, last: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """(ns, src, dst, t, delta) from each write's predecessor in its stream to the write; directed, none for rule none.

    At most ``max_pairs`` entries of each of the two take part. Writes are numbered behind
    ``after`` (ns, t); ``last`` has the streams' writes before these, columns as ``codes``.
    """
    numbered = with_write_number(codes, after, numbers)
    if last is not None:
        codes = last.select(*codes.columns).unionByName(codes)
    if rule in ("none", "off", "zero"):
        return numbered.select("ns", F.col("feature").alias("src"), F.col("feature").alias("dst"), "t", F.lit(0.0).alias("delta")).limit(0)
    numbered, codes = strongest(numbered, max_pairs), strongest(codes, max_pairs)
    keys = list(dict.fromkeys(["ns", *stream]))
    links = previous_write(codes, keys).filter("previous IS NOT NULL")
    now = numbered.join(links, [*keys, "seq"]).select(*keys, "previous", "t", F.col("feature").alias("dst"), F.col("w").alias("_w"))
    before = codes.select(*keys, F.col("seq").alias("previous"), F.col("feature").alias("src"), F.col("w").alias("_v"))
    joined = now.join(before, [*keys, "previous"]).filter("src <> dst")
    return joined.select("ns", "src", "dst", "t", (F.lit(rate) * F.col("_v") * F.col("_w")).alias("delta"))


def _epoch(t: Column, interval: int) -> Column:
    """How often all edges have decayed by write t."""
    return F.floor(t / interval) if interval > 0 else F.lit(0).cast("long")


#: Powers of what a decay leaves stay above e ** -SPAN within a segment of writes, so that dividing by them is safe.
SPAN = 230.0


#: Deltas that one task of ``closed_form`` sums up, unless a single edge has more.
TASK_DELTAS = 1 << 18


def closed_form(deltas: DataFrame, writes: DataFrame, decay: float = DECAY, interval: int = INTERVAL, allow_negative: bool = False) -> DataFrame:
    """(ns, src, dst, w) after all writes; ``writes`` has (ns, t), the number of writes.

    Adding with a floor at zero is a Lindley recursion: with S the running sum of
    decay-corrected deltas, an edge that starts at v ends at max(v + S, S - min S). Sums
    are taken within segments of decays, over which the correction keeps its precision,
    and an edge's segments, one unless decays run to hundreds of thousands, follow one
    another. A decay of 1 or more leaves the deltas after the last one only.
    """
    keep = max(0.0, 1 - decay)
    last = writes.groupBy("ns").agg(F.max("t").alias("t_end"))
    n_ns, t_max = last.agg(F.count(F.lit(1)), F.max("t_end")).first()
    last = F.broadcast(last) if n_ns <= 10_000 else last
    rows = deltas.withColumn("_e", _epoch(F.col("t"), interval))
    end = _epoch(F.col("t_end"), interval)
    if keep == 0.0:
        rows, keep = rows.join(last, "ns").filter(F.col("_e") == end).drop("t_end").withColumn("_e", F.lit(0).cast("long")), 1.0
        end = F.lit(0).cast("long")
    span = max(1, int(SPAN / -math.log(keep))) if keep < 1 else 1 << 62
    left = lambda n: F.pow(F.lit(keep), n)
    segment = F.floor(F.col("_e") / span)
    # Dealt by number of rows: by size, packed deltas of many writes would come to one task, as they pack well.
    rows = rows.repartition(max(1, -(-deltas.count() // TASK_DELTAS)), "ns", "src", "dst")
    grown = rows.withColumn("_g", segment).withColumn("_s", F.sum(F.col("delta") / left(F.col("_e") - F.col("_g") * span)).over(W.partitionBy("ns", "src", "dst", "_g").orderBy("t")))
    ends = grown.groupBy("ns", "src", "dst", "_g").agg(F.max_by("_s", "t").alias("s"), F.least(F.lit(0.0), F.min("_s")).alias("low"))
    after = lambda v, x: v + x["s"] if allow_negative else F.greatest(v + x["s"], x["s"] - x["low"])
    part = F.struct("_g", "s", "low")
    if interval <= 0 or t_max is None or t_max // interval < span:
        edges = ends.select("ns", "src", "dst", after(F.lit(0.0), part).alias("v"), "_g")
    else:
        start = F.struct(F.lit(0).cast("long").alias("g"), F.lit(0.0).alias("v"))
        step = lambda a, x: F.struct(x["_g"].alias("g"), after(a["v"] * left((x["_g"] - a["g"]) * span), x).alias("v"))
        folded = ends.groupBy("ns", "src", "dst").agg(F.aggregate(F.sort_array(F.collect_list(part)), start, step).alias("a"))
        edges = folded.select("ns", "src", "dst", "a.v", F.col("a.g").alias("_g"))
    return edges.join(last, "ns").select("ns", "src", "dst", (F.col("v") * left(end - F.col("_g") * span)).alias("w")).filter(F.abs("w") >= SMALL)


def decayed(edges: DataFrame, rate: float) -> DataFrame:
    return edges.withColumn("w", F.col("w") * max(0.0, 1 - rate)).filter(F.abs("w") >= GONE)


def pruned(edges: DataFrame, max_degree: int, keys: tuple[str, ...] = ("ns", "src")) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.abs("w").desc(), "dst")
    return edges.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(1, max_degree)).drop("_r")


def capped(edges: DataFrame, most: float = 1.0, keys: tuple[str, ...] = ("ns", "src")) -> DataFrame:
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))
    return edges.withColumn("w", F.when(size > most, F.col("w") * (most / size)).otherwise(F.col("w")))


def degrees(edges: DataFrame, keys: tuple[str, ...] = ("ns", "src")) -> DataFrame:
    return edges.groupBy(*keys).agg(F.sum(F.abs("w")).alias("degree"))


def settled_row(row: dict[int, float], max_degree: int, cap: bool) -> dict[int, float]:
    """A graph row after a write: its strongest entries, at most of unit length with ``cap``."""
    if len(row) > max_degree:
        row = dict(sorted(row.items(), key=lambda x: (-abs(x[1]), x[0]))[:max_degree])
    if cap:
        size = math.sqrt(sum(v * v for v in row.values()))
        if size > 1.0:
            row = {j: v / size for j, v in row.items()}
    return row


def decays_between(since: int, until: int, interval: int) -> int:
    """Periodic decays after write ``since`` up to and with write ``until``."""
    return until // interval - since // interval if interval > 0 else 0


def aged_row(row: dict[int, float], steps: int, decay: float, kept: float = 1.0) -> dict[int, float]:
    """A graph row after ``steps`` periodic decays and what ``kept`` leaves of triggered ones; small entries vanish."""
    for _ in range(steps):
        row = {j: v * max(0.0, 1 - decay) for j, v in row.items()}
        row = {j: v for j, v in row.items() if abs(v) >= GONE}
    if kept != 1.0:
        row = {j: v * kept for j, v in row.items() if abs(v * kept) >= GONE}
    return row


def grown_row(row: dict[int, float], src: int, targets: list[int], deltas: list[float], allow_negative: bool = False) -> dict[int, float]:
    """Adds deltas to the row of ``src``, in place; no edge to itself, none below zero unless allowed, tiny ones vanish."""
    for dst, delta in zip(targets, deltas, strict=True):
        if dst != src and delta != 0.0:
            value = row.get(dst, 0.0) + delta
            value = value if allow_negative else max(0.0, value)
            if abs(value) < SMALL:
                row.pop(dst, None)
            else:
                row[dst] = value
    return row


def pair_matrix(rule: str, rate: float, v: np.ndarray, mu: np.ndarray | None = None, m2: np.ndarray | None = None, old: np.ndarray | None = None) -> np.ndarray:
    """Deltas of all pairs of a write's entries, as an outer product.

    ``old`` has the edges before the write, of which the one from the stronger entry counts for both directions.
    """
    if rule == "hebb":
        return rate * np.outer(v, v)
    if rule == "covariance":
        return rate * np.outer(v - mu, v - mu)
    if rule == "bcm":
        over = v * v - v * m2
        return 0.5 * rate * (np.outer(over, v) + np.outer(v, over))
    if rule == "oja":
        first = np.triu(old, 1)
        return rate * (np.outer(v, v) - 0.5 * np.add.outer(v * v, v * v) * (first + first.T))
    raise ValueError(f"unknown plasticity rule: {rule}")


def _left_by(rates: DataFrame | None, deltas: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds left and left_end: what the triggered decays up to t and up to the end leave of an edge."""
    if rates is None:
        return deltas.join(ends, "ns").withColumns({"left": F.lit(1.0), "left_end": F.lit(1.0)})
    each = rates.groupBy("ns", "t").agg(F.sum(F.log1p(-F.col("rate"))).alias("_l"))
    marks = deltas.select("ns", "t").distinct().withColumn("_l", F.lit(0.0)).unionByName(each).groupBy("ns", "t").agg(F.sum("_l").alias("_l"))
    running = marks.select("ns", "t", F.exp(F.sum("_l").over(W.partitionBy("ns").orderBy("t"))).alias("left"))
    total = each.groupBy("ns").agg(F.exp(F.sum("_l")).alias("left_end"))
    return deltas.join(running, ["ns", "t"]).join(ends.join(total, "ns", "left"), "ns").fillna(1.0, ["left_end"])


def row_fold(deltas: DataFrame, writes: DataFrame, decay: float = DECAY, interval: int = INTERVAL, max_degree: int = MAX_DEGREE, cap: bool = True, allow_negative: bool = False, rates: DataFrame | None = None) -> DataFrame:
    """As ``closed_form``, with pruning and norm cap after each write that touches a row.

    A row of the graph evolves from its own deltas only, because decay is known from the
    write number; so rows are folded in parallel, each a stream sorted by write. ``rates``
    (ns, t, rate) are further decays of the whole namespace, each before write t; those
    after the last write count at the end.
    """
    ends = writes.groupBy("ns").agg(F.max("t").alias("t_end"))
    rows = _left_by(rates, deltas, ends)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row, now, end, left, left_end = None, {}, 0, 0, 1.0, 1.0

        def aged(row, since, until, kept):
            return aged_row(row, decays_between(since, until, interval), decay, kept)

        def close():
            final = aged(settled_row(row, max_degree, cap), now, end, left_end / left)
            return [(key[0], key[1], j, v) for j, v in final.items()] if key else []

        for p in parts:
            done = []
            for ns, src, dst, t, delta, t_end, kept, kept_end in p.itertuples(index=False, name=None):
                if (ns, src) != key:
                    done += close()
                    key, row, now, end, left, left_end = (ns, src), {}, t, t_end, kept, kept_end
                if t != now:
                    row, now, left = aged(settled_row(row, max_degree, cap), now, t, kept / left), t, kept
                value = row.get(dst, 0.0) + delta
                value = value if allow_negative else max(0.0, value)
                if abs(value) < SMALL:
                    row.pop(dst, None)
                else:
                    row[dst] = value
            yield pd.DataFrame(done, columns=["ns", "src", "dst", "w"])
        yield pd.DataFrame(close(), columns=["ns", "src", "dst", "w"])

    kinds = {f.name: f.dataType.simpleString() for f in deltas.schema}
    schema = f"ns {kinds['ns']}, src {kinds['src']}, dst {kinds['dst']}, w double"
    ordered = rows.repartition("ns", "src").sortWithinPartitions("ns", "src", "t", "dst")
    return ordered.select("ns", "src", "dst", "t", "delta", "t_end", "left", "left_end").mapInPandas(run, schema)


#: Weights of a namespace's graph that one task of ``event_fold`` holds at most, with room to grow.
HELD = 1 << 22
#: Edges that such a task gathers at most before it gives them back.
SENT = 1 << 18


def pair_events(codes: DataFrame, rule: str, rate: float = RATE, max_pairs: int = MAX_PAIRS, numbers: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(ns, t, src, dst, a, b, c, d) of each write, arrays: ``pair_deltas`` as sums of products a * b + c * d of its entries, which are not made."""
    top = with_write_number(strongest(codes, max_pairs), None, numbers)
    top = top if rule == "hebb" else activity(top, rate, known)
    w, eta = F.col("w"), F.lit(rate)
    if rule == "bcm":
        parts = [0.5 * eta * w * (w - F.col("m2")), w, 0.5 * eta * w, w * (w - F.col("m2"))]
    else:
        v = w if rule == "hebb" else w - F.col("mu")
        parts = [eta * v, v, F.lit(0.0), F.lit(0.0)]
    lists = top.groupBy("ns", "t").agg(F.sort_array(F.collect_list(F.struct("feature", *[x.alias(n) for n, x in zip("abcd", parts, strict=True)]))).alias("_e"))
    return lists.select("ns", "t", F.col("_e.feature").alias("src"), F.col("_e.feature").alias("dst"), *[F.col(f"_e.{n}").alias(n) for n in "abcd"])


def temporal_events(codes: DataFrame, stream: list[str], rate: float = TEMPORAL_RATE, max_pairs: int = MAX_PAIRS, numbers: DataFrame | None = None) -> DataFrame:
    """As ``pair_events`` for ``temporal_deltas``: the entries of a write's predecessor in its stream, and its own."""
    keys = list(dict.fromkeys(["ns", *stream]))
    top = strongest(with_write_number(codes, None, numbers), max_pairs)
    lists = top.groupBy(*keys, "seq", "t").agg(F.sort_array(F.collect_list(F.struct("feature", "w"))).alias("_e"))
    chained = lists.withColumn("_p", F.lag("_e").over(W.partitionBy(*keys).orderBy("seq"))).filter("_p IS NOT NULL")
    zero = lambda e: F.transform(e, lambda x: F.lit(0.0))
    return chained.select("ns", "t", F.col("_p.feature").alias("src"), F.col("_e.feature").alias("dst"), F.transform("_p", lambda x: F.lit(rate) * x["w"]).alias("a"), F.col("_e.w").alias("b"), zero("_p").alias("c"), zero("_e").alias("d"))


class _Rows:
    """Rows of a graph as a matrix of weights, 0 where there is no edge; rows are settled and aged when they are touched again, or at the end."""

    def __init__(self, decay: float, interval: int, max_degree: int, cap: bool, allow_negative: bool):
        self.decay, self.interval, self.max_degree, self.cap, self.allow_negative = decay, interval, max_degree, cap, allow_negative
        self.row: dict[int, int] = {}
        self.column: dict[int, int] = {}
        self.w, self.now, self.names = np.zeros((64, 128)), np.zeros(64, np.int64), np.zeros(128, np.int64)

    def _places(self, known: dict[int, int], features: list[int]) -> np.ndarray:
        return np.array([known.setdefault(f, len(known)) for f in features])

    def add(self, t: int, src: np.ndarray, dst: np.ndarray, delta: np.ndarray) -> None:
        before = len(self.row)
        r, c = self._places(self.row, src.tolist()), self._places(self.column, dst.tolist())
        if len(self.row) > self.w.shape[0] or len(self.column) > self.w.shape[1]:
            shape = [max(n, 2 * m) if n > m else m for n, m in zip((len(self.row), len(self.column)), self.w.shape, strict=True)]
            wider = np.zeros(shape)
            wider[: self.w.shape[0], : self.w.shape[1]] = self.w
            self.w, self.now, self.names = wider, np.resize(self.now, shape[0]), np.resize(self.names, shape[1])
        self.names[c] = dst
        self.now[before : len(self.row)] = t
        old = np.unique(r[self.now[r] != t])
        if len(old):
            self._move(old, t)
        known = src[:, None] != dst[None, :]
        if len(set(src.tolist())) == len(src) and len(set(dst.tolist())) == len(dst):
            at = np.ix_(r, c)
            self.w[at] = np.where(known, self._kept(self.w[at] + delta), self.w[at])
            return
        for i, j in zip(*np.nonzero(known), strict=True):  # a feature twice in a write: one delta after another
            self.w[r[i], c[j]] = self._kept(self.w[r[i], c[j]] + delta[i, j])

    def _kept(self, value):
        value = value if self.allow_negative else np.maximum(value, 0.0)
        return np.where(np.abs(value) < SMALL, 0.0, value)

    def _move(self, rows: np.ndarray, t: int) -> None:
        n = len(self.column)
        x = self.w[rows, :n]
        many = np.flatnonzero(np.count_nonzero(x, axis=1) > self.max_degree)
        for k in many.tolist():
            order = np.lexsort((self.names[:n], -np.abs(x[k])))
            x[k, order[self.max_degree :]] = 0.0
        if self.cap:
            size = np.sqrt((x * x).sum(axis=1))
            large = size > 1.0
            x[large] /= size[large, None]
        steps = t // self.interval - self.now[rows] // self.interval if self.interval > 0 else np.zeros(len(rows), np.int64)
        for k in range(int(steps.max(initial=0))):
            due = steps > k
            aged = x[due] * max(0.0, 1 - self.decay)
            x[due] = np.where(np.abs(aged) >= GONE, aged, 0.0)
        self.w[rows, :n], self.now[rows] = x, t

    def edges(self, t_end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The edges as of write ``t_end``, by rows of ``SENT`` places together, or one row."""
        src, n = np.array(list(self.row), np.int64), len(self.column)
        step = max(1, SENT // max(n, 1))
        for lo in range(0, len(src), step):
            rows = np.arange(lo, min(lo + step, len(src)))
            self._move(rows, t_end)
            r, c = np.nonzero(self.w[lo : lo + len(rows), :n])
            yield src[lo + r], self.names[c], self.w[lo + r, c]


def event_fold(events: DataFrame, writes: DataFrame, decay: float = DECAY, interval: int = INTERVAL, max_degree: int = MAX_DEGREE, cap: bool = True, allow_negative: bool = False) -> DataFrame:
    """As ``row_fold`` of the deltas of ``events`` (ns, t, salience, src, dst, a, b, c, d), with a matrix operation a write instead of a step a delta.

    No delta is made or shuffled. The rows of a large graph are dealt into blocks by src,
    each of which gets its namespace's events as a stream, so a task holds ``HELD`` weights
    or, of a namespace of more features than that, a row of them. It gives edges back by
    their number, as the few events that it reads at once may end thousands of graphs.
    """
    ends = writes.groupBy("ns").agg(F.max("t").alias("t_end"))
    every = events.select("ns", F.explode(F.concat("src", "dst")).alias("f")).groupBy("ns").agg(F.approx_count_distinct("f").alias("_f"))
    blocks = every.select("ns", F.least("_f", F.ceil(F.col("_f") * F.col("_f") / HELD)).cast("int").alias("_n"))
    dealt = events.join(ends, "ns").join(blocks, "ns").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kinds = {"ns": events.schema["ns"].dataType.simpleString(), "f": events.schema["src"].dataType.elementType.simpleString()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, graph, end = None, None, 0
        held, size = [], 0

        def gathered(least: int) -> Iterator[pd.DataFrame]:
            nonlocal held, size
            if size >= least:
                yield pd.concat(held)
                held, size = [], 0

        def close() -> Iterator[pd.DataFrame]:
            nonlocal size
            for src, dst, w in graph.edges(end) if key is not None else ():
                if len(w):
                    yield from gathered(max(1, SENT - len(w)))
                    held.append(pd.DataFrame({"ns": key[0], "src": src, "dst": dst, "w": w}))
                    size += len(w)

        for p in parts:
            for ns, b, n, t, salience, t_end, src, dst, *values in p.itertuples(index=False, name=None):
                if (ns, b) != key:
                    yield from close()
                    key, graph, end = (ns, b), _Rows(decay, interval, max_degree, cap, allow_negative), t_end
                mine = np.asarray(src, np.int64) * 2_654_435_761 % (1 << 32) % n == b
                if mine.any():
                    x, y, z, u = (np.asarray(v) for v in values)
                    graph.add(t, np.asarray(src, np.int64)[mine], np.asarray(dst, np.int64), (np.outer(x[mine], y) + np.outer(z[mine], u)) * salience)
            yield from gathered(1)
        yield from close()
        yield from gathered(1)

    ordered = dealt.repartition("ns", "_b").sortWithinPartitions("ns", "_b", "t")
    return ordered.select("ns", "_b", "_n", "t", "salience", "t_end", "src", "dst", *"abcd").mapInPandas(run, f"ns {kinds['ns']}, src {kinds['f']}, dst {kinds['f']}, w double")


def grown(edges: DataFrame | None, deltas: DataFrame, before: DataFrame | None, now: DataFrame, decay: float = DECAY, interval: int = INTERVAL, **options) -> DataFrame:
    """(ns, src, dst, w): ``edges`` as of write t of ``before`` (ns, t) after the deltas of later writes, as of write t of ``now``.

    Rows that have deltas are folded; the others only age, in one pass without a fold.
    """
    if edges is None or before is None:
        return row_fold(deltas, now, decay=decay, interval=interval, **options)
    touched = deltas.select("ns", "src").distinct()
    start = edges.join(touched, ["ns", "src"], "left_semi").join(before.select("ns", "t"), "ns").select("ns", "src", "dst", "t", F.col("w").alias("delta"))
    folded = row_fold(start.unionByName(deltas.select("ns", "src", "dst", "t", "delta")), now, decay=decay, interval=interval, **options)
    clocks = now.select("ns", F.col("t").alias("_now")).join(before.select("ns", F.col("t").alias("_then")), "ns")
    rest = edges.join(touched, ["ns", "src"], "left_anti").join(clocks, "ns", "left")
    steps = F.coalesce(_epoch(F.col("_now"), interval) - _epoch(F.col("_then"), interval), F.lit(0))
    aged = rest.select("ns", "src", "dst", (F.col("w") * F.pow(F.lit(max(0.0, 1 - decay)), steps)).alias("w"), steps.alias("_n"))
    return aged.filter(f"_n = 0 OR abs(w) >= {GONE}").drop("_n").unionByName(folded)


def namespace_fold(codes: DataFrame, rule: str = "oja", rate: float = RATE, decay: float = DECAY, interval: int = INTERVAL, max_degree: int = MAX_DEGREE, max_pairs: int = MAX_PAIRS, cap: bool = True) -> DataFrame:
    """Sequential fold of a whole namespace, for the rule that reads the edge it changes; parallel over namespaces."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns_now, seq_now, pairs, graph, count = None, None, [], {}, 0

        def write():
            nonlocal graph, count
            count += 1
            if interval > 0 and count % interval == 0:
                graph = {i: {j: v * (1 - decay) for j, v in row.items() if abs(v * (1 - decay)) >= GONE} for i, row in graph.items()}
            top = sorted(pairs, key=lambda x: (-abs(x[1]), x[0]))[:max_pairs]
            names, values = [i for i, _ in top], np.array([v for _, v in top])
            old = np.array([[graph.get(i, {}).get(j, 0.0) for j in names] for i in names]) if rule == "oja" else None
            for i, deltas in zip(names, pair_matrix(rule, rate, values, old=old).tolist(), strict=True):
                graph[i] = settled_row(grown_row(graph.get(i, {}), i, names, deltas), max_degree, cap)

        def rows():
            return [(ns_now, i, j, v) for i, row in graph.items() for j, v in row.items()]

        for p in parts:
            done = []
            for ns, seq, feature, w in zip(p["ns"], p["seq"], p["feature"], p["w"], strict=True):
                if (ns, seq) != (ns_now, seq_now):
                    if pairs:
                        write()
                    if ns != ns_now:
                        done += rows()
                        graph, count = {}, 0
                    ns_now, seq_now, pairs = ns, seq, []
                pairs.append((feature, w))
            yield pd.DataFrame(done, columns=["ns", "src", "dst", "w"])
        if pairs:
            write()
        yield pd.DataFrame(rows(), columns=["ns", "src", "dst", "w"])

    kinds = {f.name: f.dataType.simpleString() for f in codes.schema}
    ordered = codes.repartition("ns").sortWithinPartitions("ns", "seq", "feature").select("ns", "seq", "feature", "w")
    return ordered.mapInPandas(run, f"ns {kinds['ns']}, src {kinds['feature']}, dst {kinds['feature']}, w double")


# --- control conditions ---------------------------------------------------------------------


def zeroed(edges: DataFrame) -> DataFrame:
    return edges.limit(0)


def shuffled(edges: DataFrame, seed: int) -> DataFrame:
    """Nodes renamed by a permutation in digest order, which keeps degrees; self loops go."""
    nodes = edges.select("ns", F.col("src").alias("node")).unionByName(edges.select("ns", F.col("dst").alias("node"))).distinct()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("node").cast("string")))
    by_id = nodes.withColumn("_k", F.row_number().over(W.partitionBy("ns").orderBy("node")))
    by_hash = nodes.withColumn("_k", F.row_number().over(W.partitionBy("ns").orderBy(digest, "node"))).withColumnRenamed("node", "to")
    names = by_id.join(by_hash, ["ns", "_k"]).select("ns", "node", "to")
    out = edges.join(names.select("ns", F.col("node").alias("src"), F.col("to").alias("_s")), ["ns", "src"]).join(names.select("ns", F.col("node").alias("dst"), F.col("to").alias("_d")), ["ns", "dst"])
    return out.filter("_s <> _d").select("ns", F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")


# Names of the edge conditions.
CONDITIONS = {"learned": ("learned", "identity", "original"), "zero": ("zero", "none", "off"), "shuffled": ("shuffled", "shuffled_degree_preserving", "permuted"), "random": ("random", "random_degree_matched")}


def condition(name: str) -> str:
    """The edge condition of a name; hyphens count as underscores."""
    for plain, names in CONDITIONS.items():
        if name.lower().replace("-", "_") in names:
            return plain
    raise ValueError(f"unknown edge condition: {name}")


def conditioned(edges: DataFrame, name: str, seed: int) -> DataFrame:
    """The edges that messages follow under a condition."""
    return {"learned": lambda: edges, "zero": lambda: zeroed(edges), "shuffled": lambda: shuffled(edges, seed), "random": lambda: random_targets(edges, seed)}[condition(name)]()


#: Rounds of the permutation of node numbers.
ROUNDS = 10


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The image of the number ``x`` below ``n`` under a permutation of all numbers below ``n`` that ``key`` chooses.

    Each round mirrors a number at a key, modulo n, where a bit of the digest of the larger of
    the two says so; both of a pair see the same bit, so a round is one to one for any n.
    """

    def step(value: Column, r: Column) -> Column:
        name = F.concat_ws(":", key, r.cast("string"))
        other = (F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % n + n - value) % n
        bit = F.substring(F.md5(F.concat_ws(":", name, F.greatest(value, other).cast("string"))), 1, 1) >= "8"
        return F.when(bit, other).otherwise(value)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def random_targets(edges: DataFrame, seed: int) -> DataFrame:
    """Each row keeps its weights and degree; its targets are the first nodes, itself left out, in a permutation of its own.

    Nodes are numbered within the namespace, and a row draws as many numbers as it has
    edges and one more, so the work is in proportion to the edges.
    """
    nodes = edges.select("ns", F.col("src").alias("node")).unionByName(edges.select("ns", F.col("dst").alias("node"))).distinct()
    sizes = nodes.groupBy("ns").agg(F.count(F.lit(1)).alias("_n"))
    before = running_sum(nodes.withColumn("_one", F.lit(1).cast("long")), ["ns"], [F.col("node")], "_one")
    numbered = settle(before.select("ns", "node", F.col("_before").alias("_x")), "numbered-nodes")
    rows = edges.groupBy("ns", "src").agg(F.count(F.lit(1)).alias("_d")).join(sizes, "ns").join(numbered.select("ns", F.col("node").alias("src"), F.col("_x").alias("_own")), ["ns", "src"])
    drawn = rows.select("ns", "src", "_own", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_d"), F.col("_n") - 1))).alias("_draw"))
    drawn = drawn.withColumn("_x", permuted(F.col("_draw"), F.col("_n"), F.concat_ws(":", F.lit(str(seed)), F.col("src").cast("string"))))
    picked = drawn.filter("_x <> _own").withColumn("_k", F.row_number().over(W.partitionBy("ns", "src").orderBy("_draw")))
    targets = picked.join(numbered.withColumnRenamed("node", "dst"), ["ns", "_x"]).select("ns", "src", "_k", "dst")
    weights = edges.withColumn("_k", F.row_number().over(W.partitionBy("ns", "src").orderBy(F.abs("w").desc(), "dst")))
    return weights.select("ns", "src", "_k", "w").join(targets, ["ns", "src", "_k"]).select("ns", "src", "dst", "w")


# --- episode index and context graph ----------------------------------------------------------


def episode_index(codes: DataFrame, salience: Column | float = 1.0, most: int = 192) -> DataFrame:
    """(ns, episode_id, feature, w): strongest features of each episode, weighted by salience."""
    order = W.partitionBy("ns", "episode_id").orderBy(F.abs("w").desc(), "feature")
    top = codes.filter("w <> 0").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    return top.select("ns", "episode_id", "feature", (F.col("w") * salience).alias("w"))


def adjusted_authority(authority: Column, change: Column) -> Column:
    """Potentiation and depression stay within 0 and 2."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), authority + change))


def context_deltas(contexts: DataFrame, addresses: DataFrame, rate: float, on: list[str], keep: list[str]) -> DataFrame:
    """(on..., keep... of the addresses, src, dst, delta) of the first 64 context and 128 address entries of each write."""
    first = lambda df, n: df.withColumn("_r", F.row_number().over(W.partitionBy(*on).orderBy("feature"))).filter(F.col("_r") <= n)
    c = first(contexts, 64).select(*on, F.col("feature").alias("src"), F.col("w").alias("_c"))
    a = first(addresses, 128).select(*dict.fromkeys([*on, *keep]), F.col("feature").alias("dst"), F.col("w").alias("_a"))
    return c.join(a, on).withColumn("delta", F.lit(rate) * F.col("_c") * F.col("_a")).drop("_c", "_a")


def context_graph(contexts: DataFrame, addresses: DataFrame, rate: float, on: list[str], max_degree: int = 128, order: str | None = None) -> DataFrame:
    """(ns, src context feature, dst address feature, w): sums of rate * context * address over writes.

    With ``order``, a column of both that numbers the writes, rows are pruned after each
    write, each a stream; without it the writes are summed and rows are pruned once, which
    is the same as long as no row exceeds the degree.
    """
    links = context_deltas(contexts, addresses, rate, on, [order] if order else [])
    if order is None:
        return pruned(links.groupBy("ns", "src", "dst").agg(F.sum("delta").alias("w")), max_degree)
    deltas = links.select("ns", "src", "dst", F.col(order).cast("long").alias("t"), "delta")
    return row_fold(deltas, deltas.select("ns", "t").distinct(), 0.0, 0, max_degree, cap=False, allow_negative=True)
