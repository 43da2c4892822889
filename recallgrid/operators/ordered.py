"""The ordered fold of the second engine: every write sees what the one before it left.

Novelty, hub penalty, allocation and birth of a write depend on the addresses and the
graph before it, so a namespace's writes are folded one after the other, in parallel over
namespaces. State lives in keyed tables (graph rows, eligibility, moving averages, clocks);
a fold receives only the entries that its events' features touch, and gives back only the
rows it changed. Searches among stored episodes are distributed joins made before it: a
fold gets each event's strongest candidates and adds those written since.

Results do not depend on how writes are dealt into batches.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import graph as GR
from .gates import BIRTH, NEGATIVE, POSITIVE
from .postings import top_votes

#: Rows of keyed state: what kind, two keys, a name and two values.
STATE = "kind string, a long, b long, s string, v double, u double"
GRAPHS = ("association", "temporal", "links")


@dataclass
class FoldSettings:
    """The numbers that a fold needs; those of rates and bounds are the engine's defaults."""

    rule: str = "hebb"
    rate: float = GR.RATE
    temporal_rate: float = GR.TEMPORAL_RATE
    context_rate: float = 0.1
    decay: float = GR.DECAY
    interval: int = GR.INTERVAL
    max_degree: int = GR.MAX_DEGREE
    max_pairs: int = GR.MAX_PAIRS
    context_degree: int = 128
    hub: float = 0.5
    eligibility_decay: float = 0.95
    slots: int = 0
    birth_threshold: float = 0.75
    birth_authority: float = 0.10
    reserved: int = 0
    rivals: int = 30
    close: float = 0.45


class Rows:
    """Rows of one graph, each as the arrays of its targets and weights (0: no edge), aged when they are touched.

    A row holds ``max_degree`` entries at most after a write, so the arrays are as wide as the longest row.
    """

    def __init__(self, decay: float, interval: int, max_degree: int, cap: bool, allow_negative: bool):
        self.decay, self.interval, self.max_degree, self.cap, self.allow_negative = decay, interval, max_degree, cap, allow_negative
        self.place: dict[int, int] = {}
        self.dst, self.w = np.zeros((64, 32), np.int64), np.zeros((64, 32))
        self.now, self.kept, self.touched = np.zeros(64, np.int64), np.ones(64), np.zeros(64, bool)

    def _widened(self, rows: int, width: int) -> None:
        """Room for so many rows and entries of a row."""
        n, m = self.w.shape
        if rows <= n and width <= m:
            return
        n, m = max(n, 2 * rows) if rows > n else n, max(m, 2 * width) if width > m else m
        grow = lambda old, fill: np.pad(old, [(0, s - k) for s, k in zip((n, m), old.shape, strict=False)], constant_values=fill)
        self.dst, self.w, self.now, self.kept, self.touched = grow(self.dst, 0), grow(self.w, 0.0), grow(self.now, 0), grow(self.kept, 1.0), grow(self.touched, False)

    def load(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, t: int) -> None:
        """Takes the edges as of write t."""
        names, row, size = np.unique(src, return_inverse=True, return_counts=True)
        self._widened(len(names), size.max(initial=0))
        order = np.argsort(row, kind="stable")
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.dst[row[order], at], self.w[row[order], at] = dst[order], w[order]
        self.place = {int(i): k for k, i in enumerate(names)}
        self.now[: len(names)] = t

    def _aged(self, rows: np.ndarray, t: int, left: float) -> None:
        """Brings rows to write t, when ``left`` remains of the triggered decays."""
        rows = rows[(self.now[rows] != t) | (self.kept[rows] != left)]
        if not len(rows):
            return
        w = self.w[rows]
        steps = t // self.interval - self.now[rows] // self.interval if self.interval > 0 else np.zeros(len(rows), np.int64)
        for k in range(int(steps.max())):
            aged = w * max(0.0, 1 - self.decay)
            w = np.where((steps > k)[:, None], np.where(np.abs(aged) >= GR.GONE, aged, 0.0), w)
        kept = left / self.kept[rows]
        aged = w * kept[:, None]
        self.w[rows] = np.where((kept != 1.0)[:, None], np.where(np.abs(aged) >= GR.GONE, aged, 0.0), w)
        self.now[rows], self.kept[rows] = t, left

    def _known(self, features: list[int], t: int, left: float) -> tuple[np.ndarray, np.ndarray]:
        """(which of the features have a row, these rows) as of write t."""
        rows = np.array([self.place.get(i, -1) for i in features], np.int64)
        at = np.flatnonzero(rows >= 0)
        self._aged(rows[at], t, left)
        return at, rows[at]

    def degrees(self, features: list[int], t: int, left: float) -> np.ndarray:
        out = np.zeros(len(features))
        at, rows = self._known(features, t, left)
        out[at] = np.abs(self.w[rows]).sum(axis=1)
        return out

    def weights(self, features: list[int], targets: list[int], t: int, left: float) -> np.ndarray:
        """The edges from features to targets, 0 where there is none."""
        out = np.zeros((len(features), len(targets)))
        at, rows = self._known(features, t, left)
        out[at] = self._split(rows, np.array(targets, np.int64))[0]
        return out

    def _split(self, rows: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the rows at the targets, the rows' other weights)."""
        order = np.argsort(targets)
        there, w = np.zeros((len(rows), len(targets))), self.w[rows]
        if not len(targets):
            return there, w
        at = np.minimum(np.searchsorted(targets[order], self.dst[rows]), len(targets) - 1)
        r, c = np.nonzero((targets[order][at] == self.dst[rows]) & (w != 0))
        there[r, order[at[r, c]]] = w[r, c]
        w[r, c] = 0.0
        return there, w

    def add(self, src: list[int], targets: list[int], deltas: np.ndarray, t: int, left: float) -> None:
        """Adds a row of ``deltas`` to the row of each of ``src``, as ``grown_row`` and ``settled_row`` have it."""
        if not src:
            return
        fresh = [i for i in src if i not in self.place]
        first = len(self.place)
        self._widened(first + len(fresh), 0)
        self.place.update((i, first + k) for k, i in enumerate(fresh))
        self.now[first : len(self.place)], self.kept[first : len(self.place)] = t, left
        rows, dst = np.array([self.place[i] for i in src]), np.array(targets, np.int64)
        self._aged(rows, t, left)
        old, rest = self._split(rows, dst)
        value = old + deltas
        value = value if self.allow_negative else np.maximum(value, 0.0)
        value = np.where((deltas != 0.0) & (dst[None, :] != np.array(src)[:, None]), np.where(np.abs(value) < GR.SMALL, 0.0, value), old)
        w, dst = np.concatenate([rest, value], axis=1), np.concatenate([self.dst[rows], np.broadcast_to(dst, value.shape)], axis=1)
        most = int(np.count_nonzero(w, axis=1).max())
        order = np.lexsort((dst, -np.abs(w)), axis=1) if most > self.max_degree else np.argsort(w == 0, axis=1, kind="stable")
        n = min(most, self.max_degree)
        self._widened(0, n)
        w = np.take_along_axis(w, order[:, :n], axis=1)
        if self.cap:
            size = np.sqrt((w * w).sum(axis=1))
            w = np.where((size > 1.0)[:, None], w / np.maximum(size, 1.0)[:, None], w)
        self.w[rows] = 0.0
        self.w[rows, :n], self.dst[rows, :n], self.touched[rows] = w, np.take_along_axis(dst, order[:, :n], axis=1), True

    def changed(self, t: int, left: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sources, entries of each, targets, weights) of the touched rows as of write t."""
        rows = np.flatnonzero(self.touched)
        self._aged(rows, t, left)
        names = np.array(list(self.place), np.int64)
        r, c = np.nonzero(self.w[rows])
        return names[rows], np.bincount(r, minlength=len(rows)), self.dst[rows[r], c], self.w[rows[r], c]


class Fold:
    """One namespace's writes, folded in order."""

    def __init__(self, settings: FoldSettings, state: pd.DataFrame):
        s = self.s = settings
        self.graphs = {"association": Rows(s.decay, s.interval, s.max_degree, True, False), "temporal": Rows(s.decay, s.interval, s.max_degree, True, False), "links": Rows(0.0, 0, s.context_degree, False, True)}
        self.writes = self.graph_writes = self.born = 0
        self.left = 1.0
        self.eligibility: dict[int, tuple[float, int]] = {}
        self.averages: dict[int, tuple[float, float]] = {}
        self.previous: dict[str, dict[int, float]] = defaultdict(dict)
        graphs = state["kind"].isin(GRAPHS)
        rest = state[~graphs]
        for row in rest[rest["kind"] == "clock"].itertuples(index=False):
            self.writes, self.graph_writes, self.born = int(row.a), int(row.b), int(row.v)
        for name, rows in state[graphs].groupby("kind"):
            self.graphs[name].load(rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64), rows["v"].to_numpy(float), self.graph_writes)
        for row in rest.itertuples(index=False):
            if row.kind == "eligibility":
                self.eligibility[int(row.a)] = row.v, int(row.b)
            elif row.kind == "average":
                self.averages[int(row.a)] = row.v, row.u
            elif row.kind == "previous":
                self.previous[row.s][int(row.a)] = row.v
        self.streams: set[str] = set()
        self.written: dict[str, dict[int, float]] = {}
        self.posted: dict[int, set[str]] = defaultdict(set)
        self.scores: list[tuple] = []
        self.addresses: list[tuple[int, list[tuple[int, float]]]] = []

    def _novelty(self, code: dict[int, float], stored: list[tuple[str, int, float]]) -> tuple[float, float]:
        votes: Counter[str] = Counter()
        for i in code:
            votes.update(self.posted.get(i, ()))
        near = [(-n, e, dot) for e, n, dot in stored if e not in self.written]
        near += [(-n, e, None) for e, n in votes.items()]
        best = heapq.nsmallest(self.s.rivals, near, key=lambda x: x[:2])
        dots = [sum(w * code[i] for i, w in self.written[e].items() if i in code) if dot is None else dot for _, e, dot in best]
        if not dots:
            return 1.0, 0.0
        return max(0.0, min(1.0, 1.0 - max(dots))), min(1.0, sum(d > self.s.close for d in dots) / 5.0)

    def _allocated(self, code: dict[int, float], novelty: float, utility: float) -> dict[int, float]:
        s, out = self.s, {}
        degrees = self.graphs["association"].degrees(list(code), self.graph_writes, self.left).tolist()
        for (i, w), degree in zip(code.items(), degrees, strict=True):
            e, at = self.eligibility.get(i, (0.0, self.writes))
            e *= s.eligibility_decay ** (self.writes - at)
            e = (0.0 if e < 1e-6 else e) + abs(w)
            self.eligibility[i] = e, self.writes
            raw = 1.0 + 0.30 * novelty + 0.20 * utility + 0.05 * math.log1p(e)
            out[i] = w * max(0.15, min(2.0, raw / (1.0 + degree) ** s.hub))
        return _unit(out)

    def _learn(self, address: dict[int, float], context: list[tuple[int, float]], previous: dict[int, float], salience: float) -> None:
        s = self.s
        self.graph_writes += 1
        t, left = self.graph_writes, self.left
        top = sorted(address.items(), key=lambda x: (-abs(x[1]), x[0]))[: s.max_pairs]
        names = [i for i, _ in top]
        values = np.array([v for _, v in top])
        if s.rule not in ("none", "off", "zero"):
            known = [self.averages.get(i, (0.0, 0.0)) for i in names]
            mu, m2 = (np.array([k[x] for k in known]) for x in (0, 1))
            old = self.graphs["association"].weights(names, names, t, left) if s.rule == "oja" else None
            self.graphs["association"].add(names, names, GR.pair_matrix(s.rule, s.rate * salience, values, mu, m2, old), t, left)
            before = sorted(previous.items(), key=lambda x: (-abs(x[1]), x[0]))[: s.max_pairs]
            self.graphs["temporal"].add([i for i, _ in before], names, np.multiply.outer(s.temporal_rate * salience * np.array([v for _, v in before]), values), t, left)
        r = GR.mean_rate(s.rate)
        for i, v in top:
            mu, m2 = self.averages.get(i, (0.0, 0.0))
            self.averages[i] = (1 - r) * mu + r * abs(v), (1 - r) * m2 + r * v * v
        first, told = sorted(address.items())[:128], sorted(context)[:64]
        weights = np.array([v for _, v in first])
        self.graphs["links"].add([i for i, _ in told], [i for i, _ in first], np.multiply.outer(s.context_rate * salience * np.array([c for _, c in told]), weights), t, left)

    def write(self, seq: int, episode: str, stream: str, rejected: bool, gates: dict[str, float | None], code: list[tuple[int, float]], context: list[tuple[int, float]], stored: list[tuple[str, int, float]]) -> None:
        """One event: its gates without novelty and redundancy, its bound code, context code and stored candidates."""
        s, bound = self.s, dict(code)
        self.writes += 1
        novelty, interference = self._novelty(bound, stored)
        told = novelty if gates["novelty"] is None else gates["novelty"]
        known = 1.0 - novelty if gates["redundancy"] is None else gates["redundancy"]
        gate = lambda rest, weights: 2.0 / (1.0 + math.exp(-(rest + weights.get("novelty", 0.0) * told + weights["redundancy"] * known)))
        positive, negative = max(0.02, gate(gates["positive"], POSITIVE)), gate(gates["negative"], NEGATIVE)
        address = self._allocated(bound, told, gates["utility"])
        score, slot = 0.0, None
        if self.born < s.slots:
            raw = BIRTH["novelty"] * novelty + BIRTH["interference"] * interference + gates["birth"]
            score = 1.0 / (1.0 + math.exp(-4.0 * (raw - 0.5)))
            if score >= s.birth_threshold:
                slot, self.born = self.born, self.born + 1
                address = _unit({**address, s.reserved + slot: max(address.values(), default=1.0) * s.birth_authority})
        if negative > 0.5:
            self.left *= 1 - min(0.05, 0.01 * negative)
        if not rejected:
            self._learn(address, context, self.previous.get(stream, {}), positive)
        for i in self.written.get(episode, ()):
            self.posted[i].discard(episode)
        self.written[episode] = address
        for i in address:
            self.posted[i].add(episode)
        self.previous[stream] = address
        self.streams.add(stream)
        self.scores.append((seq, novelty, interference, positive, negative, score, slot))
        self.addresses.append((seq, sorted(address.items())))

    def changes(self) -> pa.Table:
        """Scores, addresses, the rows of state that changed (a graph row that has lost all entries has no targets), and the clock."""
        out: list[pa.Table] = []

        def lists(sizes: np.ndarray, values: Iterable, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))

        def add(kind: str, a: Iterable, b: Iterable | None, s: Iterable | None, sizes: np.ndarray | int, x: np.ndarray, to: Iterable | None = None) -> None:
            n = len(a)
            sizes = np.full(n, sizes) if isinstance(sizes, int) else sizes
            none = lambda given, dtype: pa.nulls(n, dtype) if given is None else pa.array(given, dtype)
            targets = pa.nulls(n, pa.list_(pa.int64())) if to is None else lists(sizes, to, pa.int64())
            out.append(pa.table([pa.repeat(pa.scalar(kind), n), pa.array(a, pa.int64()), none(b, pa.int64()), none(s, pa.string()), lists(sizes, x, pa.float64()), targets], names=["kind", "a", "b", "s", "x", "to"]))

        flat = lambda pairs: np.array(pairs, float).ravel()
        add("score", [row[0] for row in self.scores], [row[-1] for row in self.scores], None, 5, flat([row[1:-1] for row in self.scores]))
        add("address", [seq for seq, _ in self.addresses], None, None, np.array([len(e) for _, e in self.addresses], int), [w for _, e in self.addresses for _, w in e], [i for _, e in self.addresses for i, _ in e])
        for name, rows in self.graphs.items():
            src, sizes, dst, w = rows.changed(self.graph_writes, self.left)
            add(name, src, None, None, sizes, w, dst)
        add("eligibility", list(self.eligibility), [at for _, at in self.eligibility.values()], None, 1, flat([e for e, _ in self.eligibility.values()]))
        add("average", list(self.averages), None, None, 2, flat(list(self.averages.values())))
        last = [(i, stream, w) for stream, address in self.previous.items() if stream in self.streams for i, w in address.items()]
        add("previous", [i for i, _, _ in last], None, [stream for _, stream, _ in last], 1, flat([w for _, _, w in last]))
        add("clock", [self.writes], [self.graph_writes], None, 2, flat([self.born, self.left]))
        return pa.concat_tables(out)


def _unit(code: dict[int, float]) -> dict[int, float]:
    size = math.sqrt(sum(w * w for w in code.values()))
    return {i: w / size for i, w in code.items()} if size > 1e-12 else code


def rivals(asked: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """(ns, seq, stored): for each code of ``asked`` (ns, seq, feature, w) the ``limit`` codes of ``stored`` (ns, episode_id, feature, w) that share most features, ties by id, as (episode, votes, dot)."""
    a = asked.select("ns", "feature", F.struct("ns", "seq").alias("_q"), F.col("w").alias("_a"))
    b = stored.select("ns", "feature", F.col("episode_id").cast("string").alias("episode"), F.col("w").alias("_b"))
    found = top_votes(a.drop("_a"), b.drop("_b"), limit, ["ns", "feature"], "_q", "episode")
    pairs = found.select("_q", "_q.ns", "episode", "votes").join(a.select("_q", "feature", "_a"), "_q").join(b, ["ns", "episode", "feature"])
    top = pairs.groupBy("_q", "episode", "votes").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot")).select("_q.ns", "_q.seq", "episode", "votes", "dot")
    return top.groupBy("ns", "seq").agg(F.collect_list(F.struct("episode", "votes", "dot")).alias("stored"))


#: Kinds of state that one key holds, and which column that is.
KEYED = {"eligibility": "a", "average": "a", "previous": "s", "clock": None}


def _state_key() -> Column:
    out = F.lit("")
    for kind, column in KEYED.items():
        if column:
            out = F.when(F.col("kind") == kind, F.col(column).cast("string")).otherwise(out)
    return out


def renewed_state(state: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Keyed state (ns and STATE) in which the changed keys have their new values."""
    x = F.col("x")
    new = changes.filter(F.col("kind").isin(*KEYED)).select("ns", "kind", "a", "b", "s", x[0].alias("v"), F.get(x, F.lit(1)).alias("u"))
    if state is None:
        return new
    gone = new.select("ns", "kind", _state_key().alias("_key")).distinct()
    return state.withColumn("_key", _state_key()).join(gone, ["ns", "kind", "_key"], "left_anti").drop("_key").unionByName(new)


def entries(changes: DataFrame, source: str, target: str) -> DataFrame:
    """(ns, source, target, w) of packed rows of ``fold_writes``."""
    return changes.select("ns", F.col("a").alias(source), F.inline(F.arrays_zip(F.col("to").alias(target), F.col("x").alias("w"))))


def renewed_edges(edges: DataFrame | None, changes: DataFrame, name: str, before: DataFrame | None, decay: float = 0.0, interval: int = 0) -> DataFrame:
    """(ns, src, dst, w): changed rows as they are, the others after the decays since ``before`` (ns, b: write number then)."""
    own = changes.filter(F.col("kind") == name)
    new = entries(own, "src", "dst")
    if edges is None:
        return new
    clocks = changes.filter("kind = 'clock'").select("ns", F.col("b").alias("_now"), F.col("x")[1].alias("_left")).join(before.select("ns", F.col("b").alias("_then")), "ns", "left")
    steps = F.floor(F.col("_now") / interval) - F.floor(F.coalesce("_then", F.lit(0)) / interval) if interval > 0 else F.lit(0)
    kept = F.coalesce(F.col("_left") * F.pow(F.lit(max(0.0, 1 - decay)), steps), F.lit(1.0))
    rest = edges.join(own.select("ns", F.col("a").alias("src")).distinct(), ["ns", "src"], "left_anti").join(clocks, "ns", "left")
    aged = rest.select("ns", "src", "dst", (F.col("w") * kept).alias("w"), (kept == 1.0).alias("_same")).filter(F.col("_same") | (F.abs("w") >= GR.GONE)).drop("_same")
    return aged.unionByName(new)


def touched_state(state: DataFrame | None, graphs: dict[str, DataFrame | None], events: DataFrame, codes: DataFrame, contexts: DataFrame) -> DataFrame | None:
    """The entries of all state that the events (ns, stream), their codes and contexts (ns, feature) touch, as (ns and STATE)."""
    if state is None:
        return None
    features = codes.select("ns", "feature").distinct()
    streams = events.select("ns", F.col("stream").alias("s")).distinct()
    before = state.filter("kind = 'previous'").join(streams, ["ns", "s"], "left_semi")
    named = {"association": features, "temporal": features.unionByName(before.select("ns", F.col("a").alias("feature"))).distinct(), "links": contexts.select("ns", "feature").distinct()}
    columns = ["ns", "kind", "a", "b", "s", "v", "u"]
    out = before.select(*columns).unionByName(state.filter("kind = 'clock'").join(streams.select("ns").distinct(), "ns", "left_semi").select(*columns))
    out = out.unionByName(state.filter("kind IN ('eligibility', 'average')").join(features.withColumnRenamed("feature", "a"), ["ns", "a"], "left_semi").select(*columns))
    for name, keys in named.items():
        if graphs[name] is not None:
            rows = graphs[name].join(keys.withColumnRenamed("feature", "src"), ["ns", "src"], "left_semi")
            out = out.unionByName(rows.select("ns", F.lit(name).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("string").alias("s"), F.col("w").alias("v"), F.lit(None).cast("double").alias("u")))
    return out


def fold_writes(events: DataFrame, state: DataFrame, settings: FoldSettings) -> DataFrame:
    """(ns, kind, a, b, s, x, to): what the events of each namespace change, folded in order of seq; a graph row or an address is one row, with its features in ``to``.

    ``events`` have (ns, seq, episode, stream, rejected, novelty, redundancy, positive,
    negative, utility, birth, code, context, stored); codes are arrays of (feature, w),
    ``stored`` of (episode, votes, dot). ``state`` has ns and STATE, as of the last write.
    """
    schema = T.StructType([T.StructField("ns", events.schema["ns"].dataType), *T.StructType.fromDDL("kind string, a long, b long, s string, x array<double>, to array<long>")])
    form = to_arrow_schema(schema)

    def run(writes: pa.Table, known: pa.Table) -> pa.Table:
        if not len(writes):
            return form.empty_table()
        fold = Fold(settings, known.to_pandas())
        pairs: Callable = lambda code: [] if code is None else [(x["feature"], x["w"]) for x in code]
        given = lambda v: None if v is None or v != v else v
        for e in writes.sort_by("seq").to_pylist():
            gates = {c: given(e[c]) for c in ("novelty", "redundancy", "positive", "negative", "utility", "birth")}
            stored = [] if e["stored"] is None else [(x["episode"], x["votes"], x["dot"]) for x in e["stored"]]
            fold.write(e["seq"], e["episode"], e["stream"], e["rejected"], gates, pairs(e["code"]), pairs(e["context"]), stored)
        out = fold.changes()
        return out.add_column(0, "ns", writes["ns"].combine_chunks().take(pa.array(np.zeros(len(out), np.int64)))).cast(form)

    return events.groupBy("ns").cogroup(state.groupBy(F.col("ns").alias("_of"))).applyInArrow(run, schema)
