"""Graphs and recall: hand-computed micro graphs, and the modes against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import graph as G
from recallgrid.operators import recall as R

CODES = "ns int, episode_id long, seq long, feature int, w double"


def codes(spark, n=60, seed=0, features=12, spaces=2):
    rng, rows = np.random.default_rng(seed), []
    for ns in range(spaces):
        for s in range(n):
            idx = rng.choice(features, 4, replace=False)
            v = rng.normal(size=4)
            rows += [(ns, s, s, int(i), float(x)) for i, x in zip(idx, v / np.linalg.norm(v), strict=True)]
    return spark.createDataFrame(rows, CODES)


def table(edges):
    return {(r.ns, r.src, r.dst): r.w for r in edges.collect()}


def writes(c):
    return G.with_write_number(c).select("ns", "t").distinct()


def reference(rows, rule, max_degree=128, cap=False, interval=100, decay=0.001, rate=0.12):
    """A plain sequential fold over one namespace."""
    graph, mu, m2, r, count = {}, {}, {}, G.mean_rate(rate), 0
    for s in sorted({x[0] for x in rows}):
        pairs = sorted(((f, w) for q, f, w in rows if q == s), key=lambda p: (-abs(p[1]), p[0]))
        count += 1
        if interval and count % interval == 0:
            graph = {i: {j: v * (1 - decay) for j, v in row.items()} for i, row in graph.items()}
        for k, (i, vi) in enumerate(pairs):
            for j, vj in pairs[k + 1 :]:
                old = graph.get(i, {}).get(j, 0.0)
                d = {
                    "hebb": vi * vj,
                    "covariance": (vi - mu.get(i, 0)) * (vj - mu.get(j, 0)),
                    "oja": vi * vj - 0.5 * (vi * vi + vj * vj) * old,
                    "bcm": 0.5 * (vi * vj * (vi - m2.get(i, 0)) + vj * vi * (vj - m2.get(j, 0))),
                }[rule] * rate
                for a, b in ((i, j), (j, i)):
                    row = graph.setdefault(a, {})
                    row[b] = max(0.0, row.get(b, 0.0) + d)
                    if row[b] < 1e-12:
                        del row[b]
        for f, w in pairs:
            mu[f] = (1 - r) * mu.get(f, 0.0) + r * abs(w)
            m2[f] = (1 - r) * m2.get(f, 0.0) + r * w * w
        for i in graph:
            graph[i] = G.settled_row(graph[i], max_degree, cap)
    return {(i, j): v for i, row in graph.items() for j, v in row.items()}


@pytest.mark.parametrize("rule", ["hebb", "covariance", "bcm"])
def test_closed_form_and_row_fold_are_the_sequential_fold(spark, rule):
    c = codes(spark)
    rows = {ns: [(r.seq, r.feature, r.w) for r in c.collect() if r.ns == ns] for ns in (0, 1)}
    deltas = G.pair_deltas(c, rule)
    closed = table(G.closed_form(deltas, writes(c), decay=0.01, interval=7))
    folded = table(G.row_fold(deltas, writes(c), decay=0.01, interval=7, max_degree=4, cap=True))
    for ns in (0, 1):
        want = reference(rows[ns], rule, interval=7, decay=0.01)
        assert {k[1:]: v for k, v in closed.items() if k[0] == ns} == pytest.approx(want, abs=1e-12)
        want = reference(rows[ns], rule, max_degree=4, cap=True, interval=7, decay=0.01)
        mine = {k[1:]: v for k, v in folded.items() if k[0] == ns}
        assert mine == pytest.approx(want, abs=1e-12)


def test_oja_fold(spark):
    c = codes(spark, 40, 3)
    got = table(G.namespace_fold(c, "oja", max_degree=5))
    for ns in (0, 1):
        rows = [(r.seq, r.feature, r.w) for r in c.collect() if r.ns == ns]
        assert {k[1:]: v for k, v in got.items() if k[0] == ns} == pytest.approx(reference(rows, "oja", max_degree=5, cap=True), abs=1e-12)


def test_rules(spark):
    c = codes(spark, 5)
    assert G.pair_deltas(c, "none").count() == 0
    with pytest.raises(ValueError):
        G.pair_deltas(c, "unknown")


def deltas(spark, values):
    return spark.createDataFrame([(0, 1, 2, t + 1, d) for t, d in enumerate(values)], "ns int, src int, dst int, t long, delta double")


def test_clamp_is_a_fold(spark):
    w = spark.createDataFrame([(0, 3)], "ns int, t long")
    got = table(G.closed_form(deltas(spark, [0.5, -0.8, 0.2]), w))
    assert got == {(0, 1, 2): pytest.approx(0.2)}
    assert table(G.row_fold(deltas(spark, [0.5, -0.8]), w)) == {}


def test_row_cap(spark):
    e = spark.createDataFrame([(0, 1, 2, 3.0), (0, 1, 3, 4.0)], "ns int, src int, dst int, w double")
    assert table(G.capped(e)) == {(0, 1, 2): pytest.approx(0.6), (0, 1, 3): pytest.approx(0.8)}


def q(spark, entries):
    return spark.createDataFrame([(0, 9, f, v) for f, v in entries.items()], "ns int, query_id long, feature int, v double")


def state(df):
    return {r.feature: r.v for r in df.collect()}


EDGE = "ns int, src int, dst int, w double"


def test_two_step_recall(spark):
    e = spark.createDataFrame([(0, a, b, 0.5) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2))], EDGE)
    none = spark.createDataFrame([], EDGE)
    options = {"beta": 1.0, "gamma": 0.0, "hub": 0.0}
    first, _ = R.recall(q(spark, {1: 1.0}), e, none, 1, **options)
    assert state(first) == pytest.approx({1: 0.816497, 2: 0.577350}, abs=1e-6)
    second, _ = R.recall(q(spark, {1: 1.0}), e, none, 2, **options)
    assert state(second) == pytest.approx({1: 0.893669, 2: 0.366384, 3: 0.259073}, abs=1e-6)


def test_zero_graph_gives_the_query(spark):
    none = spark.createDataFrame([], EDGE)
    final, timed = R.recall(q(spark, {1: 1.0}), none, none, 2)
    assert state(final) == {1: 1.0} and timed.count() == 0


def test_temporal_sink_dominates(spark):
    none = spark.createDataFrame([], EDGE)
    t = spark.createDataFrame([(0, 1, 4, 1.0)], EDGE)
    final, _ = R.recall(q(spark, {1: 1.0}), none, t, 1, anchor=0.1, beta=0.0, gamma=1.0)
    got = state(final)
    assert got[4] == pytest.approx(1.0) and got[1] == pytest.approx(1e-7, rel=1e-3)


def test_partitioning_does_not_matter(spark):
    c = codes(spark)
    a = table(G.closed_form(G.pair_deltas(c, "hebb"), writes(c)))
    b = table(G.closed_form(G.pair_deltas(c.repartition(9), "hebb"), writes(c)))
    assert a == pytest.approx(b)


def test_controls_keep_degrees(spark):
    c = codes(spark)
    e = G.closed_form(G.pair_deltas(c, "hebb"), writes(c))
    out = lambda df: sorted(r["n"] for r in df.groupBy("ns", "src").agg(F.count(F.lit(1)).alias("n")).collect())
    assert out(G.random_targets(e, 1)) == out(e)
    assert out(G.shuffled(e, 1)) == out(e) and G.zeroed(e).count() == 0


@pytest.mark.parametrize("rule", ["hebb", "covariance", "oja"])
def test_streamed_write_fold(spark, tmp_path, rule):
    """Micro-batches, a restart between them, equal the batch fold; a batch emits the rows that it touched alone."""
    from recallgrid.streaming.writes import CHANGES, late_writes, run_changes, streaming_edges

    c = codes(spark, 30, 5, spaces=2)
    packed = c.groupBy("ns", "seq").agg(F.sort_array(F.collect_list(F.struct("feature", "w"))).alias("code")).cache()
    src, place = tmp_path / "in", str(tmp_path / "state")
    packed.filter("seq < 15").coalesce(1).write.parquet(str(src))
    streaming_edges(spark, str(src), place, packed.schema, rule=rule, max_degree=6, interval=4)
    packed.filter("seq >= 15 AND seq < 29").coalesce(1).write.mode("append").parquet(str(src))
    run_changes(spark, str(src), place, packed.schema, rule=rule, max_degree=6, interval=4)
    packed.filter("seq = 29 OR seq = 3").coalesce(1).write.mode("append").parquet(str(src))
    got = streaming_edges(spark, str(src), place, packed.schema, rule=rule, max_degree=6, interval=4)
    if rule == "oja":
        want = G.namespace_fold(c, "oja", max_degree=6, interval=4)
    else:
        want = G.row_fold(G.pair_deltas(c, rule), writes(c), max_degree=6, interval=4)
    assert table(got) == pytest.approx(table(want), abs=1e-9)
    changes = spark.read.schema(CHANGES.format(ns="int")).parquet(f"{place}/changes")
    assert {(r.seq) for r in late_writes(changes).collect()} == {3}
    newest = changes.join(changes.filter("src IS NULL AND NOT late").groupBy("ns").agg(F.max("version").alias("now")), "ns").filter("src IS NOT NULL AND version = now")
    touched = {(r.ns, r.feature) for r in c.filter("seq = 29").collect()}
    assert {(r.ns, r.src) for r in newest.collect()} == touched


def plain_recall(queries, association, temporal, steps, k):
    """(final, temporal) of dictionaries, message by message."""
    degree = lambda e: {i: sum(abs(w) for (a, _), w in e.items() if a == i) for i, _ in e}

    def scaled(e):
        d = degree(e)
        return {(i, j): w / math.sqrt(max(d.get(i, 0.0), 1e-12) * max(d.get(j, 0.0), 1e-12)) for (i, j), w in e.items()}

    a, t, hubs, out = scaled(association), scaled(temporal), degree(association), {}
    for q, start in queries.items():
        state, moved = start, {}
        for _ in range(steps):
            total = dict(start)
            for graph, kind in ((a, "a"), (t, "t"), ({(j, i): w for (i, j), w in t.items()}, "t")):
                for (i, j), w in graph.items():
                    if i in state:
                        x = state[i] * w
                        total[j] = total.get(j, 0.0) + (x * 0.65 / math.sqrt(1 + hubs.get(j, 0.0)) if kind == "a" else x * 0.15)
                        if kind == "t":
                            moved[j] = moved.get(j, 0.0) + x
            top = sorted(((i, v) for i, v in total.items() if v >= 0), key=lambda p: (-p[1], p[0]))[:k]
            size = math.sqrt(sum(v * v for _, v in top))
            state = {i: v / size for i, v in top}
        top = sorted(((i, v) for i, v in moved.items() if v), key=lambda p: (-abs(p[1]), p[0]))[:k]
        out[q] = state, {i: v / math.sqrt(sum(v * v for _, v in top)) for i, v in top}
    return out


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_all_steps_of_a_query_in_one_task(spark, monkeypatch, sent):
    draw, plans, write = random.Random(4), [], R.settle
    edge = lambda n: {(i, j): draw.uniform(0.1, 1.0) for i, j in {(draw.randrange(20), draw.randrange(20)) for _ in range(n)} if i != j}
    a, t = edge(90), edge(40)
    queries = {q: {f: draw.uniform(-0.5, 1.0) for f in draw.sample(range(24), 5)} for q in range(12)}
    table = lambda e: spark.createDataFrame([(1, i, j, w) for (i, j), w in e.items()], "ns long, src int, dst int, w double")
    asked = spark.createDataFrame([(1, q, f, v) for q, x in queries.items() for f, v in x.items()], "ns long, query_id long, feature int, v double")
    monkeypatch.setattr(R, "SENT_EDGES", sent)
    monkeypatch.setattr(R, "TASK_ROWS", 16)
    monkeypatch.setattr(R, "settle", lambda df, label="table": plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    final, timed = R.recall(asked, table(a), table(t), 2, k=9)
    want = plain_recall(queries, a, t, 2, 9)
    for got, place in ((final, 0), (timed, 1)):
        assert {(r.query_id, r.feature): r.v for r in got.collect()} == {(q, f): pytest.approx(v) for q, x in want.items() for f, v in x[place].items()}
    plan = next(p for label, p in plans if label == "traced")
    if sent:  # the queries are dealt out once, whatever the number of steps
        assert plan.count("Exchange hashpartitioning(ns") == 1


def test_deltas_are_dealt_by_their_number(spark, monkeypatch):
    c = codes(spark)
    deltas = G.pair_deltas(c, "hebb")
    monkeypatch.setattr(G, "TASK_DELTAS", 100)
    many = G.closed_form(deltas, G.with_write_number(c).select("ns", "t").distinct())
    assert many.rdd.getNumPartitions() >= deltas.count() // 100


@pytest.mark.parametrize("held", [1 << 22, 40])
@pytest.mark.parametrize("rule", ["hebb", "covariance", "bcm"])
def test_events_are_folded_as_their_deltas(spark, monkeypatch, rule, held):
    monkeypatch.setattr(G, "HELD", held)
    c, how = codes(spark), {"decay": 0.01, "interval": 7, "max_degree": 4}
    writes = G.with_write_number(c).select("ns", "t").distinct()
    one = lambda events: events.withColumn("salience", F.lit(1.0))
    streams = c.withColumn("stream", F.col("seq") % 3)
    made = [
        (G.pair_events(c, rule), G.pair_deltas(c, rule)),
        (G.temporal_events(streams, ["stream"], numbers=G.with_write_number(c.select("ns", "seq").distinct())), G.temporal_deltas(streams, ["stream"])),
    ]
    for events, deltas in made:
        want = {(r.ns, r.src, r.dst): r.w for r in G.row_fold(deltas, writes, **how).collect()}
        got = G.event_fold(one(events), writes, **how).collect()
        assert len(got) == len(want) > 0 and {(r.ns, r.src, r.dst): r.w for r in got} == {k: pytest.approx(v) for k, v in want.items()}
