"""The second engine against an independent sequential fold; feedback and replay that later writes keep; forgetting."""

import json
import math

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import gates as G
from recallgrid.operators.capsules import BoundMemory, BoundSettings
from recallgrid.operators.memory import Memory, Settings

EVENT = "ns string, episode_id string, seq long, text string, metadata string, timestamp string, stream string"
SMALL = {"dimension": 512, "topk": 12, "steps": 1, "context_dimension": 128, "binding_dimension": 128, "address_topk": 20, "slots": 3, "max_degree": 8, "context_degree": 6, "interval": 3, "decay": 0.05, "birth_threshold": 0.6}
TEXTS = ["the red kite flies over the valley", "a blue boat waits in the harbour", "the kite is green today", "rumour about the harbour", "the boat left", "a red boat flies"]
META = ['{"place":"valley","utility":0.5}', '{"contradiction":1.5}', "{}", '{"rejected":true}', '{"novelty":0.2,"generated":true}', '{"corrects":"e3"}']


def events(n=12):
    return [("n" if i % 4 else "m", f"e{i % 9}", i, f"{TEXTS[i % 6]} {i % 5}", META[(i * 5) % 6], f"2024-01-{1 + (i * 7) % 28:02d}T10:00:00", f"s{i % 2}") for i in range(n)]


def slow_fold(memory, rows, rule):
    """Edges and scores by plain loops over dictionaries, write after write, from the bound codes alone."""
    s, f = memory.settings, memory.settings.fold()
    codes, contexts = {}, {}
    for table, out in zip(memory._bind(rows, "seq"), (codes, contexts), strict=True):
        for r in table.collect():
            out.setdefault((r.ns, r.seq), {})[r.feature] = r.w
    told = memory._gates(rows.withColumn("checksum", F.lit(None).cast("string"))).select("ns", "seq", "episode_id", "stream", "status", "told", "redundancy", "positive", "negative", "utility").orderBy("seq").collect()
    spaces, scores = {}, {}
    for e in told:
        sp = spaces.setdefault(e.ns, {"store": {}, "graph": {}, "temporal": {}, "links": {}, "elig": {}, "mean": {}, "second": {}, "prev": {}, "count": 0, "born": 0})
        code, context = codes.get((e.ns, e.seq), {}), contexts.get((e.ns, e.seq), {})
        near = sorted((-len(code.keys() & c.keys()), k, sum(v * code[i] for i, v in c.items() if i in code)) for k, c in sp["store"].items() if code.keys() & c.keys())[:30]
        dots = [d for _, _, d in near]
        novelty = max(0.0, min(1.0, 1 - max(dots))) if dots else 1.0
        interference = min(1.0, sum(d > 0.45 for d in dots) / 5) if dots else 0.0
        new = novelty if e.told is None else e.told
        known = 1 - novelty if e.redundancy is None else e.redundancy
        squash = lambda x: 2 / (1 + math.exp(-x))
        positive = max(0.02, squash(e.positive + G.POSITIVE["novelty"] * new + G.POSITIVE["redundancy"] * known))
        negative = squash(e.negative + G.NEGATIVE["redundancy"] * known)
        for i in list(sp["elig"]):
            sp["elig"][i] *= 0.95
            if sp["elig"][i] < 1e-6:
                del sp["elig"][i]
        address = {}
        for i, w in code.items():
            sp["elig"][i] = sp["elig"].get(i, 0) + abs(w)
            degree = sum(abs(x) for x in sp["graph"].get(i, {}).values())
            raw = 1 + 0.3 * new + 0.2 * e.utility + 0.05 * math.log1p(sp["elig"][i])
            address[i] = w * max(0.15, min(2.0, raw / (1 + degree) ** s.hub))
        unit = lambda c: {i: w / math.sqrt(sum(x * x for x in c.values())) for i, w in c.items()} if c else c
        address = unit(address)
        if sp["born"] < s.slots:
            score = 1 / (1 + math.exp(-4 * (0.45 * novelty + 0.3 * interference - 0.5)))
            if score >= s.birth_threshold:
                address = unit({**address, s.reserved + sp["born"]: max(address.values(), default=1.0) * 0.1})
                sp["born"] += 1
        age = lambda graph, keep: {i: {j: w * keep for j, w in row.items() if abs(w * keep) >= 1e-9} for i, row in graph.items()}
        if negative > 0.5:
            for g in ("graph", "temporal", "links"):
                sp[g] = age(sp[g], 1 - min(0.05, 0.01 * negative))
        if e.status != "rejected":
            sp["count"] += 1
            if sp["count"] % s.interval == 0:
                sp["graph"], sp["temporal"] = age(sp["graph"], 1 - s.decay), age(sp["temporal"], 1 - s.decay)

            def bump(graph, i, j, d, floor=True):
                if i != j and d:
                    v = graph.setdefault(i, {}).get(j, 0.0) + d
                    graph[i][j] = max(0.0, v) if floor else v
                    if abs(graph[i][j]) < 1e-12:
                        del graph[i][j]

            top = sorted(address.items(), key=lambda x: (-abs(x[1]), x[0]))
            for a, (i, vi) in enumerate(top):
                for j, vj in top[a + 1 :]:
                    if rule == "oja":
                        d = vi * vj - 0.5 * (vi * vi + vj * vj) * sp["graph"].get(i, {}).get(j, 0.0)
                    elif rule == "covariance":
                        d = (vi - sp["mean"].get(i, 0.0)) * (vj - sp["mean"].get(j, 0.0))
                    else:
                        d = 0.5 * (vi * vj * (vi - sp["second"].get(i, 0.0)) + vi * vj * (vj - sp["second"].get(j, 0.0)))
                    for x, y in ((i, j), (j, i)):
                        bump(sp["graph"], x, y, f.rate * positive * d)
            for i, vi in sp["prev"].get(e.stream, {}).items():
                for j, vj in top:
                    bump(sp["temporal"], i, j, f.temporal_rate * positive * vi * vj)
            for i, v in top:
                sp["mean"][i] = 0.988 * sp["mean"].get(i, 0.0) + 0.012 * abs(v)
                sp["second"][i] = 0.988 * sp["second"].get(i, 0.0) + 0.012 * v * v
            for i, c in context.items():
                for j, v in address.items():
                    bump(sp["links"], i, j, s.context_rate * positive * c * v, floor=False)
            for g, degree in (("graph", s.max_degree), ("temporal", s.max_degree), ("links", s.context_degree)):
                for i, row in sp[g].items():
                    row = dict(sorted(row.items(), key=lambda x: (-abs(x[1]), x[0]))[:degree])
                    size = math.sqrt(sum(w * w for w in row.values()))
                    sp[g][i] = {j: w / size for j, w in row.items()} if g != "links" and size > 1 else row
        sp["store"][e.episode_id], sp["prev"][e.stream] = address, address
        scores[e.ns, e.seq] = novelty, interference, positive, negative
    edges = {g: {(ns, i, j): w for ns, sp in spaces.items() for i, row in sp[g].items() for j, w in row.items()} for g in ("graph", "temporal", "links")}
    return scores, edges


def edges_of(df):
    return {(r.ns, r.src, r.dst): r.w for r in df.collect()}


@pytest.mark.parametrize(("rule", "cuts"), [("covariance", [12]), ("oja", [1, 2, 3, 7, 12]), ("bcm", [5, 12])])
def test_writes_equal_a_sequential_fold_at_any_batch_size(spark, rule, cuts):
    memory = BoundMemory(BoundSettings(rule=rule, together=3 if rule == "bcm" else 2000, **SMALL))
    rows, at = events(), 0
    for cut in cuts:
        memory.write(spark.createDataFrame(rows[at:cut], EVENT))
        at = cut
    scores, edges = slow_fold(memory, spark.createDataFrame(rows, EVENT), rule)
    for name, want in (("association", edges["graph"]), ("temporal", edges["temporal"]), ("links", edges["links"])):
        got = edges_of(getattr(memory, name))
        assert got.keys() == want.keys() and len(want) > 50
        assert all(got[k] == pytest.approx(w, abs=1e-10) for k, w in want.items())
    for r in memory.episodes.collect():
        assert (r.novelty, r.interference, r.salience, r.negative) == pytest.approx(scores[r.ns, r.seq], abs=1e-10)
    assert memory.episodes.filter("status = 'superseded'").count() >= 1


FIRST = "ns string, episode_id string, seq long, text string, stream string, timestamp string"


def first_events(n):
    return [(("n", "m")[i % 2], f"e{i}", i, f"{TEXTS[i % 6]} {i}", f"s{i % 3}", f"2024-02-{1 + (i * 11) % 28:02d}") for i in range(n)]


@pytest.fixture(scope="module")
def known(spark):
    return Settings(dimension=1024, topk=16, steps=1, max_degree=6)


def test_first_engine_in_one_batch_or_many(spark, known):
    rows = first_events(9)
    whole = Memory(known).write(spark.createDataFrame(rows, FIRST))
    parts = Memory(known)
    for cut in ((0, 4), (4, 5), (5, 9)):
        parts.write(spark.createDataFrame(rows[slice(*cut)], FIRST))
    for name in ("association", "temporal"):
        a, b = edges_of(getattr(whole, name)), edges_of(getattr(parts, name))
        assert a.keys() == b.keys() and all(b[k] == pytest.approx(w, abs=1e-12) for k, w in a.items())
    assert {(r.ns, r.episode_id): r.salience for r in whole.episodes.collect()} == pytest.approx({(r.ns, r.episode_id): r.salience for r in parts.episodes.collect()})


def test_later_writes_keep_feedback_and_replayed_edges(spark, known):
    memory = Memory(known).write(spark.createDataFrame(first_events(6), FIRST))
    asked = spark.createDataFrame([("n", "q", "the kite is green today"), ("m", "q", "a blue boat")], "ns string, query_id string, text string")
    memory.use(memory.ask(asked), F.lit("2024-03-01").cast("timestamp"), verified=True)
    memory.replay("salience", 2)
    before = {(r.ns, r.episode_id): r.asDict() for r in memory.episodes.collect()}
    edges = edges_of(memory.association)
    clock = {r.ns: r.t for r in memory.clock.collect()}
    assert clock == {"n": 5, "m": 5} and any(r["access_count"] for r in before.values())
    memory.write(spark.createDataFrame([], FIRST))
    assert edges_of(memory.association) == edges
    memory.write(spark.createDataFrame([("n", "new", 50, "entirely other words", "s9", None)], FIRST))
    after = {(r.ns, r.episode_id): r.asDict() for r in memory.episodes.collect()}
    assert all(after[k] == r for k, r in before.items()) and after["n", "new"]["access_count"] == 0
    kept = edges_of(memory.association)
    assert all(kept[k] == w for k, w in edges.items() if k[0] == "m")
    assert {r.ns: r.t for r in memory.clock.collect()} == {"n": 6, "m": 5}
    gone = spark.createDataFrame([("n", "new"), ("n", "e0")], "ns string, episode_id string")
    memory.forget(gone)
    left = {(r.ns, r.episode_id): r.asDict() for r in memory.episodes.collect()}
    assert left == {k: r for k, r in after.items() if k[1] not in ("new", "e0")}


def test_forgetting_equals_a_fold_in_time_order(spark, known):
    rows = first_events(8)
    memory = Memory(known).write(spark.createDataFrame(rows, FIRST))
    memory.forget(spark.createDataFrame([("n", "e2"), ("m", "e5")], "ns string, episode_id string"))
    stored = {(r.ns, r.episode_id): r for r in memory.episodes.collect()}
    # the same episodes, written in order of time with the salience they had
    again = Memory(known)
    ordered = sorted(stored.values(), key=lambda r: (r.ns, r.timestamp, r.episode_id))
    codes = memory.codes
    seqs = spark.createDataFrame([(r.ns, r.episode_id, k, r.stream, r.salience) for k, r in enumerate(ordered)], "ns string, episode_id string, seq long, stream string, salience double")
    again._learn(codes.drop("seq", "stream").join(seqs.drop("salience"), ["ns", "episode_id"]), seqs)
    for name in ("association", "temporal"):
        a, b = edges_of(getattr(memory, name)), edges_of(getattr(again, name))
        assert a.keys() == b.keys() and all(b[k] == pytest.approx(w, abs=1e-12) for k, w in a.items())


def test_second_engine_forgets_without_scoring_anew(spark):
    memory = BoundMemory(BoundSettings(rule="hebb", **SMALL)).write(spark.createDataFrame(events(8), EVENT))
    before = {(r.ns, r.episode_id): r for r in memory.episodes.collect()}
    memory.forget(spark.createDataFrame([("n", "e5")], "ns string, episode_id string"))
    after = {(r.ns, r.episode_id): r for r in memory.episodes.collect()}
    assert after.keys() == before.keys() - {("n", "e5")}
    for k, r in after.items():
        was = before[k]
        assert (r.novelty, r.salience, r.status, r.confidence, r.superseded_by) == (was.novelty, was.salience, was.status, was.confidence, was.superseded_by)
        assert r.index_authority == r.authority
    gone = {r.feature for r in memory.codes.collect()}
    assert all(i in gone and j in gone for _, i, j in edges_of(memory.association))
    memory.write(spark.createDataFrame([("n", "later", 90, "the red kite again", "{}", None, "s0")], EVENT))
    assert memory.episodes.count() == len(after) + 1
    assert json.loads(memory.episodes.filter("episode_id = 'later'").first().metadata) == {}
