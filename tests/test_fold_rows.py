"""Rows of the ordered fold as arrays, against the plain rows of ``graph``; what a fold gives back."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import graph as GR
from recallgrid.operators import ordered as O


@pytest.mark.parametrize(("cap", "negative", "most"), [(True, False, 5), (False, True, 4), (True, False, 1 << 30)])
def test_rows_as_plain_rows(cap, negative, most):
    rng = np.random.default_rng(3)
    rows, plain, left = O.Rows(0.2, 3, most, cap, negative), {}, 1.0
    for t in range(1, 60):
        left *= 0.9 if t % 7 == 0 else 1.0
        src, dst = (rng.choice(90, 8, replace=False).tolist() for _ in range(2))
        deltas = np.round(rng.normal(size=(8, 8)) * 0.3, 1)  # zeros and ties among them
        rows.add(src, dst, deltas, t, left)
        for i, d in zip(src, deltas.tolist(), strict=True):
            row, since, kept = plain.get(i, ({}, t, left))
            row = GR.aged_row(row, GR.decays_between(since, t, 3), 0.2, left / kept)
            plain[i] = GR.settled_row(GR.grown_row(dict(row), i, dst, d, negative), most, cap), t, left
    aged = {i: GR.aged_row(row, GR.decays_between(since, t, 3), 0.2, left / kept) for i, (row, since, kept) in plain.items()}
    asked = [*range(90), 1000]
    assert rows.degrees(asked, t, left).tolist() == pytest.approx([sum(map(abs, aged.get(i, {}).values())) for i in asked])
    assert rows.weights(asked, asked, t, left) == pytest.approx(np.array([[aged.get(i, {}).get(j, 0.0) for j in asked] for i in asked]))
    src, sizes, dst, w = rows.changed(t, left)
    assert dict(zip(src.tolist(), sizes.tolist(), strict=True)) == {i: len(row) for i, row in aged.items()}
    edges = dict(zip(zip(np.repeat(src, sizes).tolist(), dst.tolist(), strict=True), w.tolist(), strict=True))
    assert edges == pytest.approx({(i, j): v for i, row in aged.items() for j, v in row.items()})
    again = O.Rows(0.2, 3, most, cap, negative)
    again.load(np.repeat(src, sizes), dst, w, t)
    assert again.degrees(asked, t, 1.0).tolist() == pytest.approx(rows.degrees(asked, t, left).tolist())


def test_a_fold_gives_a_row_for_each_graph_row():
    """Not one for each edge: that was most of what a write of a memory moved."""
    fold = O.Fold(O.FoldSettings(), pd.DataFrame(columns=["ns", "kind", "a", "b", "s", "v", "u"]))
    gates = {"novelty": None, "redundancy": None, "positive": 0.1, "negative": 0.0, "utility": 0.0, "birth": 0.0}
    for k in range(2):
        fold.write(k, f"e{k}", "s", False, gates, [(40 * k + i, 1.0 + i) for i in range(40)], [(1000, 1.0)], [])
    out = fold.changes().to_pandas()
    assert out["kind"].value_counts().to_dict() == {"score": 2, "address": 2, "association": 80, "temporal": 40, "links": 1, "eligibility": 80, "average": 80, "previous": 40, "clock": 1}
    assert out[out["kind"] == "association"]["to"].map(len).tolist() == [39] * 80
    assert len(out[out["kind"] == "links"]["x"].iloc[0]) == 80


def test_the_graphs_of_many_namespaces_leave_by_their_edges(spark, monkeypatch):
    """One batch of events may end thousands of graphs: their edges are not held together."""
    monkeypatch.setattr(GR, "SENT", 300)
    rows = [(ns, seq, f, 1.0 + f) for ns in range(60) for seq in range(3) for f in range(6 + ns % 3 + seq)]
    codes = spark.createDataFrame(rows, "ns long, seq long, feature long, w double")
    writes = GR.with_write_number(codes).select("ns", "t").distinct()
    caught = []
    monkeypatch.setattr(type(codes), "mapInPandas", lambda self, f, schema: caught.append((f, self.toPandas())) or self)
    GR.event_fold(GR.pair_events(codes, "hebb").withColumn("salience", F.lit(1.0)), writes)
    monkeypatch.undo()
    monkeypatch.setattr(GR, "SENT", 300)
    fold, events = caught[0]
    frames = list(fold(iter([events])))
    assert len(frames) > 5 and max(map(len, frames)) <= 300
    got = {(r.ns, r.src, r.dst): r.w for x in frames for r in x.itertuples()}
    want = {(r.ns, r.src, r.dst): r.w for r in GR.row_fold(GR.pair_deltas(codes, "hebb"), writes).collect()}
    assert sum(map(len, frames)) == len(got) and got == pytest.approx(want)
    monkeypatch.setattr(GR, "SENT", 20)  # less than a graph: it leaves by rows
    few = list(fold(iter([events])))
    assert max(map(len, few)) <= 20 and pd.concat(few).reset_index(drop=True).equals(pd.concat(frames).reset_index(drop=True))
