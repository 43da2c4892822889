"""The license scan against its SQL where notices stand side by side."""

import itertools

import duckdb
import pytest

from recallgrid.llm import licenses as L


@pytest.mark.parametrize("block", [5000, 12])
def test_adjacent_notices_against_sql(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_SHINGLES", block)
    docs, k = [], 0
    for a, b in itertools.permutations(L.NOTICES.values(), 2):
        for lead in (0, 7, 17):
            docs.append((k, " ".join(f"w{k}x{j}" for j in range(lead)) + f" {a} {b} end"))
            k += 1
    docs.append((k, " ".join(L.NOTICES.values())))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = spark.createDataFrame(list(L.NOTICES.items()), "template_id string, text string")
    got = sorted(map(tuple, L.license_scan(df, names).select("doc_id", "template_id", "containment", "n_windows").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert got == sorted(con.execute(L.OP7_SQL).fetchall())
    assert sum(r[0] == k for r in got) >= len(L.NOTICES)


def test_short_notice_beside_long_template(spark):
    long = " ".join(f"legal{j}" for j in range(400))
    docs = [(k, " ".join(f"a{j}" for j in range(k * 37)) + f" {L.NOTICES['MIT']} {long}") for k in range(12)]
    names = spark.createDataFrame([("MIT", L.NOTICES["MIT"]), ("long", long)], "template_id string, text string")
    got = {(r.doc_id, r.template_id): r.containment for r in L.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), names).collect()}
    assert got == {(k, n): 1.0 for k in range(12) for n in ("MIT", "long")}


@pytest.mark.parametrize("size", [1, 3, 5, 9, 18, 20, 64, 400])
def test_windows_hold_every_copy_and_bands_suffice(size):
    step, blocks, bands = L.window_plan(size, size, L.WIDTH, L.CONTAINED)
    held = -(-size * 4 // 5)
    assert all(start % step + size <= blocks * step for start in range(4 * step))
    assert (1 - held / (size + blocks * step - held)) ** bands <= L.MISS


def test_edited_copies_of_a_long_template(spark):
    """Every copy of at least 0.8 containment is found where words are changed, and none below."""
    words = [f"term{j}" for j in range(90)]
    docs, want = [], {}
    for k in range(24):
        text = list(words)
        for j in range(k % 6):
            text[10 + 15 * j] = f"other{k}x{j}"
        lost = 5 * (k % 6)
        want |= {k: (86 - lost) / 86} if (86 - lost) / 86 >= L.CONTAINED else {}
        docs.append((k, " ".join([f"lead{k}x{j}" for j in range(k * 7)] + text + ["tail"] * k)))
    names = spark.createDataFrame([("long", " ".join(words))], "template_id string, text string")
    got = {r.doc_id: r.containment for r in L.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), names).collect()}
    assert got == want and want
