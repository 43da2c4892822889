"""Numbers of writes by ranges: as by one window a namespace, null namespaces and streams among them."""

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import graph as GR

ROWS = [(None if i % 11 == 0 else "a", None if i % 5 == 0 else i % 2, (i * 37) % 101, f, 0.1 * f + i) for i in range(60) for f in range(3)]
CODES = "ns string, stream long, seq long, feature long, w double"


@pytest.mark.parametrize("made", ["numbers", "previous"])
def test_numbers_by_ranges(spark, monkeypatch, made):
    codes = spark.createDataFrame(ROWS, CODES)
    f = (lambda: GR.with_write_number(codes)) if made == "numbers" else (lambda: GR.previous_write(codes, ["ns", "stream"]))
    rows = lambda df: sorted(df.select(*sorted(df.columns)).collect(), key=str)
    one = rows(f())
    monkeypatch.setattr(GR, "TASK_ENTRIES", 0)
    by_ranges = f()
    assert rows(by_ranges) == one
    # No window over a whole namespace is left: each has the range among its keys, or only sums of ranges below it.
    plan = by_ranges._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "lag(" not in plan
    assert by_ranges.agg(F.count(F.lit(1))).first()[0] == len(one)
