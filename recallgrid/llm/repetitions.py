"""Periodic runs of words by the divide and conquer of Main and Lorentz.

A run is a maximal stretch of words with a smallest period q in which words q apart are
equal. Words are interned to numbers; the texts of a portion lie one after the other,
parted by numbers that occur once. Halving the line again and again gives each run a
smallest segment of a power of two that holds it, and the run crosses that segment's
midpoint. As it is at least four periods long, two whole periods lie on one side of the
midpoint: the Z-function of that side, taken from the midpoint outwards, is q or more at
q. Array comparisons discard midpoints where that cannot be; the Z-function decides the
others; what is found is extended to both sides. An interval is kept once, with its
smallest period. Segments are taken from large to small, and a square inside a run that
is known already is not looked at again, so a text of one long run costs no more than
its length times the number of halvings.

Edge cases: a null, empty or blank text has no words and no runs; a null id is kept;
repeated rows are treated each; other columns of the input are ignored; an empty table
gives none. A text of any length is one piece of work of one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, words

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def z_function(s: list[int]) -> list[int]:
    """For each place, how many entries from there on equal those at the start."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _extent(w: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from place i on, in the direction of ``step``, equal those q places after them."""
    done, size = 0, 32
    while True:
        if step > 0:
            a, b = w[i + done : i + done + size], w[i + q + done : i + q + done + size]
            a = a[: len(b)]
        else:
            low = max(0, i - done - size + 1)
            a, b = w[low : i - done + 1][::-1], w[low + q : i - done + q + 1][::-1]
        other = a != b
        if other.any():
            return done + int(other.argmax())
        if len(a) < size:
            return done + len(a)
        done, size = done + size, size * 4


def _survivors(w: np.ndarray, h: int, longest: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(midpoints, periods, on the right side) at which both ends and the middle of a square agree, for segments of 2 h."""
    width = min(h // 2, longest)
    rows = w[: len(w) // (2 * h) * 2 * h].reshape(-1, 2 * h)
    sides = ((rows[:, h + 1 : h + 1 + width] == rows[:, h : h + 1], True), (rows[:, h - 1 - width : h - 1][:, ::-1] == rows[:, h - 1 : h], False))
    out = []
    for equal, right in sides:
        at, q = np.nonzero(equal)
        mid, q = at * (2 * h) + h, q + 1
        for share in (1, 2, 3):  # of the period, as far as the last pair of the square
            k = (q - 1) * share // 3
            here = mid + k if right else mid - 1 - k
            same = w[here] == w[here + q if right else here - q]
            mid, q = mid[same], q[same]
        out.append((mid, q, right))
    return out


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``longest`` bounds a period; ends of texts must be unique numbers."""
    size = 8
    while size < len(ids) + 2:
        size *= 2
    w = np.full(size, -1, np.int64)
    w[: len(ids)] = ids
    w[len(ids) :] = np.iinfo(np.int64).min + np.arange(size - len(ids))
    known: dict[tuple[int, int], int] = {}
    owner = np.full(size, -1, np.int64)
    ends, periods = [], []
    h = size // 2
    while h >= 4:
        for mids, qs, right in _survivors(w, h, longest):
            begin = mids if right else mids - 2 * qs
            if known and len(mids):
                own = owner[begin]
                over = (own >= 0) & (np.array(ends)[own] >= begin + 2 * qs) & (np.array(periods)[own] <= qs)
                mids, qs = mids[~over], qs[~over]
            last, z, found = -1, [], []
            for mid, q in zip(mids.tolist(), qs.tolist(), strict=True):
                if mid != last:
                    last, found = mid, []
                    z = z_function((w[mid : mid + h] if right else w[mid - h : mid][::-1]).tolist())
                if z[q] < q:
                    continue
                at = mid if right else mid - 2 * q
                if any(s <= at and at + 2 * q <= e for s, e in found):
                    continue  # the same interval with a smaller period
                start = at - (_extent(w, at - 1, q, -1) if at else 0)
                end = at + q + _extent(w, at, q, 1)
                if end - start < max(LEAST_WORDS, LEAST_PERIODS * q):
                    continue
                found.append((start, end))
                if known.get((start, end), q + 1) > q:
                    known[start, end] = q
                    owner[start:end] = len(ends)
                    ends.append(end)
                    periods.append(q)
        h //= 2
    return sorted((s, e - s, q) for (s, e), q in known.items())


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact ratio of length to period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def runs_of_texts(texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    """Numbers of words, runs, and texts without what repeats, of many texts at once."""
    split = [t.encode().split() if t else [] for t in texts]  # bytes split at the six ASCII blanks alone
    sizes = [len(s) for s in split]
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    ids = np.empty(sum(sizes) + len(sizes), np.int64)
    at, begins = 0, []
    for k, (s, n) in enumerate(zip(split, sizes, strict=True)):
        begins.append(at)
        ids[at : at + n] = np.fromiter(map(number.__getitem__, s), np.int64, n)
        ids[at + n] = -1 - k
        at += n + 1
    each: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(ids, max(sizes, default=0) // LEAST_PERIODS)
    places = np.searchsorted(begins, [s for s, _, _ in found], side="right") - 1
    for (s, length, q), k in zip(found, places.tolist(), strict=True):
        each[k].append((s - begins[k], length, q))
    kept = []
    for s, runs in zip(split, each, strict=True):
        if runs:
            stay = np.ones(len(s), bool)
            for start, length, q in runs:
                stay[start + q : start + length] = False
            s = compress(s, stay.tolist())
        kept.append(b" ".join(s).decode())
    return sizes, each, kept


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, best, collapsed) of every row; map-only.

    ``runs`` are (start, length, period) by start and period, ``best`` is the run with the
    greatest ratio of length to period, and ``collapsed`` holds the words, joined by one
    space, without those that a run repeats after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            sizes, each, kept = runs_of_texts(batch.column(1).to_pylist())
            as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array([[as_row(r) for r in runs] for runs in each], pa.list_(_RUN)),
                pa.array([as_row(best_run(runs)) for runs in each], _RUN),
                pa.array(kept, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "best", "collapsed"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    one = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<{one}>, best {one}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of one document in ten, chosen by the checksum of its id, made periodic from a word on.

    With h the checksum, g = h div 10 and n words, words from a = g mod n on repeat the
    first 1 + (n - a) div (3 + g mod 8) of them.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words(F.col("text"))))
    sized = chosen.withColumn("_n", F.size("_words").cast("long")).withColumn("_g", F.floor(F.col("_h") / 10))
    sized = sized.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    sized = sized.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    rest = F.col("_n") - F.col("_a")
    piece = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    copies = F.flatten(F.array_repeat(piece, F.ceil(rest / F.col("_p")).cast("int")))
    made = F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), F.slice(copies, F.lit(1), rest.cast("int")))
    return sized.select("doc_id", F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from ``periodic_runs``."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))))
