"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into quantile bins. Boosting goes round and round over
the features (cyclic), each time fitting one shallow tree to a single feature's bins and
adding its leaves to that feature's lookup table. Then the pairs with the strongest
remaining interaction are boosted the same way into two-dimensional tables. A score is
the logistic function of an intercept plus one table entry per feature and pair, so it
is computed by vectorised additions.

The model is fitted on the driver on at most ``max_train`` labelled documents, chosen by
a hash of doc_id among those that are not held out; everything else covers all rows.

Edge cases: null and empty texts get the features of an empty text and a score; labels
that are null are ignored; a document with several labels counts once with the highest,
rows that share a labelled doc_id once with the smallest features (in array order);
without labels of both classes the score is the smoothed share of good labels (0.5
without any); rows with a null doc_id are scored and count as not held out; repeated
rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "punctuation", "symbol", "shout", "pipe", "line_breaks", "non_ascii",
    "distinct_words", "top_word", "repeated_lines", "ended_lines", "wordless", "distinct_bytes", "repeated_pairs", "short_words",
)
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION, _SYMBOL = (np.isin(np.arange(256), list(chars)) for chars in (b".,;:?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~"))


def text_features(text: str) -> list[float]:
    """The values of FEATURES for a whole text."""
    data = text.encode()
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    tokens = data.split()
    lines = [x for x in (line.strip() for line in data.split(b"\n")) if x]
    size = max(1, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    codes = np.fromiter(map(hash, tokens), np.int64, len(tokens))
    often = np.unique(codes, return_counts=True)[1]
    distinct, top = len(often), int(often.max(initial=0))
    pairs = len(tokens) - 1 - len(np.unique(codes[:-1] * 0x2545F4914F6CDD1D + codes[1:])) if tokens else 0
    letters = max(1, int(seen[_LETTER].sum()))
    wordless = sum(1 for w in tokens if not w[0] & 0x80 and not _LETTER[w[0]] and len(w) == 1)
    return [
        float(np.log1p(len(data))), float(np.log1p(len(tokens))), float(lengths.mean()), float(np.log1p(lengths.max())),
        float(seen[_UPPER].sum()) / letters, float(seen[48:58].sum()) / n, float(seen[_PUNCTUATION].sum()) / n, float(seen[_SYMBOL].sum()) / n,
        float(seen[33]) / n, float(seen[124]) / n, float(seen[10]) / size, float(seen[128:].sum()) / n,
        distinct / size, top / size, 1 - len(set(lines)) / max(1, len(lines)), sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        wordless / size, float(np.count_nonzero(seen)), pairs / size, float((lengths <= 2).mean()),
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; ``score`` only bins, looks up and adds."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> bin of the pair tables

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        at = self.bins(x) if self.edges else []
        for t, b in zip(self.tables, at, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _leaf(g: float, h: float, ridge: float) -> float:
    return float(np.clip(g / (h + ridge), -4, 4))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin, from the bins' gradient and curvature sums: greedy best splits."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for lo, hi in parts:
            if hi - lo > 1:
                cut = np.arange(lo + 1, hi)
                lg, lh = cg[cut] - cg[lo], ch[cut] - ch[lo]
                gain = _gain(lg, lh, ridge) + _gain(cg[hi] - cg[cut], ch[hi] - ch[cut], ridge) - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (lo, hi), int(cut[k]))
        if best[1] is None:
            break
        lo, hi = best[1]
        parts.remove((lo, hi))
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = _leaf(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Four leaves of a two-dimensional table, cut once in each direction, and the gain."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    top_g, top_h = cg[1:-1, 1:-1], ch[1:-1, 1:-1]
    right_g, right_h = cg[1:-1, -1:] - top_g, ch[1:-1, -1:] - top_h
    below_g, below_h = cg[-1:, 1:-1] - top_g, ch[-1:, 1:-1] - top_h
    rest_g, rest_h = cg[-1, -1] - top_g - right_g - below_g, ch[-1, -1] - top_h - right_h - below_h
    gain = _gain(top_g, top_h, ridge) + _gain(right_g, right_h, ridge) + _gain(below_g, below_h, ridge) + _gain(rest_g, rest_h, ridge)
    out = np.zeros(g.shape)
    if not gain.size:
        return out, 0.0
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    for rows in (slice(0, a + 1), slice(a + 1, None)):
        for cols in (slice(0, b + 1), slice(b + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum(), ridge)
    return out, float(gain[a, b])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, leaves: int = 3, pairs: int = 8, pair_rounds: int = 40, pair_bins: int = 8, ridge: float = 1.0) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    at = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(at):
            if len(model.tables[j]) > 1:
                g, h = slopes()
                step = rate * shallow_tree(np.bincount(b, g, len(model.tables[j])), np.bincount(b, h, len(model.tables[j])), leaves, ridge)
                model.tables[j] += step
                total += step[b]
    model.coarse = [np.arange(len(t)) * min(pair_bins, len(t)) // len(t) for t in model.tables]
    low = [c[b] for c, b in zip(model.coarse, at, strict=True)]
    width = [int(c[-1]) + 1 for c in model.coarse]
    g, h = slopes()

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(low[i] * width[j] + low[j], v, width[i] * width[j]).reshape(width[i], width[j])

    strength = sorted(((pair_tree(sums(i, j, g), sums(i, j, h), ridge)[1], i, j) for i in range(len(at)) for j in range(i) if width[i] > 1 and width[j] > 1), reverse=True)
    chosen = [(i, j) for _, i, j in strength[:pairs]]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * pair_tree(sums(i, j, g), sums(i, j, h), ridge)[0]
            t += step
            total += step[low[i], low[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Model:
    """A model from at most ``max_train`` labelled rows that are not held out."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = marked.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text_features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # max_train bounds what is broadcast here and, as each doc_id counts once, what comes to the driver.
    rows = _texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    made = rows.mapInArrow(run, "doc_id long, quality int, x array<double>")
    got = made.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, (got["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; one map-only pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 1):
            x = np.array([text_features(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more; texts stay where they are read."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, place):
            x = np.array([text_features(t or "") for t in b.column(place).to_pylist()], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


THRESHOLD = 0.3


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
