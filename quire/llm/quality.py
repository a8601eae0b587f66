"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the whole text.  Each feature is cut into bins; cyclic
boosting visits the features in turn and adds a shrunken tree of at most three
leaves to the feature's look-up table.  Then the pairs of features with the
largest gain on what is left get tables of their own, boosted by trees that cut
both features once.  A score is a sum of table entries, found by bin numbers.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, the rows
with the least hash of their id); everything else covers all rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.wordhash import slices, windows, words

SAMPLE = 20_000
BINS = 32
COARSE = 8
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1

# Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 full stop or comma, 6 other ASCII mark, 7 beyond ASCII, 8 control.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[0x21:0x7F] = 6
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord(" ")] = 3
_CLASS[ord("\n")] = 4
_CLASS[[ord("."), ord(",")]] = 5
_CLASS[0x80:] = 7
FEATURES = [
    "lower", "upper", "digit", "space", "line_feed", "stop", "mark", "beyond", "control", "top_mark", "log_bytes", "log_words", "word_bytes", "word_spread",
    "long_words", "short_words", "bare_words", "marked_words", "distinct_words", "top_word", "distinct_pairs", "distinct_fives", "line_words", "distinct_lines", "marked_ends",
]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; a null or empty text has zeros."""
    w = words(column, lower=True)
    n = len(w.rows) - 1
    out = np.zeros((n, len(FEATURES)))
    count = np.diff(w.rows)
    from quire.llm.wordhash import buffers

    data, offs = buffers(column)
    length = w.ends - w.starts
    first, last = data[w.starts] if len(w.starts) else data[:0], data[w.ends - 1] if len(w.ends) else data[:0]
    kind_last = _CLASS[last]
    letters = (_CLASS[first] <= 1) | (_CLASS[first] == 7)
    clean_end = (kind_last <= 1) | (kind_last == 7) | (kind_last == 5)
    pairs, fives = windows(w.hashes, 2), windows(w.hashes, 5)
    feed = np.flatnonzero(data == 10)
    line_cut = np.searchsorted(feed, offs)
    for i in range(n):
        d = data[offs[i] : offs[i + 1]]
        if not len(d):
            continue
        each = np.bincount(d, minlength=256)
        kinds = np.bincount(_CLASS, weights=each, minlength=9)
        out[i, :9] = kinds / len(d)
        out[i, 9] = each[_CLASS == 6].max() / len(d)
        out[i, 10] = np.log1p(len(d))
        a, b = w.rows[i], w.rows[i + 1]
        m = b - a
        if not m:
            continue
        size = length[a:b]
        _, times = np.unique(w.hashes[a:b], return_counts=True)
        out[i, 11] = np.log1p(m)
        out[i, 12], out[i, 13] = size.mean(), size.std()
        out[i, 14], out[i, 15] = (size > 20).mean(), (size < 4).mean()
        out[i, 16], out[i, 17] = letters[a:b].mean(), (kind_last[a:b] == 6).mean()
        out[i, 18], out[i, 19] = len(times) / m, times.max() / m
        out[i, 20] = len(np.unique(pairs[a : b - 1])) / (m - 1) if m > 1 else 1
        out[i, 21] = len(np.unique(fives[a : b - 4])) / (m - 4) if m > 4 else 1
        ends = np.append(feed[line_cut[i] : line_cut[i + 1]], offs[i + 1])
        at = np.searchsorted(w.starts[a:b], ends)
        out[i, 22] = m / len(ends)
        sums = np.concatenate([[0], np.cumsum(w.hashes[a:b], dtype=np.uint64)])[np.concatenate([[0], at])]
        out[i, 23] = len(np.unique(np.diff(sums))) / len(ends)
        out[i, 24] = 1 - clean_end[a:b].mean()
    return out


class Model(NamedTuple):
    """Bin edges and tables; score = sigmoid(base + sum of table entries)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for f, g, table in self.pairs:
            z += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-z))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of a run of bins: gain and place (bins before it)."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        tries = [(*_split(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, k, a, b = max(tries)
        if gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + k), (a + k, b)]
    out = np.empty(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree that cuts both features once: gain and values by cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = []
    quads = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    total = [(a, b) for a, b in zip(quads(cg), quads(ch))]
    if cg.shape[0] < 2 or cg.shape[1] < 2:
        return 0.0, np.zeros(g.shape)
    gain = sum(a**2 / (b + 1) for a, b in total) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for (a, b), rows, cols in zip(total, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = a[i, j] / (b[i, j] + 1)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single tables, then of the tables of the best pairs."""
    n, m = x.shape
    rate = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    if n < 20 or y.min() == y.max():
        return Model(base, [np.zeros(0)] * m, [np.zeros(1)] * m, [np.zeros(0)] * m, [])
    edges, coarse = [_cuts(x[:, f], BINS) for f in range(m)], [_cuts(x[:, f], COARSE) for f in range(m)]
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    wide = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(n, base)
    for _ in range(ROUNDS):
        for f in range(m):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(fine[f], y - p, len(tables[f])), np.bincount(fine[f], p * (1 - p), len(tables[f])))
            tables[f] += step
            z += step[fine[f]]

    def sums(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        cell = wide[f] * shape[1] + wide[g]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    ranked = sorted(((_cross(*sums(f, g, p))[0], f, g) for f in range(m) for g in range(f)), reverse=True)[:PAIRS]
    pairs = [(f, g, np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for _, f, g in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, g, table in pairs:
            p = 1 / (1 + np.exp(-z))
            step = RATE * _cross(*sums(f, g, p))[1]
            table += step
            z += step[wide[f], wide[g]]
    return Model(base, edges, tables, coarse, pairs)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out.

    Several labels of one document count as its largest; null labels and labels
    without a document count for nothing.  With fewer than 20 rows or one class
    only, the model is the share of label 1.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column(2))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], names=["doc_id", "quality", "x"])

    rows = joined.mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(rows["x"].tolist()), rows["quality"].to_numpy(float))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: how likely label 1 is, from 0 to 1.

    Null and empty texts get the score of a text without words.  All other
    columns stay; a column called ``name`` is replaced.
    """

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        return pa.array(np.concatenate([model.score(features(p.column(0))) for p in slices(batch, "text")] or [np.zeros(0)]))

    return docs.withColumn(name, rate("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
