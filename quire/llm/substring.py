"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ``size - gram + 1`` grams inside every window
of ``size`` words, the one with the least hash.  Equal windows choose the same
anchor, so every repeated window has an anchor that occurs again.  Documents join
on those anchors; each such anchor is extended both ways to the windows that
chose it, and the first place of each window is kept.  Words covered by a window
that also starts earlier make up the maximal repeats that are removed.

Copies of a whole text never extend: all windows of a later copy start earlier
in the first one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import store
from quire.llm.wordhash import Words, mix, slices, windows, words

GRAM = 10
LEAST = -(1 << 63)


def anchors(w: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window, its row, and the start of the gram it chooses."""
    n = len(w.hashes)
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = windows(w.hashes, gram)
    m = n - size + 1
    best, choice = grams[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, size - gram + 1):
        less = grams[k : k + m] < best
        best[less] = grams[k : k + m][less]
        choice[less] = k
    count = np.diff(w.rows)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(m)
    whole = row[start] == row[start + size - 1]
    start = start[whole]
    return start, row[start], start + choice[whole]


def _keyed(docs: DataFrame) -> DataFrame:
    """key: the id, a null id the least long; h, h2: hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("h2"), "text")


def _seeds(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Every anchor: its hash, document, place, and whether the document has it twice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(2), lower=False)
                _, row, at = anchors(w, size, gram)
                new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                row, at = row[new], at[new]
                token = windows(w.hashes, gram)[at] if len(at) else np.zeros(0, np.uint64)
                order = np.lexsort((token, row))
                again = np.zeros(len(at), bool)
                if len(at) > 1:
                    same = (token[order][1:] == token[order][:-1]) & (row[order][1:] == row[order][:-1])
                    again[order[1:][same]] = True
                    again[order[:-1][same]] = True
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array((at - w.rows[row]).astype(np.int32)), pa.array(again)],
                    names=["token", "key", "h", "pos", "own"],
                )

    return docs.select("key", "h", "text").mapInArrow(run, "token long, key long, h long, pos int, own boolean")


def both(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window; windows that agree in one by chance differ in the other."""
    return windows(hashes, size), windows(mix(hashes), size)


def _windows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """Windows around the repeated anchors ``seeds`` of each document: token, check, key, h, pos.

    ``token`` and ``check`` are two hashes of the window's words, compared together.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(2), lower=False)
                start, row, at = anchors(w, size, gram)
                seeds = part.column(3)
                lens = np.diff(np.asarray(seeds.offsets))
                flat = np.asarray(seeds.flatten()) + np.repeat(w.rows[:-1], lens)
                hot = np.zeros(len(w.hashes) + 1, bool)
                hot[flat] = True
                use = hot[at] if len(at) else np.zeros(0, bool)
                start, row = start[use], row[use]
                token, check = (x[start].view(np.int64) for x in both(w.hashes, size)) if len(start) else (np.zeros(0, np.int64),) * 2
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(check), part.column(0).take(take), part.column(1).take(take), pa.array((start - w.rows[row]).astype(np.int32))],
                    names=["token", "check", "key", "h", "pos"],
                )

    return docs.select("key", "h", "text", "seeds").mapInArrow(run, "token long, check long, key long, h long, pos int")


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, size: int = 20, gram: int = GRAM) -> DataFrame:
    """Window starts to remove, by document: key, h, copy, starts.

    ``copy`` marks texts of which a copy has a smaller id (all their windows go).
    Documents without a repeat have no row.
    """
    keyed = _keyed(docs)
    lean = keyed.select("key", "h", "h2")
    firsts = lean.groupBy("h", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    copies = store.written(lean.join(firsts, ["h", "h2"]).filter("key > first").select("key", "h").distinct(), "copies", tidy=True)
    seeds = _seeds(keyed, size, gram)
    often = seeds.groupBy("token").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("own").alias("own")).filter("lo < hi or own").select("token")
    placed = seeds.select("token", "key", "h", "pos").join(often, "token").select("key", "h", "pos").join(copies, ["key", "h"], "left_anti")
    by_doc = store.written(placed.groupBy("key", "h").agg(F.collect_set("pos").alias("seeds")), "anchors", tidy=True)
    spread = store.written(_windows(keyed.join(by_doc, ["key", "h"]), size, gram), "windows", tidy=True)
    first = spread.groupBy("token", "check").agg(F.min(F.struct("key", "pos")).alias("first"), F.max(F.struct("key", "pos")).alias("last")).filter("first < last").select("token", "check", "first")
    again = spread.join(first, ["token", "check"]).filter(F.struct("key", "pos") > F.col("first"))
    starts = again.groupBy("key", "h").agg(F.collect_set("pos").alias("starts")).withColumn("copy", F.lit(False))
    whole = copies.select("key", "h", F.lit(True).alias("copy"), F.array().cast("array<int>").alias("starts"))
    return store.written(starts.unionByName(whole), "repeats", tidy=True)


def remaining(text: str, gone: np.ndarray) -> str:
    """A text without its ``gone`` words; white space within kept runs stays as it is."""
    w = words(pa.array([text]), lower=False)
    keep = np.concatenate([[False], ~gone, [False]])
    first, last = np.flatnonzero(keep[1:] & ~keep[:-1]), np.flatnonzero(keep[:-1] & ~keep[1:]) - 1
    data = w.data.tobytes()
    return b"\n".join([data[w.starts[a] : w.ends[b]] for a, b in zip(first, last)]).decode()


def deduplicated(docs: DataFrame, size: int = 20, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """All columns of ``docs``, plus n_words, n_removed and kept (words joined by a space).

    With ``texts``, the text itself loses the removed words; a text that loses
    none stays as it is, byte for byte.

    A null text has no words.  Null ids count as smaller than all others.  Rows
    with the same id and text are the same place, so neither removes the other.
    Windows never cross documents.  An empty table gives an empty result; the
    names ``n_words, n_removed, kept`` replace columns of these names.
    """
    found = repeats(docs, size, gram)
    base = docs.drop("n_words", "n_removed", "kept")
    rest = [c for c in base.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    packed = base.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.xxhash64(text).alias("h"), "text", F.struct(*rest).alias("row")
    )
    joined = packed.join(found, ["key", "h"], "left").select("text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts", "row")

    @F.pandas_udf("n_words long, n_removed long, kept binary, left string")
    def strip(column, copies, starts):
        import pandas as pd

        out = []
        for text, copy, at in zip(column, copies, starts):
            w = (text or "").encode().split()
            n = len(w)
            gone = np.full(n, copy and n >= size)
            if not copy and at is not None and len(at):
                gone = covered(n, np.asarray(at, np.int64), size)
            kept = [w[i] for i in np.flatnonzero(~gone)] if gone.any() else w
            left = None if not texts else remaining(text, gone) if gone.any() else text
            out.append((n, n - len(kept), b" ".join(kept), left))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "left"])

    done = joined.withColumn("done", strip("text", "copy", "starts"))
    body = F.col("done.left").alias("text") if texts else F.col("text")
    return done.select("row.*", body, "done.n_words", "done.n_removed", F.col("done.kept").cast("string").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: windows of 20 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
