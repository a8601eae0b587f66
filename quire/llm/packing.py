"""Best-fit packing by length patterns and non-negative least squares.

1. Texts become id pieces of at most ``capacity`` tokens (a table on shared
   storage); only documents that are longer are cut, and the first piece takes
   the remainder.
2. The histogram of piece lengths (at most ``capacity`` bins) goes to the
   driver, which enumerates patterns that fill a sequence, fits their repeat
   counts to the histogram by non-negative least squares, rounds down, and packs
   the residual histogram by best fit; best fit alone is taken where it needs
   fewer sequences.  All this depends on the number of bins alone, never on the
   number of documents.
3. Each piece gets a rank among the pieces of its length from partial counts,
   and the rank decides its sequence and place.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import store, tokens
from quire.llm.wordhash import slices

SLICE_BYTES = 1 << 21
PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids binary"


class Plan(NamedTuple):
    """For piece length ``length[i]``: ranks from ``low[i]`` go ``fold[i]`` at a
    time to sequences from ``first[i]``, at ``offset[i]`` onwards."""

    length: np.ndarray
    low: np.ndarray
    fold: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of these sizes (1 or more)."""
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = (sizes - 1) % capacity + 1
    start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
    return doc, piece, start, np.where(piece > 0, capacity, head[doc])


def occurrence(values: np.ndarray) -> np.ndarray:
    """How often each value came before in the array."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first
    return out


def patterns(lengths: np.ndarray, capacity: int, per_length: int = 8) -> list[dict[int, int]]:
    """Patterns of pieces that fill a sequence as well as they can.

    Each starts from one or two lengths and takes the longest that fits, as often
    as it fits, until none does.  Those that leave more than a hundredth of the
    capacity beyond what the fullest leaves are dropped.
    """
    have = np.sort(lengths[lengths < capacity])
    out: dict[tuple, dict[int, int]] = {}

    def add(*some: int) -> None:
        pattern = {s: some.count(s) for s in some}
        room = capacity - sum(some)
        while (k := int(np.searchsorted(have, room, "right")) - 1) >= 0:
            s = int(have[k])
            pattern[s] = pattern.get(s, 0) + room // s
            room %= s
        if sum(pattern.values()) > 1:
            out.setdefault(tuple(sorted(pattern.items())), pattern)

    for a in map(int, have[::-1]):
        add(a)
        fits = have[: np.searchsorted(have, capacity - a, "right")]
        for b in map(int, fits[np.unique(np.linspace(0, len(fits) - 1, per_length).astype(int))] if len(fits) else []):
            add(a, b)
    fill = [sum(s * m for s, m in p.items()) for p in out.values()]
    least = max(fill, default=0) - capacity // 100
    return [p for p, n in zip(out.values(), fill) if n >= least]


def fit(counts: np.ndarray, some: list[dict[int, int]], rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of repeat counts against the histogram.

    Accelerated projected gradient over the sparse pattern matrix.
    """
    col = np.concatenate([np.full(len(p), j) for j, p in enumerate(some)])
    row = np.concatenate([np.fromiter(p.keys(), int) for p in some])
    val = np.concatenate([np.fromiter(p.values(), float) for p in some])
    n = len(some)
    scale = max(1.0, float(counts.max()))
    h = counts / scale
    times = lambda x: np.bincount(row, val * x[col], len(h))
    back = lambda r: np.bincount(col, val * r[row], n)
    v = np.ones(n)
    for _ in range(20):
        v = back(times(v))
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / max(1e-12, 1.05 * float(v @ back(times(v))))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - h))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats) that pack all of a histogram, the longest pieces first."""
    left, used = left.copy(), []
    have = list(map(int, np.flatnonzero(left)))
    while have:
        room, pattern, top = capacity, {}, len(have)
        while (k := bisect_right(have, room, 0, top) - 1) >= 0:
            s = have[k]
            if m := min(room // s, int(left[s])) if pattern else 1:
                pattern[s] = pattern.get(s, 0) + m
                room -= m * s
                left[s] -= m
            top = k + 1 if m and left[s] else k
        more = min(int(left[s]) // m for s, m in pattern.items())
        for s, m in pattern.items():
            left[s] -= more * m
            if not left[s]:
                del have[bisect_right(have, s) - 1]
        used.append((pattern, 1 + more))
    return used


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Decide the sequences for a histogram of piece lengths."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        used.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    left_zero, left[0] = int(left[0]), 0
    every, whole = left.copy(), list(used)
    some = patterns(np.flatnonzero(left), capacity)
    if some:
        x = fit(left.astype(float), some)
        for j in np.argsort(-x, kind="stable"):
            times = min([int(x[j] + 1e-9), *(int(left[s]) // m for s, m in some[j].items())])
            if times > 0:
                used.append((some[j], times))
                for s, m in some[j].items():
                    left[s] -= times * m
    used += best_fit(left, capacity)
    alone = whole + best_fit(every, capacity)
    if sum(n for _, n in alone) < sum(n for _, n in used):
        used = alone
    if left_zero:
        used.append(({0: left_zero}, 1))
    seen = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for pattern, times in used:
        at = 0
        for s, m in sorted(pattern.items(), reverse=True):
            rows.append((s, seen[s], m, first, at))
            seen[s] += m * times
            at += s * m
        first += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*(np.ascontiguousarray(c) for c in table.T), first)


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and rank in that length."""
    wide = int(p.low.max(initial=0)) + int(rank.max(initial=0)) + 1
    big = np.array(p.length, dtype=object) * wide + p.low if wide > 1 << 50 else p.length * wide + p.low
    want = length.astype(big.dtype) * wide + rank
    i = np.searchsorted(big, want, "right") - 1
    nth = rank - p.low[i]
    return p.first[i] + nth // p.fold[i], p.offset[i] + nth % p.fold[i] * length


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, on shared storage: see PIECES.

    ``nth`` numbers the pieces of one length within one task; with ``part`` it
    gives each piece its rank without a sort.
    """

    def run(batches):
        enc = tokens.encoder(tokenizer)
        number = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text", SLICE_BYTES):
                ids, sizes = enc.closed(some.column(1), end_id)
                doc, piece, start, length = cut(sizes, capacity)
                nth = seen[length] + occurrence(length)
                seen += np.bincount(length, minlength=len(seen))
                # Pieces follow each other in the ids just as documents do.
                offs = pa.array(4 * np.concatenate([[0], np.cumsum(length)]), pa.int64())
                flat = pa.Array.from_buffers(pa.large_binary(), len(length), [None, offs.buffers()[1], pa.py_buffer(ids)])
                cols = [np.full(len(length), number, np.int32), nth, some.column(0).take(pa.array(doc)), piece.astype(np.int32), start, length, flat.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=["part", "nth", "doc_id", "piece", "start", "length", "ids"])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store.written(lean.mapInArrow(run, PIECES), "pieces")


def assigned(pieces: DataFrame, capacity: int) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; its other columns stay."""
    counts = store.written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    decided = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def put(length, rank):
        import pandas as pd

        s, o = place(decided, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": s, "offset": o})

    # Lengths times tasks grow with the corpus: never a broadcast.
    joined = pieces.join(base.hint("merge"), ["part", "length"])
    return joined.withColumn("at", put("length", F.col("base") + F.col("nth"))).select("*", "at.sequence_id", "at.offset").drop("at", "base", "part", "nth")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian u32).

    A sequence holds at most ``capacity`` tokens, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into as few sequences as the plan finds.

    A null text is empty and takes one sequence slot of its end id.  Repeated
    rows are packed each; a null id stays null; other columns are ignored; an
    empty table gives an empty result.
    """
    return assigned(tokenized(docs, tokenizer, capacity, end_id), capacity)


def packed(docs: DataFrame) -> DataFrame:
    """op10's columns for a table of documents."""
    import public_tokenizers

    pieces = tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)
    lean = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assigned(lean, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: pack all documents."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
