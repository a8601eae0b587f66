"""Embedding near-duplicates by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and quantised; the
values of ``PER_TABLE`` projections make a bucket in each of ``TABLES`` tables.
For cosine 0.93 (distance 0.374) one projection of width 2 agrees with
probability 0.85, a table with 0.2, any of 16 tables with 0.97; the probability
rises with the cosine.  Vectors of one bucket meet in blocks, cosines are exact
double-precision products, and a pair counts in the first table it shares only.
A block returns link counts and one edge per vector, never its pairs.

Equal vectors of one label collapse before hashing, so a vector that a third of
all rows share is hashed once and its copies are counted by weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import graph, store

TABLES = 16
PER_TABLE = 10
WIDTH = 2.0
SEED = 7
BLOCK = 1500
LEAST = -(1 << 63)
_DIRECTIONS: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def directions(dim: int, tables: int, per_table: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections, shifts and code multipliers; the same in every task."""
    key = (dim, tables, per_table, width)
    if key not in _DIRECTIONS:
        rng = np.random.default_rng([SEED, dim])
        a = rng.standard_normal((dim, tables * per_table))
        _DIRECTIONS[key] = a, rng.uniform(0, width, tables * per_table), rng.integers(1, 1 << 62, per_table, dtype=np.int64) | 1
    return _DIRECTIONS[key]


def codes(unit: np.ndarray, tables: int = TABLES, per_table: int = PER_TABLE, width: float = WIDTH) -> np.ndarray:
    """A 64-bit bucket code for each vector and table."""
    a, b, m = directions(unit.shape[1], tables, per_table, width)
    cell = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, per_table)
    with np.errstate(over="ignore"):
        return (cell * m).sum(2, dtype=np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def linked(left: np.ndarray, right: np.ndarray, left_codes: np.ndarray, right_codes: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """Which pairs link and met in no earlier table."""
    hit = left @ right.T >= threshold
    for t in range(table):
        hit &= left_codes[:, t][:, None] != right_codes[:, t][None, :]
    return hit


def roots(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row it reaches."""
    out = np.arange(len(hit))
    open_ = hit.any(1)
    while open_.any():
        start = int(np.argmax(open_))
        reached = np.zeros(len(hit), bool)
        front = np.zeros(len(hit), bool)
        front[start] = True
        while front.any():
            reached |= front
            front = hit[front].any(0) & ~reached
        out[reached] = start
        open_ &= ~reached
    return out


def _hashed(classes: DataFrame, tables: int, per_table: int, width: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.diff(np.asarray(vectors.offsets))
            flat = np.asarray(vectors.flatten(), dtype=float)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                for a in range(0, len(rows), 4096):
                    some = rows[a : a + 4096]
                    v = flat[edge[some][:, None] + np.arange(d)]
                    c = codes(unit(v), tables, per_table, width)
                    offs = pa.array(np.arange(len(some) + 1, dtype=np.int32) * c.shape[1])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(offs, pa.array(c.ravel()))], names=["rep", "codes"])

    return classes.select("rep", "vector").mapInArrow(run, "rep long, codes array<long>")


def _meet(key: tuple[int, ...], ids: np.ndarray, own: np.ndarray, weight: np.ndarray, v: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, weight of its links, one vector that it reaches) of a pair of blocks of a bucket."""
    t, _, i, j = key
    x = np.flatnonzero(own == i)
    y = x if i == j else np.flatnonzero(own == j)
    hit = linked(v[x], v[y], c[x], c[y], t, threshold)
    if i == j:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return ids[:0], ids[:0], ids[:0]
    n = np.zeros(len(ids), np.int64)
    whole = np.zeros((len(ids), len(ids)), bool)
    n[x] = hit @ weight[y]
    whole[np.ix_(x, y)] = hit
    if i != j:
        n[y] = hit.T @ weight[x]
        whole[np.ix_(y, x)] = hit.T
    keep = n > 0
    return ids[keep], n[keep], ids[roots(whole)][keep]


def _meetings(batches, threshold: float):
    """Runs of equal (table, bucket, i, j) in sorted batches; a run may cross batches, its size is bounded."""
    held = None
    names = ["table", "bucket", "i", "j", "own", "rep", "weight", "vector", "codes"]

    def solve(t: pa.Table, last: bool):
        key = np.stack([np.asarray(t.column(c)).astype(np.int64) for c in names[:4]], 1)
        edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        upto = len(edge) - 1 if last else len(edge) - 2
        own, ids, weight = (np.asarray(t.column(c)) for c in names[4:7])
        vectors, code = (t.column(c).combine_chunks() for c in names[7:])
        at, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
        codes_ = np.asarray(code.flatten()).reshape(len(key), -1)
        parts = []
        for a, b in zip(edge[:upto], edge[1 : upto + 1]):
            v = unit(flat[at[a] : at[b]].reshape(b - a, -1))
            parts.append(_meet(tuple(key[a].tolist()), ids[a:b], own[a:b], weight[a:b], v, codes_[a:b], threshold))
        return parts, t.slice(edge[upto])

    def rows(parts):
        rep, n, to = (np.concatenate(p) for p in zip(*parts))
        for k in range(0, len(rep), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(z[k : k + 50_000]) for z in (rep, n, to)], names=["rep", "n", "to"])

    for batch in batches:
        t = pa.Table.from_batches([batch]).select(names)
        t = t if held is None else pa.concat_tables([held, t])
        if t.num_rows:
            parts, held = solve(t, False)
            if parts:
                yield from rows(parts)
    if held is not None and held.num_rows:
        parts, _ = solve(held, True)
        yield from rows(parts)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, per_table: int = PER_TABLE, width: float = WIDTH) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at cosine >= threshold if their labels are equal and not null
    and their dimensions are equal.  Null, empty and zero vectors, and those with
    a null, NaN or infinite component, link with nothing and are kept.  Repeated
    rows are vectors of their own and link with each other; a null id stands for
    the least long and comes back null.  Other columns are ignored; an empty
    table gives an empty result.
    """
    base = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("good", F.coalesce(good, F.lit(False)))
    same = [F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(7), "label", "vector").alias("h2")]
    usable = base.filter("good").select("id", "label", "vector", *same)
    grouped = usable.groupBy("h", "h2").agg(F.min(F.struct("id", "label", "vector")).alias("one"), F.count(F.lit(1)).alias("weight"))
    classes = store.written(grouped.select("h", "h2", "weight", F.col("one.id").alias("rep"), F.col("one.label").alias("label"), F.col("one.vector").alias("vector")), "classes")
    hashed = store.written(_hashed(classes, tables, per_table, width), "codes")
    lean = hashed.join(classes.select("rep", "label", F.size("vector").alias("dim")), "rep").select("rep", "label", "dim", F.posexplode("codes").alias("table", "code"))
    lean = store.written(lean.select("rep", "table", F.xxhash64("label", "dim", "table", "code").alias("bucket")), "buckets")
    shared = lean.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    dealt = lean.join(shared, ["table", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("table", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
    vectors = classes.join(hashed, "rep").select("rep", "weight", "vector", "codes", F.xxhash64("label").alias("group"))
    dealt = dealt.join(vectors, "rep")

    ordered = dealt.repartition("table", "bucket", "i", "j").sortWithinPartitions("table", "bucket", "i", "j")
    found = store.written(ordered.mapInArrow(lambda batches: _meetings(batches, threshold), "rep long, n long, to long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = graph.components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).toDF("rep", "component")
    stats = classes.select("h", "h2", "rep", "weight").join(counts, "rep", "left").join(parts, "rep", "left")
    stats = stats.select("h", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = usable.select("id", "h", "h2").join(stats, ["h", "h2"]).select("id", "n_links", "component")
    out = out.unionByName(base.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    least = F.lit(LEAST)
    return out.select(F.nullif("id", least).alias("vec_id"), "n_links", F.nullif("component", least).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all embeddings, cosine 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
