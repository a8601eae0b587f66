"""Exact n-gram Jaccard join by set-relation skipping.

Documents with equal shingle sets collapse first.  Every distinct set writes a
prefix of its shingles (rare ones first), so that two sets above the threshold
share a prefix shingle.  Relations between sets save the rest of the work:

* index lists are cut into blocks of one set size and one position.  A set that
  walks a list meets whole blocks; where a block's position leaves too few
  shingles for the threshold, all later blocks of that size are skipped, and where
  a size is too large, the rest of the list is (``list_blocks``);
* a parity bitmap of each set bounds the overlap from above, exactly, before any
  pair of sets is read;
* long lists of frequent shingles mark groups of highly similar sets, whose pairs
  are not listed.  Every set is held against the first of its lists; sets that
  this connects never meet again.  The others meet in blocks, where the overlaps of
  a set with all others are derived from those of the most similar set that has
  them already: less what only that set holds, plus what only this one holds
  (``answers``).  Only a spanning forest of the links leaves a block.

Whether a shingle is frequent is decided by a hashed count of fixed size over all
documents.  It changes the order of shingles only, never the answer.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import graph, store
from quire.llm.tokens import spread
from quire.llm.wordhash import mix, shingle_set, slices, words

SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
LONG_LIST = 48
BLOCK_SETS = 1500
BLOCK_SHINGLES = 2_000_000
LANE_SETS = 200
MOST_PAIRS = 1 << 21


class Rule(NamedTuple):
    """Shingles of ``size`` words; linked when 100 * both >= percent * either."""

    size: int
    percent: int

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)


def _u64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batches, size: int):
    """(ids, list of sorted shingle sets) for slices of (doc_id, text) batches."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column(1), lower=True)
            yield part.column(0), [shingle_set(w.hashes[a:b], size) for a, b in zip(w.rows[:-1], w.rows[1:])]


def _sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit sum of each set."""
    with np.errstate(over="ignore"):
        s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        s2 = np.array([mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return np.array([len(s) for s in sets], np.int64), s1, s2


def _lean(docs: DataFrame) -> DataFrame:
    """Key and text; the key is the id, a null id the least long."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "text")


def _summaries(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: set size and a 128-bit sum of the set; per task: shingle counts."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for ids, sets in _sets(batches, rule.size):
            n, s1, s2 = _sums(sets)
            if n.any():
                counts += np.bincount((np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(counts))
            nil = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), _u64(s1), _u64(s2), pa.nulls(len(n), pa.int32()), nil], names=["doc_id", "n", "s1", "s2", "block", "counts"])
        if counts.any():
            packed = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in counts.reshape(-1, SKETCH_BLOCK)]
            nil = pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays([nil, nil, nil, nil, pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "n", "s1", "s2", "block", "counts"])

    return store.written(docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, block int, counts binary"), "sets")


def _frequent(summaries: DataFrame) -> np.ndarray:
    """Bit array of count cells well above the noise; of fixed size (512 KiB)."""

    def add(key, tables):
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for t in tables:
            for c in t.column(t.schema.get_field_index("counts")):
                total += np.frombuffer(zlib.decompress(c.as_py()), "<u4")
        mean = total.mean()
        flags = np.packbits(total > mean + 5 * mean**0.5 + 8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([flags.tobytes()], pa.binary())], names=["block", "flags"])

    rows = summaries.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(_iterating(add), "block int, flags binary").collect()
    out = np.zeros((1 << SKETCH_BITS) // 8, np.uint8)
    for r in rows:
        out[r["block"] * SKETCH_BLOCK // 8 : (r["block"] + 1) * SKETCH_BLOCK // 8] = np.frombuffer(r["flags"], np.uint8)
    return out


def _iterating(f):
    """Annotate ``f`` as a group function over an iterator of batches (bounded memory)."""
    from collections.abc import Iterator

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bitmap with at least as many bits as the set has members."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lower bounds of the symmetric differences of pairs of sets, from their parity bitmaps."""
    out = np.zeros(len(a), np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    for la, lb in np.unique(size, axis=0).tolist():
        rows = np.flatnonzero((size == (la, lb)).all(1))
        x, y = (np.frombuffer(b"".join([z[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1) for z in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def overlap(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of pairs of sets of 64-bit members."""
    pair = np.concatenate([np.repeat(np.arange(len(z)), [len(x) // 8 for x in z]) for z in (a, b)])
    member = np.frombuffer(b"".join([*a, *b]), np.uint64)
    order = np.lexsort((member, pair))
    pair, member = pair[order], member[order]
    both = (pair[1:] == pair[:-1]) & (member[1:] == member[:-1])
    return np.bincount(pair[1:][both], minlength=len(a))


def _prefixes(docs: DataFrame, rule: Rule, frequent: np.ndarray) -> DataFrame:
    """Per document: set size and sum, prefix shingles in order, how many of them are rare, bitmap."""

    def run(batches):
        flags = np.unpackbits(frequent).astype(bool)
        for ids, sets in _sets(batches, rule.size):
            rare, prefix, maps = [], [], []
            for s in sets:
                p = rule.prefix(len(s)) if len(s) else 0
                hot = flags[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                first = s[~hot][:p]
                prefix.append(np.concatenate([first, s[hot][: p - len(first)]]).view(np.int64))
                rare.append(len(first))
                maps.append(parity(s).tobytes() if len(s) else None)
            n, s1, s2 = _sums(sets)
            offs = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(p) for p in prefix], out=offs[1:])
            flat = pa.array(np.concatenate(prefix)) if prefix else pa.array([], pa.int64())
            cols = [ids, pa.array(n), _u64(s1), _u64(s2), pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(offs), flat), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "s1", "s2", "rare", "prefix", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, rare int, prefix array<long>, bits binary")


def list_blocks(n: np.ndarray, pos: np.ndarray, run: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Blocks of index lists sorted by (list, size, position), and the pairs of blocks that meet.

    Returns the blocks' first entries (and the end), the two blocks of each pair,
    and how many blocks were skipped by position.  Entries of a block have one
    size and one position; a later position of the same size leaves fewer
    shingles, so the first block that falls short ends its size.
    """
    change = lambda *cols: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    start = np.flatnonzero(change(run, n, pos)) if len(n) else np.zeros(0, np.int64)
    edge = np.append(start, len(n))
    if not len(start):
        return edge, start, start, 0
    run, n, pos = run[start], n[start], pos[start]
    first = np.append(np.flatnonzero(change(run, n)), len(start))
    next_size = np.repeat(first[1:], np.diff(first))
    live = np.arange(len(start))
    at, left, right, skipped = live.copy(), [], [], 0
    while len(live):
        inside = at < len(start)
        live, at = live[inside], at[inside]
        fits = (run[at] == run[live]) & (rule.percent * n[at] <= 100 * n[live])
        live, at = live[fits], at[fits]
        need = -(-rule.percent * (n[live] + n[at]) // (100 + rule.percent))
        open_ = n[live] - pos[live] >= need  # else no larger set can do either
        live, at, need = live[open_], at[open_], need[open_]
        hit = n[at] - pos[at] >= need
        left.append(live[hit])
        right.append(at[hit])
        skipped += int((next_size[at] - at)[~hit].sum())
        at = np.where(hit, at + 1, next_size[at])
    return edge, np.concatenate(left), np.concatenate(right), skipped


def list_pairs(doc: np.ndarray, n: np.ndarray, pos: np.ndarray, run: np.ndarray, rule: Rule):
    """Candidate pairs (lesser, greater) of index lists sorted by (list, size, position)."""
    edge, left, right, _ = list_blocks(n, pos, run, rule)
    size = np.diff(edge)
    most = size[left] * size[right]
    upto = np.cumsum(most)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MOST_PAIRS, "right")))
        count = most[a:b]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        wide = np.repeat(size[right[a:b]], count)
        x = np.repeat(edge[left[a:b]], count) + within // wide
        y = np.repeat(edge[right[a:b]], count) + within % wide
        keep = (x < y) & (doc[x] != doc[y])
        x, y = doc[x[keep]], doc[y[keep]]
        yield np.minimum(x, y), np.maximum(x, y)
        a = b


def _candidates(prefixes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """From the index lists: pairs to check (a, b), and members of long lists with the first of each (a, b)."""
    entries = prefixes.select("node", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    frequent = entries.filter("pos >= rare").select("token", "n", "pos", "node")
    long_ = store.written(frequent.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).filter(F.col("size") > LONG_LIST), "long")
    hubs = frequent.join(long_, "token").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    lists = entries.filter("pos < rare").select("token", "n", "pos", "node").unionByName(frequent.join(long_, "token", "left_anti"))

    def emit(parts: list[list[np.ndarray]]):
        token, n, pos, doc = (np.concatenate(c) for c in zip(*parts))
        change = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(change)
        many = np.bincount(run)[run] > 1
        for a, b in list_pairs(doc[many], n[many], pos[many], run[many], rule):
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])

    def scan(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [np.asarray(c).astype(np.int64) for c in batch.columns]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if held and (last or held[-1][0][-1] != cols[0][-1]):
                yield from emit([*held, [c[:last] for c in cols]])
                held = []
            elif last:
                yield from emit([[c[:last] for c in cols]])
            held.append([c[last:] for c in cols])
        if held:
            yield from emit(held)

    ordered = lists.repartition("token").sortWithinPartitions("token", "n", "pos", "node")
    return store.written(ordered.mapInArrow(scan, "a long, b long"), "candidates"), store.written(hubs, "hubs")


def _near_enough(pairs: DataFrame, prefixes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose bitmaps leave the threshold within reach."""
    bits = prefixes.select("node", "n", "bits")
    two = pairs.join(bits.toDF("a", "na", "bits_a"), "a").join(bits.toDF("b", "nb", "bits_b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")

    def run(batches):
        for batch in batches:
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            far = apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(rule.linked((na + nb - far) // 2, na, nb)))

    return store.written(two.mapInArrow(run, "a long, b long"), "near")


def _checked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that are linked, by their whole sets."""
    two = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(2))).astype(np.int64) + np.asarray(pc.binary_length(batch.column(3)))
            upto, a = np.cumsum(size), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (4 << 20), "right")))
                some = batch.slice(a, b - a)
                x, y = some.column(2).to_pylist(), some.column(3).to_pylist()
                n, m = (np.array([len(s) // 8 for s in z]) for z in (x, y))
                yield some.select(["a", "b"]).filter(pa.array(rule.linked(overlap(x, y), n, m)))
                a = b

    return two.mapInArrow(run, "a long, b long")


def answers(sets: list[np.ndarray], k: int):
    """(i, overlaps of set i with all sets, the set they were derived from or -1) for the first k sets.

    The next set is always the one that differs least from a set whose overlaps
    are known.  Its overlaps are those, less the counts of what only that set
    holds, plus the counts of what only this one holds; from nothing where it is
    smaller than that difference.
    """
    size = np.array([len(s) for s in sets])
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(place, np.cumsum(size)[:-1])
    order = np.argsort(place, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    many = np.bincount(place, minlength=len(known))
    start = np.cumsum(many) - many
    count = lambda t: np.bincount(owner[spread(start[t], many[t])], minlength=len(sets)).astype(np.int32)
    rows = np.zeros((k, len(sets)), np.int32)
    left = np.ones(k, bool)
    far, base = np.full(k, 1 << 60), np.full(k, -1)
    for _ in range(k):
        i = int(np.argmin(np.where(left, far, 1 << 61)))
        if far[i] < size[i]:
            p = int(base[i])
            gone, new = np.setdiff1d(own[p], own[i], True), np.setdiff1d(own[i], own[p], True)
            rows[i] = rows[p] - count(gone) + count(new)
        else:
            base[i] = -1
            rows[i] = count(own[i])
        left[i] = False
        away = size[:k] + size[i] - 2 * rows[i, :k]
        nearer = left & (away < far)
        far[nearer], base[nearer] = away[nearer], i
        yield i, rows[i], int(base[i])


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, rule: Rule, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (or between two lists of sets).

    Sets already known to be connected, with equal labels in ``joined`` too, need no
    link of their own.
    """
    every = left if right is None else left + right
    size = np.array([len(s) for s in every])
    root = np.arange(len(every))
    if joined is not None:
        _, first, which = np.unique(joined, return_index=True, return_inverse=True)
        root = first[which]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    out = []
    for i, both, _ in answers(every, len(left)):
        hit = np.flatnonzero(rule.linked(both, size[i], size) & (both > 0))
        for j in (hit[hit != i] if right is None else hit[hit >= len(left)]).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(i, j), max(i, j)))
    return out


def _in_blocks(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between sets of one group (component) that no link connects yet (cluster).

    A large cluster has lanes of blocks of its own, which never meet each other;
    all else shares mixed blocks.  Blocks are bounded in sets and in shingles.
    """
    sizes = members.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LANE_SETS).select("component", "cluster", F.col("cluster").alias("lane"))
    dealt = members.join(sizes, ["component", "cluster"], "left").withColumns({"own": F.col("lane").isNotNull(), "lane": F.coalesce("lane", F.lit(0))})
    load = dealt.groupBy("component", "own", "lane").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    block = F.struct("own", "lane", "block")
    blocks = load.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", block.alias("x"))
    meet = blocks.join(blocks.withColumnRenamed("x", "y"), "component").filter("x <= y and not (x.own and y.own and x.lane = y.lane)")
    sides = meet.withColumn("side", F.col("x")).unionByName(meet.filter("x < y").withColumn("side", F.col("y")))
    placed = dealt.join(load, ["component", "own", "lane"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("component", "node", "cluster", block.alias("side")).join(sides, ["component", "side"])
    placed = placed.select("component", "x", "y", (F.col("side") == F.col("x")).alias("left"), (F.col("x") < F.col("y")).alias("cross"), "node", "cluster").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        on_left = np.asarray(table.column("left").to_numpy())
        order = np.argsort(~on_left, kind="stable")
        ids, label = np.asarray(table.column("node"))[order], np.asarray(table.column("cluster"))[order]
        raw = table.column("set").to_pylist()
        got = [np.frombuffer(raw[i], np.uint64) for i in order.tolist()]
        k = int(on_left.sum())
        links = forest(got[:k], got[k:] if table.column("cross")[0].as_py() else None, rule, label)
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in links], pa.int64()), "b": pa.array([int(ids[y]) for _, y in links], pa.int64())})

    return placed.groupBy("component", "x", "y").applyInArrow(run, "a long, b long")


def _classes(own: DataFrame) -> DataFrame:
    """Equal sets: s1, s2, n, rep (least id), rows (of that id), node (the class's key).

    The key is the representative's id, or a hash where an id stands for several sets.
    """
    each = own.filter("n > 0").groupBy("s1", "s2", "n", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    least = each.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "rows")).alias("least")).select("s1", "s2", "n", F.col("least.doc_id").alias("rep"), "least.rows")
    least = store.written(least, "sets_of")
    shared = least.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    node = F.when(F.col("k").isNull(), F.col("rep")).otherwise(F.xxhash64("s1", "s2", "n"))
    return store.written(least.join(shared, "rep", "left").select("s1", "s2", "n", "rep", "rows", node.alias("node")), "classes")


def join(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Exact similarity groups of ``doc_id, text``: doc_id, n_shingles, component_id.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.
    A document with fewer than ``size`` words has its whole sequence as its one
    shingle; without words or with a null text the set is empty and linked with
    nothing.  Every row gives a row, repeated ones too; rows that share an id but
    not a text have the groups of their own texts.  A null id stands for the least
    long and comes back null.  Other columns are ignored; an empty table gives an
    empty result.
    """
    rule = Rule(size, percent)
    lean = _lean(docs)
    summaries = _summaries(lean, rule)
    own = summaries.filter("block is null").select("doc_id", "n", "s1", "s2")
    frequent = _frequent(summaries)
    classes = _classes(own)
    key = ["doc_id", "s1", "s2", "n"]
    reps = classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n", "rows", "node")
    every = store.written(_prefixes(lean, rule, frequent).join(reps, key).select("node", "n", "rows", "rare", "prefix", "bits"), "prefixes")
    prefixes = every.filter("rows = 1").unionByName(every.filter("rows > 1").dropDuplicates(["node"])).drop("rows")
    pairs, hubs = _candidates(prefixes, rule)
    near = _near_enough(pairs.unionByName(hubs).distinct(), prefixes, rule)
    groups = graph.components(hubs)
    wanted = near.select("a").union(near.select("b")).union(groups.select("node")).distinct().toDF("node")
    wanted = store.written(reps.join(wanted, "node").drop("rows"), "needed")

    def shingled(batches):
        for ids, sets in _sets(batches, size):
            n, s1, s2 = _sums(sets)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), _u64(s1), _u64(s2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "s1", "s2", "set"])

    texts = lean.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(shingled, "doc_id long, n long, s1 long, s2 long, set binary").join(wanted, key).dropDuplicates(["node"])
    sets = store.written(sets.select("node", "set"), "wanted")
    links = store.written(_checked(near, sets, rule), "links")
    linked = store.written(graph.components(links), "linked").select("node", F.col("component").alias("cluster"))
    members = store.written(
        groups.join(linked, "node", "left").join(classes.select("node", "n"), "node").select("component", "node", F.coalesce("cluster", "node").alias("cluster"), "n"), "members"
    )
    bridges = _in_blocks(members, sets, rule)
    whose = members.select("node", "cluster")
    bridges = bridges.join(whose.toDF("a", "ca"), "a").join(whose.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    # Clusters that bridges connect are one; a node without links is its own cluster.
    wider = graph.components(bridges).toDF("cluster", "whole")
    group = classes.join(linked, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")).join(wider, "cluster", "left").withColumn("whole", F.coalesce("whole", "cluster"))
    group = store.written(group.select("s1", "s2", "n", "rep", "whole"), "groups")
    least = group.groupBy("whole").agg(F.min("rep").alias("component_id"))
    out = own.filter("n > 0").join(group.join(least, "whole").select("s1", "s2", "n", "component_id"), ["s1", "s2", "n"])
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    null = F.lit(-(1 << 63))
    return out.select(F.nullif("doc_id", null).alias("doc_id"), "n_shingles", F.nullif("component_id", null).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: four-word shingles, 85 percent."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
