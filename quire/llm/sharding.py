"""Sharding by histogram sort: near-equal bytes per shard, one exchange of texts.

Rows are ordered by (hash of the text, id).  The key space is refined radix by
radix: each round sums the exact bytes of all rows below candidate boundaries,
within the intervals that still hold a wanted splitter, until every splitter
meets the tolerance or cannot be refined.  Equal texts are neighbours in this
order, and a splitter inside a group of them moves to the group's edge where the
tolerance allows; a larger group is split between its ids, so no group, however
hot, unbalances a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import store

STEP = 12
TOLERANCE = 0.002
CELL_BYTES = 64 << 20


def _order(c: Column) -> Column:
    """Flip the sign bit: turns signed order into unsigned order and back."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def _prefix(bits: int) -> Column:
    """The leading ``bits`` of the 128-bit key (h, k), as two longs."""
    high = F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
    low = F.lit(0) if bits <= 64 else F.shiftrightunsigned("k", 128 - bits) if bits < 128 else F.col("k")
    return F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))


def _unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], int]:
    """Boundaries (128-bit keys) between shards, and the total of bytes.

    ``sizes`` has h, k (ordered 64-bit halves of the key) and size.  At most
    ``shards - 1`` intervals of 2**STEP candidates reach the driver in a round.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    # wanted splitter -> (prefix bits, interval start in units of that prefix, bytes below the interval)
    open_, done = {j: (0, 0, 0) for j in range(1, shards)} if total else {}, {}
    bits = 0
    while open_:
        bits = min(128, bits + STEP)
        old = bits - STEP if bits < 128 else (128 - 1) // STEP * STEP
        rows = sizes
        if old:
            held = sorted({start for _, start, _ in open_.values()})
            some = [f"(high = {_signed(s >> max(0, old - 64) if old > 64 else s)} and low = {_signed(s & ((1 << (old - 64)) - 1)) if old > 64 else 0})" for s in held]
            rows = rows.withColumn("at", _prefix(old)).select("*", "at.high", "at.low").filter(" or ".join(some)).drop("at", "high", "low")
        found: dict[int, int] = {}
        for r in rows.groupBy(_prefix(bits).alias("at")).agg(F.sum("size").alias("n")).select("at.high", "at.low", "n").collect():
            high, low = _unsigned(r["high"]), _unsigned(r["low"])
            found[(high << (bits - 64)) | low if bits > 64 else high] = r["n"]
        cells = sorted(found)
        for j, (_, start, below) in list(open_.items()):
            target = j * total / shards
            own = [c for c in cells if c >> (bits - old) == start]
            sum_, pick = below, own[-1]
            for c in own:
                if sum_ + found[c] >= target:
                    pick = c
                    break
                sum_ += found[c]
            before, after = sum_, sum_ + found[pick]
            near, edge = min((target - before, pick), (after - target, pick + 1))
            if near <= allowed or bits == 128:
                done[j] = edge << (128 - bits)
                del open_[j]
            else:
                open_[j] = (bits, pick, before)
    return [done[j] for j in sorted(done)], total


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _at_least(key: int) -> Column:
    """(h, k) >= key, by unsigned order."""
    if key >= 1 << 128:
        return F.lit(False)
    h = F.lit(_signed((key >> 64) ^ (1 << 63)))
    k = F.lit(_signed((key & ((1 << 64) - 1)) ^ (1 << 63)))
    return (_order(F.col("h")) > h) | ((_order(F.col("h")) == h) & (_order(F.col("k")) >= k))


def shard(docs: DataFrame, shards: int, tolerance: float = TOLERANCE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All columns of ``docs`` plus size, shard and slot; columns of these names are replaced.

    Size is the UTF-8 length of the text plus 1 (null text: 1).  A null id comes
    before all others; rows with the same id and text stay together.  An empty
    table gives an empty result.  The texts move once, to cells of about
    ``cell_bytes``; slots follow from the counts of the cells.
    """
    base = docs.drop("size", "shard", "slot")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    h = F.xxhash64(text)
    k = _order(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    keys = store.written(docs.select(h.alias("h"), k.alias("k"), size.alias("size")), "sizes")
    cuts, total = splitters(keys, shards, tolerance)
    number = sum((_at_least(c).cast("int") for c in cuts), F.lit(0))
    cells = max(1, -(-total // (shards * cell_bytes)))
    cell = F.pmod(F.xxhash64("k", "h"), F.lit(cells)).cast("int")
    counts = keys.select(number.alias("shard"), cell.alias("cell")).groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = base.select(F.struct(*base.columns).alias("row"), h.alias("h"), k.alias("k"), size.alias("size"))
    rows = rows.select("row", "size", "h", "k", number.alias("shard"), cell.alias("cell"))
    within = Window.partitionBy("shard", "cell").orderBy(_order(F.col("h")), _order(F.col("k")))
    moved = rows.withColumn("nth", F.row_number().over(within) - 1)
    return moved.join(F.broadcast(bases) if cells * shards <= 100_000 else bases, ["shard", "cell"]).select(
        "row.*", "size", "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents in shards 0 to 7 by bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(docs, 8)
    return out.select(
        "doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
