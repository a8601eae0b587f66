"""Token-id files with random access: directly addressable codes (DAC).

Every id is cut into 8-bit chunks.  Level 0 holds the low chunk of each id and
one continuation bit; level k holds chunk k of the ids that continue.  A rank
directory over each bitmap maps a position of level k to its place in level
k + 1, so any id is read by a few array look-ups, without decoding a block.

File format (little-endian), one file per range of documents in ascending
``doc_id`` order::

    "QDAC1\\0\\0\\0"
    segment*            u64 length, then: u64 n_docs, i64 doc_id[n_docs],
                        u8 doc_null[n_docs], u64 doc_tokens[n_docs], DAC
    DAC                 u64 n_levels, then per level: u64 n, u8 chunk[n],
                        and but for the last: bitmap, u32 rank directory

``encode`` writes the files and returns a manifest (file_no, uri, n_docs,
n_tokens).  Only files named by the manifest count, so files left by failed
or repeated attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import store, tokens
from quire.llm.wordhash import slices

MAGIC = b"QDAC1\0\0\0"
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
SLICE_BYTES = 1 << 21
MANIFEST = "file_no int, uri string, n_docs long, n_tokens long"


class Dac:
    """Directly addressable codes of an array of unsigned ids."""

    def __init__(self, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.chunks, self.bitmaps, self.ranks = chunks, bitmaps, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> "Dac":
        chunks, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            chunks.append((rest & np.uint32(255)).astype(np.uint8))
            rest = rest >> np.uint32(8)
            more = rest > 0
            if not more.any():
                return cls(chunks, bitmaps, ranks)
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
            ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint32)
            bitmaps.append(bits)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones[:-1], dtype=np.uint32)]))
            rest = rest[more]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def __getitem__(self, i: int) -> int:
        """One id, by rank look-ups alone."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = int(self.chunks[0][i]), 8
        for k, bits in enumerate(self.bitmaps):
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            upto = bits[block * (RANK_BITS // 8) : (i >> 3) + 1].copy()
            upto[-1] &= (1 << (i & 7)) - 1
            i = int(self.ranks[k][block]) + int(np.bitwise_count(upto).sum())
            value |= int(self.chunks[k + 1][i]) << shift
            shift += 8
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        out = self.chunks[0].astype("<u4")
        where = None
        for k, bits in enumerate(self.bitmaps):
            more = np.flatnonzero(np.unpackbits(bits, count=len(self.chunks[k]), bitorder="little"))
            where = more if where is None else where[more]
            out[where] |= self.chunks[k + 1].astype(np.uint32) << np.uint32(8 * (k + 1))
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<Q", len(self.chunks))]
        for k, chunk in enumerate(self.chunks):
            parts += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
            if k < len(self.bitmaps):
                parts += [self.bitmaps[k].tobytes(), self.ranks[k].astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> "Dac":
        (levels,) = struct.unpack_from("<Q", data, at)
        at += 8
        chunks, bitmaps, ranks = [], [], []
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks.append(np.frombuffer(data, np.uint8, n, at))
            at += n
            if k < levels - 1:
                blocks = -(-n // RANK_BITS)
                bitmaps.append(np.frombuffer(data, np.uint8, blocks * (RANK_BITS // 8), at))
                at += blocks * (RANK_BITS // 8)
                ranks.append(np.frombuffer(data, "<u4", blocks, at))
                at += 4 * blocks
        return cls(chunks, bitmaps, ranks)


def _segment(doc_ids: pa.Array, counts: np.ndarray, flat: np.ndarray) -> bytes:
    body = b"".join(
        [
            struct.pack("<Q", len(doc_ids)),
            np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes(),
            np.asarray(doc_ids.is_null().cast(pa.uint8())).tobytes(),
            counts.astype("<u8").tobytes(),
            Dac.of(flat).to_bytes(),
        ]
    )
    return struct.pack("<Q", len(body)) + body


def read_segments(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Dac]]:
    """(doc ids, null flags, tokens per document, codes) of each segment of a file."""
    data = store.read_file(uri)
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC:
        raise ValueError(f"{uri} is no token file")
    at = 8
    while at < len(view):
        (size,) = struct.unpack_from("<Q", view, at)
        body = view[at + 8 : at + 8 + size]
        (n,) = struct.unpack_from("<Q", body, 0)
        ids = np.frombuffer(body, "<i8", n, 8)
        null = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(bool)
        counts = np.frombuffer(body, "<u8", n, 8 + 9 * n).astype(np.int64)
        yield ids, null, counts, Dac.from_bytes(body, 8 + 17 * n)
        at += 8 + size


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files in ascending id order; return their manifest.

    A null text is empty and holds the end id alone.  A null id comes before all
    others.  Repeated ids stay next to each other, ordered by text.  Other
    columns are ignored; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = store.new_dir(spark, "tokens")

    def write(batches):
        enc = tokens.encoder(tokenizer)
        tally = [0, 0]

        def body():
            held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

            def segment() -> bytes:
                names, counts, flat = zip(*held)
                held.clear()
                return _segment(pa.concat_arrays(names), np.concatenate(counts), np.concatenate(flat))

            yield MAGIC
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    flat, counts = enc.closed(part.column(1), end_id)
                    held.append((part.column(0), counts, flat))
                    tally[0] += len(counts)
                    tally[1] += len(flat)
                    if sum(len(f) for *_, f in held) >= SEGMENT_TOKENS:
                        yield segment()
            if held:
                yield segment()

        number = TaskContext.get().partitionId()
        uri = f"{folder}/{number:06d}-{uuid.uuid4().hex}.qdac"
        store.write_file(uri, body())
        if tally[0]:
            yield pa.RecordBatch.from_pydict(
                {"file_no": pa.array([number], pa.int32()), "uri": [uri], "n_docs": pa.array([tally[0]], pa.int64()), "n_tokens": pa.array([tally[1]], pa.int64())}
            )

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return store.written(ordered.mapInArrow(write, MANIFEST), "manifest")


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: how many ids all earlier files hold.

    One row per file, so the single window task sees file counts only.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids (little-endian u32)."""

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = row["base"]
                for ids, null, counts, codes in read_segments(row["uri"]):
                    flat = codes.decode().tobytes()
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    for a in range(0, len(ids), 2000):
                        s, e = starts[a : a + 2000], ends[a : a + 2000]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids[a : a + 2000], pa.int64(), mask=null[a : a + 2000]),
                                pa.array(at + s),
                                pa.array(e - s),
                                pa.array([flat[4 * x : 4 * y] for x, y in zip(s, e)], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                    at += int(counts.sum())

    files = located(manifest).select("uri", "base")
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """The id at each global ``position``, by random access: position, id.

    Each file opens once; positions outside the store give no row.
    """
    files = located(manifest).withColumn("until", F.col("base") + F.col("n_tokens"))
    hit = positions.select("position").join(files, (F.col("position") >= F.col("base")) & (F.col("position") < F.col("until")))

    def get(key, table):
        uri, base = table.column("uri")[0].as_py(), table.column("base")[0].as_py()
        wanted = np.sort(np.asarray(table.column("position"))) - base
        out, at = [], 0
        for _, _, counts, codes in read_segments(uri):
            n = int(counts.sum())
            out += [(int(p) + base, codes[int(p) - at]) for p in wanted[(wanted >= at) & (wanted < at + n)]]
            at += n
        return pa.table({"position": pa.array([p for p, _ in out], pa.int64()), "id": pa.array([i for _, i in out], pa.int64())})

    return hit.groupBy("uri").applyInArrow(get, "position long, id long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every whole text encoded, written, read back and digested."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read(encode(docs, public_tokenizers.path("byte_bpe_50k.json")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
