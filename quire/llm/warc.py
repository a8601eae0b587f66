"""WARC archives with segment reassembly.

Writing: one ``.warc.gz`` file per task, one gzip member per record.  The first
record of a payload is a response; records with an equal payload are revisits
that refer to it and carry none.  The HTTP body is framed in chunks (transfer
coding), and a record block longer than the segment limit is cut into a first
segment and continuation records.

Reading: every file named by the manifest is parsed record by record.  Segments
are grouped by the identifier of their origin record, ordered by segment number,
and their sum is held against the total length that the last one states.  Then
the HTTP message is split and its chunked framing decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import store

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FEED = 16 << 10
LEAST = -(1 << 63)
NAMESPACE = uuid.UUID("6f1c8f6e-30a5-4c3b-9a5e-3f0b6b2f7d10")
DATE = "2024-01-01T00:00:00Z"
RAW = "page_id long, record_id string, type string, origin string, segment int, total long, refers_to string, digest string, block binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha: str, nth: int = 1, part: int = 1) -> str:
    """A record's identifier, the same in every attempt of a task.

    ``sha`` is the digest of the payload; ``nth`` counts the rows of one page and
    payload.
    """
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{sha}/{nth}/{part}')}>"


def chunked(body: bytes, size: int) -> bytes:
    """Chunked transfer framing of a body."""
    parts = []
    for a in range(0, len(body), size):
        some = body[a : a + size]
        parts += [b"%X\r\n" % len(some), some, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked message; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def records(page_id: int | None, url: str | None, payload: bytes, first: int | None, segment: int, chunk: int, nth: int = 1) -> Iterator[bytes]:
    """The gzip members of one page, the ``nth`` row of its id and payload; ``first`` is the page a revisit refers to."""
    sha = digest(payload)
    own = record_id(page_id, sha, nth)
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []
    head += [("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if first is not None:
        yield _record([*head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(None if first == LEAST else first, sha)), ("X-Refers-To-Page", "" if first == LEAST else str(first)), kind], http)
        return
    block = http + chunked(payload, chunk)
    if len(block) <= segment:
        yield _record([*head, kind], block)
        return
    yield _record([*head, ("WARC-Segment-Number", "1"), kind], block[:segment])
    last = -(-len(block) // segment)
    for k in range(2, last + 1):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, sha, nth, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        more += [("WARC-Segment-Total-Length", str(len(block)))] if k == last else []
        yield _record(more, block[(k - 1) * segment : k * segment])


def members(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a ``.warc.gz`` file."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, some = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            some.append(z.decompress(view[at : at + FEED]))
            at = min(len(view), at + FEED) - len(z.unused_data)
        raw = b"".join(some)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        yield headers, rest[: int(headers["content-length"])]


def write(pages: DataFrame, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Write archives of ``page_id, url, html``; return their manifest (uri, n_pages, n_bytes).

    A null html is an empty payload; a null url leaves out the target URI.  Of
    pages with equal payloads the smallest id is the response (a repeated row of
    that id too, with a record of its own).  A null id is an ordinary page whose id sorts first and whose
    revisits refer to no id.  Other columns are ignored; an empty table gives no
    archive.
    """
    folder = store.new_dir(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha"))
    lean = base.select("page_id", "sha")
    firsts = lean.groupBy("sha").agg(F.min(F.coalesce("page_id", F.lit(LEAST))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeats = store.written(lean.join(firsts, "sha").filter("page_id > first").select("page_id", "sha", "first").distinct(), "revisits")
    rows = Window.partitionBy("page_id", "sha").orderBy("url")
    typed = base.join(repeats, ["page_id", "sha"], "left").withColumn("nth", F.row_number().over(rows)).drop("sha")

    def run(batches):
        tally = [0]

        def body():
            for batch in batches:
                for row in batch.to_pylist():
                    tally[0] += 1
                    yield from records(row["page_id"], row["url"], row["html"].encode(), row["first"], segment, chunk, row["nth"])

        uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        size = store.write_file(uri, body())
        if tally[0]:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_pages": pa.array([tally[0]], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return store.written(typed.mapInArrow(run, "uri string, n_pages long, n_bytes long"), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """All records of the archives, segments still apart: see RAW."""
    kinds = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])

    def scan(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for h, block in members(store.read_file(uri)):
                    number = lambda k: int(h[k]) if h.get(k) else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), h["warc-record-id"], h["warc-type"], h.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), h.get("x-refers-to-page") or None, h.get("warc-payload-digest"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(scan, RAW)


def reassembled(records_: DataFrame) -> DataFrame:
    """Whole records: continuations join their origin; broken ones raise an error."""
    whole = records_.filter("segment is null").select("page_id", "type", "refers_to", "digest", "block")
    parts = records_.filter("segment is not null").groupBy(F.coalesce("origin", "record_id").alias("origin")).agg(
        F.max("page_id").alias("page_id"),
        F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    joined = parts.withColumn("block", block)
    fits = (F.octet_length("block") == F.col("total")) & (F.size("parts") == F.element_at("parts", -1)["segment"])
    fault = F.raise_error(F.concat(F.lit("segments are missing of record "), F.col("origin")))
    joined = joined.select("page_id", "type", F.lit(None).cast("string").alias("refers_to"), "digest", F.when(fits, F.col("block")).otherwise(fault.cast("binary")).alias("block"))
    return whole.unionByName(joined)


def read(manifest: DataFrame) -> DataFrame:
    """Pages of the archives: page_id, record_type, refers_to, digest, payload (revisits: null)."""
    whole = reassembled(read_records(manifest))

    @F.pandas_udf("binary")
    def payload(kind, block):
        import pandas as pd

        out = []
        for k, b in zip(kind, block):
            head, _, body = bytes(b).partition(b"\r\n\r\n")
            out.append(None if k == "revisit" else unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
        return pd.Series(out)

    return whole.select("page_id", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"), F.regexp_replace("digest", "^sha1:", "").alias("digest"), payload("type", "block").alias("payload"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: write all pages, read them back; digests are computed from what was read."""
    back = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return digests(back)


def digests(back: DataFrame) -> DataFrame:
    """Length and digest of every page's full payload; a revisit has its response's."""

    @F.pandas_udf("payload_bytes long, own_digest string")
    def measured(payload):
        import pandas as pd

        rows = [(None, None) if p is None else (len(p), digest(bytes(p))) for p in payload]
        return pd.DataFrame(rows, columns=["payload_bytes", "own_digest"]).astype({"payload_bytes": "Int64"})

    lean = store.written(back.withColumn("m", measured("payload")).select("page_id", "record_type", "refers_to", "digest", "m.payload_bytes", "m.own_digest"), "read")
    response = lean.filter("record_type = 'response'").select(F.col("own_digest").alias("digest"), F.col("payload_bytes").alias("n")).distinct()
    own = lean.filter("record_type = 'response'").select("page_id", "payload_bytes", F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    again = lean.filter("record_type = 'revisit'").join(response, "digest")
    return own.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
