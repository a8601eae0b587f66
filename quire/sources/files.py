"""File sources and sinks: inventories, overrides, packages."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import fields, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config

_BOX = "bbox array<double>"
INVENTORY = (
    "body_size double, repeated_furniture array<string>, pages map<string, struct<"
    f"lines: array<struct<text: string, {_BOX.replace(' ', ': ', 1)}, size: double, bold_ratio: double, font: string, color: int>>, "
    "images: array<struct<bbox: array<double>, filename: string, caption: string>>, "
    "tables: array<struct<bbox: array<double>, rows: array<array<string>>>>>>"
)


def inventories(spark: SparkSession, path: str) -> DataFrame:
    """Inventory JSON files, one per document; the id is a hash of the file's name."""
    raw = spark.read.schema(INVENTORY).option("multiLine", True).json(path)
    return raw.select(F.xxhash64(F.col("_metadata.file_name")).alias("doc_id"), F.col("_metadata.file_name").alias("path"), "body_size", "repeated_furniture", F.explode("pages").alias("page", "of")).withColumn("page", F.col("page").cast("int"))


def _box(c: str):
    return [F.element_at(F.col(f"{c}.bbox"), k + 1).alias(s) for k, s in enumerate(("x0", "y0", "x1", "y1"))]


def inventory_lines(pages: DataFrame) -> DataFrame:
    flat = pages.select("doc_id", "page", F.posexplode("of.lines").alias("ord", "l"))
    return flat.select("doc_id", "page", "ord", "l.text", *_box("l"), "l.size", "l.bold_ratio", "l.font", "l.color")


def inventory_regions(pages: DataFrame) -> DataFrame:
    """Tables and images of the inventories; tables carry their rows."""
    t = pages.select("doc_id", "page", F.posexplode("of.tables").alias("ord", "r")).select("doc_id", "page", "ord", F.lit("table").alias("kind"), *_box("r"), "r.rows")
    i = pages.select("doc_id", "page", F.posexplode("of.images").alias("ord", "r")).select("doc_id", "page", (F.col("ord") + 1000).alias("ord"), F.lit("image").alias("kind"), *_box("r"))
    return t.unionByName(i, allowMissingColumns=True)


def inventory_json(lines: DataFrame, regions: DataFrame, keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, json: one inventory document each, pages in order of number."""
    box = F.array("x0", "y0", "x1", "y1").alias("bbox")
    ls = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "text", box, "size", "bold_ratio", "font", "color"))).alias("lines"))
    rs = regions.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", box))).alias("regions"))
    pages = ls.join(rs, ["doc_id", "page"], "full").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "lines", "regions"))).alias("pages"))
    found = keys.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("repeated_furniture"))
    out = pages.join(found, "doc_id", "left").join(sizes, "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("body_size", F.coalesce("repeated_furniture", F.array().cast("array<string>")).alias("repeated_furniture"), "pages")).alias("json"))


def overrides(path: str | None, base: Config = DEFAULT) -> Config:
    """Settings with the overrides of a JSON file; no path, or no such file: as they were.

    ``config`` replaces settings by name, unknown names are left out; the lists
    of patterns, pages, headings and box exclusions add to what is there.
    """
    if not path:
        return base
    fs, name = (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return base
    with fs.open_input_file(name) as f:
        found = json.loads(f.read())
    known = {x.name for x in fields(Config)}
    texts = {k: found[k] for k in ("title", "area", "author") if found.get(k)}
    images = [(int(r["page"]), tuple(float(v) for v in r["bbox"]), r.get("caption", "")) for r in found.get("image_regions", [])]
    out = replace(base, **{k: v for k, v in found.get("config", {}).items() if k in known})
    union = lambda a, b: tuple(dict.fromkeys([*a, *b]))
    return replace(
        out,
        **texts,
        image_regions=union(out.image_regions, images),
        drop_patterns=union(out.drop_patterns, found.get("drop_patterns", [])),
        table_pages=union(out.table_pages, found.get("table_pages", [])),
        skip_pages=union(out.skip_pages, found.get("skip_pages", [])),
        headings=union(out.headings, [(h["page"], h["pattern"], h["level"]) for h in found.get("headings", [])]),
        box_exclusions=union(out.box_exclusions, [(x.get("page"), ("(?i)" if x.get("ignore_case") else "") + x["pattern"]) for x in found.get("question_box_line_exclusions", [])]),
    )


def packages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, epub: package files as they are."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("epub"))


def write_packages(books: DataFrame, folder: str) -> DataFrame:
    """Write ``doc_id, epub`` as files; lazily returns doc_id, uri, n_bytes.

    Files appear under their name only when whole; a repeated attempt replaces
    the file by an equal one.
    """

    def run(batches):
        fs, root = (pafs.LocalFileSystem(), folder.removeprefix("file://")) if "://" not in folder or folder.startswith("file:") else pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = os.path.join(root, f"{doc_id}.epub")
                temp = f"{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(data)
                fs.move(temp, name)
                rows.append((doc_id, name, len(data)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "uri", "n_bytes"])

    return books.select("doc_id", "epub").mapInArrow(run, "doc_id long, uri string, n_bytes long")
