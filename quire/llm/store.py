"""Shared storage for intermediate tables and files.

Everything that must outlive a task goes to the folder named by
``spark.checkpoint.dir``, which driver and executors share.  A local session
without that setting (tests, notebooks) gets a temporary folder of its own; a
cluster without it is refused.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI or path of the folder that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quire-")
        found = "file://" + _OWN[app]
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


#: Spark then removes an execution's shuffle files at its end, not when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, never a re-computation.
    With ``tidy``, the shuffle files of the write go once it has ended.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_TIDY)
        elif tidy:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem and path for a URI or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write byte strings to ``uri`` through a temporary name; return the size."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(temp, path)
    return size


def read_file(uri: str) -> pa.Buffer:
    """All bytes of a file."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_buffer()
