"""Cutting lineage where one deep plan feeds many others."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, re-read by every plan on top.

    Uses the shared folder of ``spark.checkpoint.dir``; a local session without one
    (tests) gets a temporary folder of its own, a cluster is refused.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint()
