"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join are broadcast up to this size.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write a frame to the session's shared folder and read it back."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def light(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised frame of plain columns for broadcast if its measured size fits the limit."""
    texts = [
        F.coalesce(F.sum(F.octet_length(name)), F.lit(0))
        for name, kind in frame.dtypes if kind in ("string", "binary")
    ]
    size = frame.agg((F.count("*") * (32 + 16 * len(frame.columns))).alias("rows"), *texts).first()
    return F.broadcast(frame) if sum(size) <= limit else frame
