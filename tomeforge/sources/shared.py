"""The folder that all executors share, for tables that a run writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, a new one for local runs, and an error elsewhere."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            import tempfile

            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tomeforge-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The rows as Parquet in a new folder of the shared one, read again."""
    frame.write.parquet(path := new_path(frame.sparkSession, "kept"))
    return frame.sparkSession.read.parquet(path)
