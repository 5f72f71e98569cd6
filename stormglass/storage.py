"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a temporary folder serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stormglass-")
    return f"{base.rstrip('/')}/{uuid.uuid4()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: its lineage ends there, and Spark knows its size when it plans a join."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder, so that whoever lists the new place finds all of its files or none."""
    source, target = map(spark._jvm.org.apache.hadoop.fs.Path, (old, new))
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"{old} could not be moved to {new}")
