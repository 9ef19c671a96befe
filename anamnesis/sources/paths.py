"""Where queries keep their own files, and tables that are read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session without one gets a temporary folder, and uses it for checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"file://{tempfile.gettempdir()}/anamnesis-work"
    spark.sparkContext.setCheckpointDir(at)
    return at


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what is read several times is computed once, later plans stay small, and lost
    executors lose nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
