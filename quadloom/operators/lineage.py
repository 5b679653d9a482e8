"""The folder that the whole cluster shares, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may go without: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quadloom-", dir="/tmp")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that does not exist yet, in the shared one."""
    return f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df written once as a table in the shared folder and read back; for what is read more than once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, name: str = "rows", max_rows: int = 50_000) -> DataFrame:
    """df written once, to be broadcast if it has max_rows at most; else joins are Spark's choice."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= max_rows else out
