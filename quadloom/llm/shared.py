"""Intermediate tables in the folder that the whole cluster shares, and joins that broadcast only behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may go without: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quadloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quadloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by stored(); call it only when nothing lazy reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 8 << 20) -> DataFrame:
    """A table made by stored() gets a broadcast hint if its files hold max_bytes (compressed) and max_rows at most; else Spark
    chooses. Neither measure reads the rows: file sizes come from the file system, the count from the files' footers."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if held <= max_bytes and df.count() <= max_rows else df


def measured_side(df: DataFrame, max_rows: int = 500_000, max_bytes: int = 32 << 20) -> DataFrame:
    """A table made by stored() gets a broadcast hint if its rows, not its compressed files, hold max_bytes and max_rows at most;
    else it is merged, so that Spark does not broadcast it for the size of its files either."""
    rows = df.count()
    if rows > max_rows:
        return df.hint("merge")
    plain = sum((F.octet_length(f.name) if f.dataType.simpleString() in ("string", "binary") else F.octet_length(F.to_json(F.struct(f.name))) for f in df.schema), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(plain)).first()[0] or 0) <= max_bytes else df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
