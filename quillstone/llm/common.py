"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast set of ids or locators has at most (some 120 bytes each); above, rows meet by a shuffle.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach. An error if the setting is missing."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/quillstone-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete what this package has left in the shared folder. For when no result of it will be read again."""
    root = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "quillstone-*")) or ():
        files.delete(status.getPath(), True)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(rows: DataFrame) -> DataFrame:
    """`rows` with a broadcast hint if they are proven few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
