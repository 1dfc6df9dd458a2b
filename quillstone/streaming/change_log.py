"""Change logs as streams: an extension for keeping compacted snapshots up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.changes import CHANGE_LOG, compact_log


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The change log in a folder of Parquet files as a stream."""
    return spark.readStream.schema(CHANGE_LOG).parquet(path)


def compact_stream(log: DataFrame, folder: str) -> StreamingQuery:
    """Write the newest changes of each micro-batch to ``folder/epoch=<n>``; run again, an epoch overwrites itself."""

    def write(rows: DataFrame, epoch: int) -> None:
        compact_log(rows).write.mode("overwrite").parquet(f"{folder}/changes/epoch={epoch}")

    stream = log.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    return stream.trigger(availableNow=True).start()


def compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The newest change of each row over all epochs."""
    return compact_log(spark.read.schema(CHANGE_LOG).parquet(f"{folder}/changes").drop("epoch"))


def change_counts(log: DataFrame, every: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Changes and deletes by schema and window of time, with late rows accepted for a while."""
    timed = log.withColumn("at", F.timestamp_millis("changed_at")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", every).alias("w"), "schema_id")
    return counts.agg(F.count(F.lit(1)).alias("changes"), F.count("deleted_at").alias("deletes")).select("w.start", "w.end", "schema_id", "changes", "deletes")
