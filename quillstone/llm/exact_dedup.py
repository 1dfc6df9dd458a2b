"""Exact deduplication by stateful streaming.

A stream of digests feeds a keyed state that never expires and lives on disk (RocksDB, with its checkpoint in the
shared folder). For each digest the state retains the stable identifier of the row that stays, a locator of its
content (file and row in the file) and the number of rows seen. Digests that are hit more than once are then checked
on their full bytes, which the locators lead to; a digest that different texts share is split by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BROADCAST_ROWS, few, fresh_name, save, shared_folder

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows for each partition of the state. How many there are is fixed when the state is begun, whatever a later session's
#: shuffle setting; each one is a store of its own with files of some megabytes.
STATE_ROWS = 2_000_000
#: Copies from which a digest is common. Common digests are broadcast, so that their rows stay where they are; there are
#: `BROADCAST_ROWS` of them at most, as each then has one in so many of all rows.
LEAST_COMMON = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id, text, file, row: where Parquet holds each row. Other inputs are written to the shared folder first."""
    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        return save(docs.select(*columns), "content").select("id", "text", *place)


def retain(feed: DataFrame, folder: str) -> DataFrame:
    """Run a streaming `feed` (digest, id, file, row) to its end and return the state's newest rows.

    The result has digest, keep (id, file, row: the largest id) and copies. State and output are in `folder`; a
    second run with the same folder goes on where the first ended. An epoch that is run again overwrites itself.
    """
    state = feed.groupBy("digest").agg(
        F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("copies")
    )
    ledger = f"{folder}/ledger"
    stream = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{ledger}/epoch={epoch}"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    spark = feed.sparkSession
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{ledger}/epoch=-1")
    newest = spark.read.schema(state.schema).parquet(ledger).groupBy("digest")
    return newest.agg(F.max_by("keep", "copies").alias("keep"), F.max("copies").alias("copies"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, digest (binary), file and row (the locator).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays
    (a null id only if there is no other). Rows that repeat an id and a text count in group_size, and of them only
    the one with the last locator stays. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    content = _located(docs, id_col, text_col)
    content.select(digest(F.col("text")).alias("digest"), "id", "file", "row").write.parquet(f"{folder}/feed")
    feed = spark.read.parquet(f"{folder}/feed")

    apart = spark.newSession()  # its settings end with it
    apart.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    count = feed.count()
    stores = max(spark.sparkContext.defaultParallelism, -(-count // STATE_ROWS))
    apart.conf.set("spark.sql.streaming.internal.stateStore.partitions", str(stores))
    apart.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    apart.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    apart.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    retain(apart.readStream.schema(feed.schema).parquet(f"{folder}/feed"), folder).write.parquet(f"{folder}/retained")
    retained = spark.read.parquet(f"{folder}/retained")

    hits = retained.where("copies > 1").select("digest")
    places = save(feed.join(hits, "digest", "left_semi").select("digest", "file", "row"), "hits")
    bytes_of = content.select("id", "text", "file", "row").join(few(places), ["file", "row"])
    differ = save(
        bytes_of.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("digest"),
        "collisions",
    )
    bar = max(LEAST_COMMON, count / BROADCAST_ROWS)
    common, rare = F.broadcast(retained.where(F.col("copies") >= bar)), retained.where(F.col("copies") < bar)
    rows = feed.join(common, "digest").unionByName(feed.join(common, "digest", "left_anti").join(rare, "digest"))
    if not differ.isEmpty():
        shared = save(bytes_of.join(differ, "digest", "left_semi"), "shared")
        split = shared.groupBy("digest", "text").agg(
            F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("copies")
        )
        again = shared.join(split, ["digest", "text"]).select("digest", "id", "file", "row", "keep", "copies")
        rows = rows.join(differ, "digest", "left_anti").unionByName(again)
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return rows.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        kept.alias("kept"),
        "digest",
        "file",
        "row",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns."""
    located = docs
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        located = save(docs, "content")
    gone = exact_duplicates(located, id_col, text_col).where(~F.col("kept"))
    gone = few(save(gone.select(F.col("file").alias("gone_file"), F.col("row").alias("gone_row")), "dropped"))
    file, row = fresh_name(located, "placed_file"), fresh_name(located, "placed_row")
    placed = located.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    here = (placed[file] == gone["gone_file"]) & (placed[row] == gone["gone_row"])
    return placed.join(gone, here, "left_anti").drop(file, row)
