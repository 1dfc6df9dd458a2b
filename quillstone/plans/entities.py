"""The driver's tables as entities: schemas, and nested rows with a row id each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import Attribute, EntitySchema, Relation


def _schema(name: str, schema_id: int, *attributes: tuple, arrays: tuple[str, ...] = (), relations: tuple[Relation, ...] = ()) -> EntitySchema:
    found = {a[0]: Attribute(a[0], k + 1, *a[1:]) for k, a in enumerate(attributes)}
    return EntitySchema(name, schema_id, found, frozenset(arrays), relations)


ORDERS = _schema(
    "orders",
    100,
    ("orderkey", "bigint", True, "bigint_01"),
    ("custkey", "bigint", True, "bigint_02"),
    ("status", "text", False, "text_01"),
    ("totalprice", "numeric", False, "double_01"),
    ("orderdate", "date", False, "bigint_03", "unix_ms"),
    ("priority", "text"),
    ("urgent", "bool"),
    relations=(Relation("customer", "customer", "profile", "custkey", "custkey"),),
)
CUSTOMER = _schema(
    "customer", 101, ("custkey", "bigint", True), ("profile.name", "text"), ("profile.segment", "text"), ("acctbal", "numeric"), ("solvent", "bool")
)
SUPPLIER = _schema("supplier", 102, ("suppkey", "bigint", True), ("name", "text"), ("acctbal", "numeric"))
PART = _schema("part", 103, ("partkey", "bigint", True), ("name", "text"), ("brand", "text"), ("type", "text"), ("size", "integer"), ("retailprice", "numeric"))
CONVERSATION = _schema(
    "conversation", 104, ("conv_id", "bigint", True), ("turns.turn", "bigint"), ("turns.role", "text"), ("turns.text", "text"), arrays=("turns",)
)
DOCUMENT = _schema("document", 105, ("doc_id", "bigint", True), ("lang", "text"), ("source", "text"), ("quality", "integer"), ("toxic", "integer"))
EVENT = _schema("event", 106, ("event_id", "bigint", True), ("type", "text"), ("value", "numeric"), ("at", "date", False, "bigint_01", "unix_ms"), ("props.k", "bigint"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_id(name: str, key: str):
    return F.md5(F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))).alias("row_id")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        _row_id("orders", "o_orderkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("totalprice"),
        F.col("o_orderdate").cast("timestamp").alias("orderdate"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderpriority").startswith("1-").alias("urgent"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(
        _row_id("customer", "c_custkey"), F.col("c_custkey").alias("custkey"),
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("profile"),
        F.col("c_acctbal").alias("acctbal"), (F.col("c_acctbal") > 0).alias("solvent"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(
        _row_id("supplier", "s_suppkey"), F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(
        _row_id("part", "p_partkey"), F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    grouped = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns)
    return grouped.select(_row_id("conversation", "conv_id"), "conv_id", "turns")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, which most lack."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    joined = docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select(_row_id("document", "doc_id"), "doc_id", "lang", "source", "quality", "toxic")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    return rows.select(
        _row_id("event", "event_id"), "event_id", F.col("event_type").alias("type"), "value", F.col("ts").cast("timestamp").alias("at"),
        F.from_json("props", "k bigint").alias("props"),
    )
