"""Creates, deep-merge updates and deletes as versioned tables, with a change log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.catalog import EntitySchema
from quillstone.functions.convert import uuid7
from quillstone.operators.relations import nested, strip_computed

CHANGE_LOG = "schema_id smallint, row_id string, flushed_at bigint, changed_at bigint, deleted_at bigint"


@dataclass(frozen=True)
class Batch:
    """Rows that were accepted, and rejected ones with a code and a message."""

    accepted: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        rows = self.accepted.select(F.lit(True).alias("ok")).union(self.rejected.select(F.lit(False)))
        return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))


def missing_required(df: DataFrame, schema: EntitySchema) -> Column:
    """Names of the required attributes that a row lacks, as an array. Those inside arrays are not checked."""
    tests = []
    for found in sorted(schema.attributes.values(), key=lambda a: a.id):
        inside = any(found.name == a or found.name.startswith(f"{a}.") for a in schema.arrays)
        if found.required and not inside:
            present = found.name.split(".")[0] in df.columns
            tests.append(F.when(nested(df, found.name).isNull() if present else F.lit(True), F.lit(found.name)))
    return F.filter(F.array(*tests), lambda n: n.isNotNull()) if tests else F.array().cast("array<string>")


def create(df: DataFrame, schema: EntitySchema, now: Column | None = None) -> Batch:
    """New rows: computed columns stripped, ids given where there are none, required attributes checked."""
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    rows = strip_computed(df, schema.relations)
    given = F.col("row_id") if "row_id" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumns({"row_id": F.coalesce(given, uuid7(now)), "created_at": now, "updated_at": now, "lacks": missing_required(rows, schema)})
    bad = rows.where(F.size("lacks") > 0)
    message = F.concat(F.lit("missing required: "), F.concat_ws(", ", "lacks"))
    return Batch(
        rows.where(F.size("lacks") == 0).drop("lacks"),
        bad.select("row_id", F.lit("CREATE_FAILED").alias("code"), message.alias("message")),
    )


def merged(kind: T.DataType, old: Column, new: Column, patch: Column, path: str = "$") -> Column:
    """Deep merge of `new`, parsed from the variant `patch`, into `old`: objects merge field by field, arrays and
    scalars are replaced, an explicit null clears, what is absent stays."""
    if isinstance(kind, T.StructType):
        fields = [
            merged(f.dataType, old.getField(f.name), new.getField(f.name), patch, f'{path}["{f.name}"]').alias(f.name) for f in kind.fields
        ]
        if path == "$":
            return F.struct(*fields)
        given = F.try_variant_get(patch, path, "variant")
        return F.when(given.isNull(), old).when(F.is_variant_null(given), F.lit(None)).otherwise(F.struct(*fields))
    return F.when(F.try_variant_get(patch, path, "variant").isNull(), old).otherwise(new)


def _nullable(kind: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    return T.ArrayType(_nullable(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


def update(base: DataFrame, patches: DataFrame, schema: EntitySchema, now: Column | None = None) -> Batch:
    """`base` with patches (row_id, patch as JSON, changed_at) merged in; several patches of a row apply in order.

    A patch of a row that is not there is rejected. One shuffle of patches and one join; created_at stays.
    """
    typed = strip_computed(base, schema.relations)
    names = [f.name for f in schema.spark_type().fields if f.name in typed.columns]
    kind = _nullable(T.StructType([typed.schema[n] for n in names]))
    listed = patches.where("patch IS NOT NULL").groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("changed_at", "patch"))).alias("patches"), F.max("changed_at").alias("changed_at")
    )
    joined = typed.join(listed, "row_id", "left")
    start = F.struct(*(F.col(f"`{n}`") for n in names))

    def step(state: Column, one: Column) -> Column:
        return merged(kind, state, F.from_json(one["patch"], kind), F.try_parse_json(one["patch"])).cast(kind)

    after = F.aggregate("patches", start.cast(kind), step)
    changed = joined.withColumn("after", F.when(F.col("patches").isNull(), start.cast(kind)).otherwise(after))
    stamp = F.coalesce("changed_at", "updated_at") if now is None else F.when(F.col("changed_at").isNull(), F.col("updated_at")).otherwise(now)
    rest = [c for c in typed.columns if c not in names and c != "updated_at"]
    accepted = changed.select(*rest, *(F.col("after").getField(n).alias(n) for n in names), stamp.alias("updated_at"))
    lost = listed.join(typed.select("row_id"), "row_id", "left_anti")
    return Batch(accepted, lost.select("row_id", F.lit("UPDATE_FAILED").alias("code"), F.lit("no such row").alias("message")))


def delete(base: DataFrame, ids: DataFrame) -> Batch:
    """`base` without the rows in `ids` (row_id); ids that are not there are rejected."""
    wanted = ids.select("row_id").distinct()
    lost = wanted.join(base.select("row_id"), "row_id", "left_anti")
    return Batch(
        base.join(wanted, "row_id", "left_anti"),
        lost.select("row_id", F.lit("DELETE_FAILED").alias("code"), F.lit("no such row").alias("message")),
    )


def latest(versions: DataFrame, keys: Sequence[str] = ("row_id",), by: str = "updated_at") -> DataFrame:
    """The newest version of each row, by an aggregation that combines map-side."""
    rest = [c for c in versions.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("newest"))
    return newest.select(*keys, "newest.*")


def snapshot(versions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows that are there: newest versions without those deleted (row_id, deleted_at) at or after their time."""
    gone = tombstones.groupBy("row_id").agg(F.max("deleted_at").alias("deleted_at"))
    kept = latest(versions).join(gone, "row_id", "left")
    return kept.where(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.col("updated_at"))).drop("deleted_at")


def log_changes(rows: DataFrame, schema: EntitySchema, at: Column, deleted: bool = False) -> DataFrame:
    """Change-log rows of created, updated or deleted rows, not flushed yet."""
    gone = at if deleted else F.lit(None).cast("bigint")
    return rows.select(
        F.lit(schema.id).cast("smallint").alias("schema_id"), "row_id", F.lit(0).cast("bigint").alias("flushed_at"),
        at.cast("bigint").alias("changed_at"), gone.cast("bigint").alias("deleted_at"),
    )


def compact_log(*logs: DataFrame) -> DataFrame:
    """One row for each row and flush: the newest change."""
    entries = reduce(DataFrame.unionByName, logs).groupBy("schema_id", "row_id", "flushed_at")
    newest = entries.agg(F.max(F.struct("changed_at", "deleted_at")).alias("c"))
    return newest.select("schema_id", "row_id", "flushed_at", "c.changed_at", "c.deleted_at")
