"""Relations: computed properties that are copied from the parent a key points to."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.catalog import EntitySchema, Relation


def nested(df: DataFrame, path: str) -> Column:
    head, *rest = path.split(".")
    value = F.col(f"`{head}`")
    for part in rest:
        value = value.getField(part)
    return value


def with_nested(df: DataFrame, path: str, value: Column) -> DataFrame:
    """`df` with a column or a field of a struct column set."""
    head, *rest = path.split(".")
    if not rest:
        return df.withColumn(head, value)

    def put(kind: T.DataType | None, at: Column, parts: list[str]) -> Column:
        if not parts:
            return value
        fields = {n: at.getField(n) for n in kind.names} if isinstance(kind, T.StructType) else {}
        below = kind[parts[0]].dataType if isinstance(kind, T.StructType) and parts[0] in kind.names else None
        fields[parts[0]] = put(below, fields.get(parts[0], F.lit(None)), parts[1:])
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    kind = df.schema[head].dataType if head in df.columns else None
    return df.withColumn(head, put(kind, F.col(f"`{head}`") if head in df.columns else F.lit(None), rest))


def wanted(relation: Relation, attrs: Sequence[str]) -> bool:
    """Whether a projection asks for what the relation computes; without one, all is asked for."""
    paths = [a.strip() for a in attrs if a.strip()]
    child = relation.child_path
    return not paths or any(p == child or p.startswith(f"{child}.") or child.startswith(f"{p}.") for p in paths)


def enrich(children: DataFrame, parents: DataFrame, relation: Relation, attrs: Sequence[str] = ()) -> DataFrame:
    """`children` with the parent's fragment at the child path, by one left join; unchanged if it isn't asked for.

    Of parents that share a key the one with the largest row id counts. A missing or empty key, parent or fragment
    gives null. Whether parents are broadcast is left to their measured size.
    """
    if not wanted(relation, attrs):
        return children
    fragment = nested(parents, relation.parent_path) if relation.parent_path else F.struct(*(F.col(f"`{c}`") for c in parents.columns))
    keyed = parents.select(nested(parents, relation.parent_key).cast("string").alias("parent_key"), fragment.alias("fragment"), "row_id")
    one = keyed.where(F.col("parent_key").isNotNull() & (F.col("parent_key") != ""))
    one = one.groupBy("parent_key").agg(F.max_by("fragment", "row_id").alias("parent_fragment"))
    joined = children.join(one, nested(children, relation.key).cast("string") == F.col("parent_key"), "left")
    return with_nested(joined, relation.child_path, F.col("parent_fragment")).drop("parent_key", "parent_fragment")


def missing_keys(children: DataFrame, relation: Relation) -> DataFrame:
    """Rows without a key that the relation requires; none if it does not."""
    key = nested(children, relation.key).cast("string")
    return children.where(F.lit(relation.key_required) & (key.isNull() | (key == "")))


def strip_computed(df: DataFrame, relations: Iterable[Relation]) -> DataFrame:
    """`df` without the top-level columns that relations compute."""
    return df.drop(*{r.child_path.split(".")[0] for r in relations})


def enrich_all(children: DataFrame, schema: EntitySchema, parents: dict[str, DataFrame], attrs: Sequence[str] = ()) -> DataFrame:
    """All relations of a schema, from parent tables by name; parents that are not given are left out."""
    for relation in schema.relations:
        if relation.parent in parents:
            children = enrich(children, parents[relation.parent], relation, attrs)
    return children
