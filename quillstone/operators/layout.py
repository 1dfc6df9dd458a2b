"""Layouts: nested rows, attribute-value rows, and typed hot columns, each from the other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.catalog import Attribute, EntitySchema

#: Columns of the store itself, such as times; attributes bound to them are read-only and never written.
SYSTEM_PREFIX = "sys_"
_LEAF = "struct<array_indices:string,value_text:string,value_numeric:double>"
_ROW = "struct<attr_id:smallint,array_indices:string,value_text:string,value_numeric:double>"


def _stored(attribute: Attribute, value: Column) -> tuple[Column, Column]:
    """Text and number of a value; only one of them is set."""
    kind = attribute.value_type
    if not attribute.numeric:
        text = value.cast("string")
        return (F.lower(text) if kind == "uuid" else text), F.lit(None).cast("double")
    if kind in ("date", "datetime"):
        number = F.unix_millis(value.cast("timestamp")).cast("double")
    elif kind == "bool":
        number = value.cast("int").cast("double")
    else:
        number = value.cast("double")
    return F.lit(None).cast("string"), number


def _leaf_rows(attribute: Attribute, kind: T.DataType, value: Column, path: list[str], places: list[Column]) -> Column:
    """All values below one attribute as an array of (array_indices, value_text, value_numeric)."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x, i: _leaf_rows(attribute, kind.elementType, x, path, [*places, i]))
        return F.coalesce(F.flatten(inner), F.array().cast(f"array<{_LEAF}>"))
    if path:
        below = kind[path[0]].dataType if isinstance(kind, T.StructType) and path[0] in kind.names else None
        if below is None:
            return F.array().cast(f"array<{_LEAF}>")
        return _leaf_rows(attribute, below, value.getField(path[0]), path[1:], places)
    text, number = _stored(attribute, value)
    indices = F.concat_ws(",", *(p.cast("string") for p in places)) if places else F.lit("")
    row = F.struct(indices.alias("array_indices"), text.alias("value_text"), number.alias("value_numeric"))
    return F.when(value.isNotNull(), F.array(row.cast(_LEAF))).otherwise(F.array().cast(f"array<{_LEAF}>"))


def _tagger(attr_id: int) -> Callable[[Column], Column]:
    names = ("array_indices", "value_text", "value_numeric")
    tag = F.lit(attr_id).cast("smallint").alias("attr_id")
    return lambda row: F.struct(tag, *(row[n].alias(n) for n in names))


def to_eav(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """Attribute-value rows of nested rows: schema_id, row_id, attr_id, array_indices, value_text, value_numeric.

    One pass without a shuffle. Nulls, empty arrays and columns that are no attributes leave no row; dates are epoch
    milliseconds, truth values 1 and 0; indices of nested arrays are joined by commas.
    """
    plain, parts = [], []
    for found in sorted(schema.attributes.values(), key=lambda a: a.id):
        head, *rest = found.name.split(".")
        if head not in df.columns:
            continue
        kind, value, path = df.schema[head].dataType, F.col(f"`{head}`"), list(rest)
        while path and isinstance(kind, T.StructType) and path[0] in kind.names:
            kind, value = kind[path[0]].dataType, value.getField(path[0])
            path.pop(0)
        if isinstance(kind, T.ArrayType):
            parts.append(F.transform(_leaf_rows(found, kind, value, path, []), _tagger(found.id)))
        elif not path:
            text, number = _stored(found, value)
            row = F.struct(F.lit(found.id).cast("smallint"), F.lit(""), text, number)
            plain.append(row.cast(_ROW))
    held = F.filter(F.array(*plain).cast(f"array<{_ROW}>"), lambda r: r["value_text"].isNotNull() | r["value_numeric"].isNotNull())
    rows = F.concat(held, *parts) if parts else held
    return df.select(F.lit(schema.id).cast("smallint").alias("schema_id"), "row_id", F.inline(rows))


def _typed(attribute: Attribute, text: Column, number: Column) -> Column:
    kind = attribute.value_type
    if not attribute.numeric:
        return text
    if kind in ("date", "datetime"):
        return F.timestamp_millis(number.cast("bigint"))
    return number > 0.5 if kind == "bool" else number.cast(attribute.spark_type)


def _holds(depth: int, place: Column) -> Callable[[Column], Column]:
    return lambda parts: F.get(parts, F.lit(depth)) == place.cast("string")


def from_eav(eav: DataFrame, schema: EntitySchema, hot: DataFrame | None = None) -> DataFrame:
    """Nested rows of attribute-value rows, by one aggregation a row.

    With `hot` the rows are those of the hot table, joined once, and its columns give the attributes bound to them.

    Arrays follow their numeric indices, and gaps are filled with nulls. Attributes that the schema doesn't have are
    left out. Rows come from attribute-value rows alone: a row without any is not there.
    """
    kind = schema.spark_type()
    maps, gathered = {}, []
    bound = {a.id for a in _hot(schema)} if hot is not None else set()
    for found in schema.attributes.values():
        maps[found.name] = f"attr_{found.id}"
        if found.id in bound:
            continue
        inside = any(found.name == a or found.name.startswith(f"{a}.") for a in schema.arrays)
        value = _typed(found, F.col("value_text"), F.col("value_numeric"))
        here = F.col("attr_id") == found.id
        name = f"attr_{found.id}"
        if inside:
            pair = F.struct(F.col("array_indices").alias("k"), value.alias("v"))
            gathered.append(F.map_from_entries(F.collect_list(F.when(here, pair))).alias(name))
        else:
            gathered.append(F.max(F.when(here, value)).alias(name))

    def length(names: list[str], prefix: list[Column]) -> Column:
        """Elements of an array at some indices, the largest below it plus one."""
        keys = reduce(F.array_union, (F.map_keys(n) for n in names))
        parts = F.transform(keys, lambda k: F.split(k, ","))
        for depth, place in enumerate(prefix):
            parts = F.filter(parts, _holds(depth, place))
        return F.coalesce(F.array_max(F.transform(parts, lambda p: F.get(p, F.lit(len(prefix))).cast("int"))) + 1, F.lit(0))

    def build(at: T.DataType, path: str, prefix: list[Column]) -> Column:
        if isinstance(at, T.ArrayType):
            below = [m for n, m in maps.items() if n == path or n.startswith(f"{path}.")]
            n = length(below, prefix)
            filled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: build_element(at.elementType, path, [*prefix, i]))
            return F.when(n > 0, filled)
        return build_element(at, path, prefix)

    def build_element(at: T.DataType, path: str, prefix: list[Column]) -> Column:
        if isinstance(at, T.StructType):
            fields = [build(f.dataType, f"{path}.{f.name}" if path else f.name, prefix).alias(f.name) for f in at.fields]
            return _or_null(F.struct(*fields), at)
        if prefix:
            key = F.concat_ws(",", *(p.cast("string") for p in prefix))
            return F.try_element_at(F.col(maps[path]), key)
        return F.col(maps[path])

    def _or_null(value: Column, at: T.StructType) -> Column:
        """Null for a struct of which all fields are."""
        empty = reduce(lambda a, b: a & b, (value.getField(n).isNull() for n in at.names))
        return F.when(~empty, value)

    grouped = eav.groupBy("row_id").agg(*gathered) if gathered else eav.select("row_id").distinct()
    if hot is not None:
        decoded = (_typed(a, *_stored(a, decode_hot(a, F.col(a.column)))).alias(f"attr_{a.id}") for a in _hot(schema))
        grouped = hot.select("row_id", *decoded).join(grouped, "row_id", "left")
    return grouped.select("row_id", *(build(f.dataType, f.name, []).alias(f.name) for f in kind.fields))


def eav_json(eav: DataFrame) -> DataFrame:
    """The attribute-value rows of each row as one JSON array, ordered by attribute and indices; nulls are kept."""
    one = F.struct("attr_id", "array_indices", "value_text", "value_numeric")
    rows = F.sort_array(F.collect_list(one))
    return eav.groupBy("row_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("attributes"))


def first_element(eav: DataFrame, attribute: Attribute) -> DataFrame:
    """The sort key of an attribute: the value with the least indices, as text, of each row that has one."""
    value = _typed(attribute, F.col("value_text"), F.col("value_numeric"))
    return eav.where(F.col("attr_id") == attribute.id).groupBy("row_id").agg(F.min_by(value, "array_indices").alias("key"))


def encode_hot(attribute: Attribute, value: Column) -> Column:
    """A value as its hot column stores it."""
    kind = attribute.encoding
    if kind == "unix_ms":
        return F.unix_millis(value.cast("timestamp"))
    if kind == "iso8601":
        return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind == "bool_smallint":
        return value.cast("smallint")
    if kind == "bool_text":
        return F.when(value.isNotNull(), F.when(value, "1").otherwise("0"))
    return value


def decode_hot(attribute: Attribute, value: Column) -> Column:
    """The value of a hot column."""
    kind = attribute.encoding
    if kind == "unix_ms":
        return F.timestamp_millis(value)
    if kind == "iso8601":
        return F.try_to_timestamp(value)
    if kind in ("bool_smallint", "bool_text"):
        return value.cast("int") > 0
    return value.cast(attribute.spark_type)


def _hot(schema: EntitySchema) -> list[Attribute]:
    return [a for a in schema.attributes.values() if a.column and a.name not in schema.arrays and not a.column.startswith(SYSTEM_PREFIX)]


def to_hot(df: DataFrame, schema: EntitySchema) -> DataFrame:
    """schema_id, row_id and the encoded hot columns of nested rows. Arrays are never bound, so that nothing is lost."""
    columns = []
    for found in _hot(schema):
        value = reduce(lambda c, p: c.getField(p), found.name.split(".")[1:], F.col(f"`{found.name.split('.')[0]}`"))
        columns.append(encode_hot(found, value).alias(found.column))
    return df.select(F.lit(schema.id).cast("smallint").alias("schema_id"), "row_id", *columns)


def from_hot(hot: DataFrame, schema: EntitySchema) -> DataFrame:
    """row_id and the decoded hot attributes, nested by their paths."""
    tree: dict = {}
    for found in _hot(schema):
        at = tree
        *above, leaf = found.name.split(".")
        for part in above:
            at = at.setdefault(part, {})
        at[leaf] = decode_hot(found, F.col(found.column))

    def built(node: dict | Column) -> Column:
        return F.struct(*(built(v).alias(k) for k, v in node.items())) if isinstance(node, dict) else node

    return hot.select("row_id", *(built(v).alias(k) for k, v in tree.items()))


def split_record(df: DataFrame, schema: EntitySchema) -> tuple[DataFrame, DataFrame]:
    """Hot columns, and attribute-value rows of all attributes that have none."""
    bound = {a.id for a in _hot(schema)}
    eav = to_eav(df, schema)
    return to_hot(df, schema), eav.where(~F.col("attr_id").isin(*bound)) if bound else eav


def merge_record(hot: DataFrame, eav: DataFrame, schema: EntitySchema) -> DataFrame:
    """Nested rows of both layouts; a row without attribute-value rows stays, with nulls."""
    return from_eav(eav, schema, hot)
