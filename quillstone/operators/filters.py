"""Conditions as Columns over nested tables, and as one pass over attribute-value tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.catalog import Attribute, EntitySchema
from quillstone.operators.conditions import Condition, ConditionError, Leaf, leaves_of

_TRUE, _FALSE = {"1", "t", "true"}, {"0", "f", "false"}


@dataclass(frozen=True)
class FilterOptions:
    """`raw_like`: ``%`` and ``_`` in prefixes and substrings are wildcards. `epsilon`: width of equality of numbers."""

    raw_like: bool = False
    epsilon: float | None = None


def parse_time(text: str) -> datetime:
    """RFC 3339, epoch milliseconds, ``YYYY-MM-DD`` or ``YYYY-MM``; without a zone it is UTC."""
    text = text.strip()
    if re.fullmatch(r"-?\d{5,}", text):
        return datetime.fromtimestamp(int(text) / 1000, timezone.utc)
    if re.fullmatch(r"\d{4}-\d{2}", text):
        text += "-01"
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as error:
        raise ConditionError(f"{text!r} is no date") from error
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def parse_literal(attribute: Attribute, text: str) -> Any:
    """The value of a comparison, of the attribute's type."""
    kind = attribute.value_type
    if kind in ("text", "uuid"):
        return text.lower() if kind == "uuid" else text
    if kind in ("date", "datetime"):
        return parse_time(text)
    if kind == "bool":
        if text.lower() in _TRUE | _FALSE:
            return text.lower() in _TRUE
        raise ConditionError(f"{attribute.name}: {text!r} is no truth value")
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            raise ConditionError(f"{attribute.name}: {text!r} is no number") from None


def comparison(attribute: Attribute, leaf: Leaf, options: FilterOptions = FilterOptions()) -> Callable[[Column], Column]:
    """The test of a leaf on one value; checked against the attribute's type when it is built."""
    operator, kind = leaf.operator, attribute.value_type
    if kind == "bool" and operator not in ("equals", "not_equals"):
        raise ConditionError(f"{attribute.name}: {operator} does not apply to truth values")
    if operator in ("starts_with", "contains"):
        if kind != "text":
            raise ConditionError(f"{attribute.name}: {operator} applies to text only")
        if options.raw_like:
            pattern = leaf.value + "%" if operator == "starts_with" else f"%{leaf.value}%"
            return lambda c: c.like(pattern)
        return (lambda c: c.startswith(leaf.value)) if operator == "starts_with" else (lambda c: c.contains(leaf.value))
    if operator in ("in", "not_in"):
        values = [F.lit(parse_literal(attribute, v.strip())) for v in leaf.value.split(",")]
        return (lambda c: c.isin(*values)) if operator == "in" else (lambda c: ~c.isin(*values))
    value = parse_literal(attribute, leaf.value)
    literal = F.lit(value)
    if options.epsilon is not None and operator == "equals" and kind == "numeric":
        return lambda c: F.abs(c - literal) <= options.epsilon
    return {
        "equals": lambda c: c == literal,
        "not_equals": lambda c: c != literal,
        "gt": lambda c: c > literal,
        "gte": lambda c: c >= literal,
        "lt": lambda c: c < literal,
        "lte": lambda c: c <= literal,
    }[operator]


def any_value(kind: T.DataType, value: Column, path: list[str], test: Callable[[Column], Column]) -> Column:
    """Whether a value at `path` passes; through arrays, whether that of any element does."""
    if isinstance(kind, T.ArrayType):
        return F.exists(value, lambda x: any_value(kind.elementType, x, path, test))
    if not path:
        return test(value)
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        raise ConditionError(f"no field {path[0]!r} in the table")
    return any_value(kind[path[0]].dataType, value.getField(path[0]), path[1:], test)


def _fold(condition: Condition, leaf: Callable[[Leaf], Column]) -> Column:
    if isinstance(condition, Leaf):
        return leaf(condition)
    if not condition.children:
        return F.lit(True)
    parts = [_fold(c, leaf) for c in condition.children]
    return reduce((lambda a, b: a & b) if condition.logic == "and" else (lambda a, b: a | b), parts)


def condition_column(df: DataFrame, schema: EntitySchema, condition: Condition | None, options: FilterOptions = FilterOptions()) -> Column:
    """A condition as one Column of a nested table. Two leaves below one array may be met by different elements.

    A comparison with a missing value is unknown, so that the row is left out unless another branch holds.
    """

    def leaf(one: Leaf) -> Column:
        found = schema.attribute(one.attribute)
        head, *rest = found.name.split(".")
        if head not in df.columns:
            raise ConditionError(f"no column {head!r} in the table")
        return any_value(df.schema[head].dataType, F.col(f"`{head}`"), rest, comparison(found, one, options))

    return F.lit(True) if condition is None else _fold(condition, leaf)


def filter_entities(df: DataFrame, schema: EntitySchema, condition: Condition | None, options: FilterOptions = FilterOptions()) -> DataFrame:
    """Rows that meet a condition; filters on plain columns reach the Parquet scan."""
    return df if condition is None else df.where(condition_column(df, schema, condition, options))


def eav_value(attribute: Attribute) -> Column:
    """The value of an attribute-value row, of the attribute's type."""
    number = F.col("value_numeric")
    if not attribute.numeric:
        return F.col("value_text")
    if attribute.value_type == "bool":
        return number > 0.5
    if attribute.value_type in ("date", "datetime"):
        return F.timestamp_millis(number.cast("bigint"))
    return number


def filter_eav(eav: DataFrame, schema: EntitySchema, condition: Condition | None, options: FilterOptions = FilterOptions()) -> DataFrame:
    """Row ids of an attribute-value table that meet a condition: one scan and one aggregation by row, which
    combines map-side, however many comparisons there are. Only attributes that are compared are read on."""
    if condition is None:
        return eav.select("row_id").distinct()
    leaves = list(dict.fromkeys(leaves_of(condition)))
    names = {one: f"leaf_{k}" for k, one in enumerate(leaves)}
    found = {one: schema.attribute(one.attribute) for one in leaves}
    flags = [
        F.bool_or((F.col("attr_id") == found[one].id) & comparison(found[one], one, options)(eav_value(found[one]))).alias(names[one])
        for one in leaves
    ]
    wanted = eav.where(F.col("attr_id").isin(*sorted({a.id for a in found.values()})))
    rows = wanted.groupBy("row_id").agg(*flags) if flags else eav.select("row_id").distinct()
    return rows.where(_fold(condition, lambda one: F.coalesce(F.col(names[one]), F.lit(False)))).select("row_id")


def filter_eav_semi(rows: DataFrame, eav: DataFrame, schema: EntitySchema, condition: Condition, options: FilterOptions = FilterOptions()) -> DataFrame:
    """`rows` whose attribute-value rows meet a condition, by one semi-join: with the rows of a single comparison, which its
    attribute's id and value pick out at the scan, or with what one aggregation leaves of a tree of them."""
    if isinstance(condition, Leaf):
        found = schema.attribute(condition.attribute)
        test = (F.col("attr_id") == found.id) & comparison(found, condition, options)(eav_value(found))
        return rows.join(eav.where(test).select("row_id"), "row_id", "left_semi")
    if not list(leaves_of(condition)):
        return rows
    return rows.join(filter_eav(eav, schema, condition, options), "row_id", "left_semi")


def filter_hot_and_eav(
    df: DataFrame, eav: DataFrame, schema: EntitySchema, hot: Condition | None, rest: Condition, options: FilterOptions = FilterOptions()
) -> DataFrame:
    """Rows of a table with hot columns that meet `hot` on those and `rest` on their attribute-value rows."""
    return filter_eav_semi(filter_entities(df, schema, hot, options), eav, schema, rest, options)
