"""Sorting, pages with totals, and projection."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.catalog import EntitySchema
from quillstone.operators.conditions import Condition, ConditionError
from quillstone.operators.filters import FilterOptions, filter_entities
from quillstone.operators.relations import enrich_all
from quillstone.sources.tables import get_entity

DEFAULT_SIZE, LARGEST_SIZE = 50, 100


@dataclass(frozen=True)
class Page:
    """A page of a result, from 1."""

    number: int = 1
    size: int = DEFAULT_SIZE

    @classmethod
    def of(cls, number: int | None, size: int | None, default: int = DEFAULT_SIZE, largest: int = LARGEST_SIZE) -> Page:
        """Numbers below 1 are page 1; sizes below 1 are the default and above the largest that."""
        size = default if not size or size < 1 else min(size, largest)
        return cls(max(number or 1, 1), size)

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size

    def facts(self, total: int) -> dict[str, int | bool]:
        pages = math.ceil(total / self.size)
        return {
            "total_records": total,
            "total_pages": pages,
            "current_page": self.number,
            "items_per_page": self.size,
            "has_next": self.number < pages,
            "has_previous": self.number > 1,
        }


def page_facts(df: DataFrame, page: Page) -> DataFrame:
    """`Page.facts` of all rows of `df` as one row, by an aggregation of its own, so that no window gathers rows in one task."""
    total = F.col("total_records")
    pages = F.ceil(total / page.size).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total_records")).select(
        total, pages.alias("total_pages"), F.lit(page.number).alias("current_page"), F.lit(page.size).alias("items_per_page"),
        (page.number < pages).alias("has_next"), F.lit(page.number > 1).alias("has_previous"),
    )


def parse_names(given: Sequence[str]) -> list[str]:
    """Names, each perhaps a comma-separated list; trimmed, empty ones left out."""
    return [n.strip() for g in given for n in g.split(",") if n.strip()]


def parse_sort(names: Sequence[str], order: str | None) -> tuple[list[str], str]:
    """Sort keys, each perhaps a comma-separated list, and one direction for all."""
    keys = parse_names(names)
    if order and not keys:
        raise ConditionError("a sort order needs sort keys")
    if order not in (None, "", "asc", "desc"):
        raise ConditionError(f"sort order {order!r} is neither asc nor desc")
    return keys, order or "asc"


def first_value(kind: T.DataType, value: Column, path: Sequence[str]) -> Column:
    """The value at a path; of an array that of the first element."""
    if isinstance(kind, T.ArrayType):
        return first_value(kind.elementType, F.get(value, F.lit(0)), path)
    if not path:
        return value
    if not isinstance(kind, T.StructType) or path[0] not in kind.names:
        raise ConditionError(f"no field {path[0]!r} to sort by")
    return first_value(kind[path[0]].dataType, value.getField(path[0]), path[1:])


def sort_order(df: DataFrame, schema: EntitySchema, names: Iterable[str], order: str = "asc") -> list[Column]:
    """Ordering of a nested table: missing values last when ascending and first when descending; ties by row id."""
    keys = []
    for name in names:
        head, *rest = schema.attribute(name).name.split(".")
        key = first_value(df.schema[head].dataType, F.col(f"`{head}`"), rest)
        keys.append(key.desc_nulls_first() if order == "desc" else key.asc_nulls_last())
    return [*keys, F.col("row_id").asc()]


def page_rows(df: DataFrame, order: Sequence[Column], page: Page) -> DataFrame:
    """The rows of a page, by a top-k of offset and size. Its cost grows with the offset; `next_rows` has pages at any depth."""
    return df.orderBy(*order).offset(page.offset).limit(page.size)


def page_with_total(df: DataFrame, order: Sequence[Column], page: Page) -> DataFrame:
    """The rows of a page with the columns total_records and total_pages, in one plan."""
    total = page_facts(df, page).select("total_records", "total_pages")
    return page_rows(df, order, page).crossJoin(F.broadcast(total))  # one row


def project(df: DataFrame, paths: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Columns and fields by dotted path, nested as they were; no path means all.

    A path may be a comma-separated list. Names are trimmed, missing paths are left out, and a path does not lead into arrays. Fields that are not wanted
    are not read from Parquet.
    """
    wanted: dict = {}
    for path in parse_names(paths):
        at = wanted
        for part in filter(None, path.split(".")):
            at = at.setdefault(part, {})
        at["*"] = {}
    if not wanted:
        return df

    def pruned(kind: T.DataType, value: Column, tree: dict) -> Column | None:
        if "*" in tree:
            return value
        if not isinstance(kind, T.StructType):
            return None
        parts = {n: pruned(kind[n].dataType, value.getField(n), tree[n]) for n in kind.names if n in tree}
        fields = [c.alias(n) for n, c in parts.items() if c is not None]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else None

    columns = [F.col(k) for k in keep if k in df.columns]
    for name in df.columns:
        if name in wanted and name not in keep:
            found = pruned(df.schema[name].dataType, F.col(f"`{name}`"), wanted[name])
            columns += [found.alias(name)] if found is not None else []
    return df.select(*columns)


@dataclass(frozen=True)
class QueryResult:
    """A page of entities and what there is around it."""

    data: DataFrame
    facts: dict[str, int | bool]


def query(
    df: DataFrame,
    schema: EntitySchema,
    condition: Condition | None = None,
    sort_by: Sequence[str] = (),
    order: str = "asc",
    page: Page = Page(),
    attrs: Sequence[str] = (),
    options: FilterOptions = FilterOptions(),
) -> QueryResult:
    """Filter, sort, page and project; the total is right on pages past the end too, and nothing is sorted for those."""
    found = filter_entities(df, schema, condition, options)
    total = found.count()
    rows = page_rows(found, sort_order(found, schema, sort_by, order), page) if page.offset < total else found.limit(0)
    return QueryResult(project(rows, attrs), page.facts(total))


class NotFound(LookupError):
    """There is no entity with the id that was asked for."""


def get(df: DataFrame, schema: EntitySchema, row_id: str, parents: dict[str, DataFrame] | None = None, attrs: Sequence[str] = ()) -> DataFrame:
    """The entity with a row id, its relations computed from parent tables by name, and projected. `NotFound` if there is none."""
    found = get_entity(df, row_id)
    if found.isEmpty():
        raise NotFound(f"no {schema.name} with row id {row_id}")
    asked = parse_names(attrs)
    return project(enrich_all(found, schema, parents or {}, asked), asked)


def next_rows(df: DataFrame, schema: EntitySchema, name: str, after: tuple | None, size: int) -> DataFrame:
    """An extension: the `size` rows after a key and row id, in ascending order, without counting from the start."""
    head, *rest = schema.attribute(name).name.split(".")
    key = first_value(df.schema[head].dataType, F.col(f"`{head}`"), rest)
    if after is not None:
        value, row_id = F.lit(after[0]), F.lit(after[1])
        df = df.where((key > value) | ((key == value) & (F.col("row_id") > row_id)) | key.isNull())
    return df.orderBy(key.asc_nulls_last(), "row_id").limit(size)
