"""Search over several entity types in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.catalog import EntitySchema
from quillstone.operators.conditions import Condition
from quillstone.operators.filters import any_value, filter_entities
from quillstone.operators.paging import Page, parse_names


def has_term(df: DataFrame, schema: EntitySchema, term: str) -> Column:
    """Whether any text attribute of a row contains a term, case-sensitively."""
    tests = []
    for found in schema.attributes.values():
        head, *rest = found.name.split(".")
        if found.value_type == "text" and head in df.columns:
            tests.append(any_value(df.schema[head].dataType, F.col(f"`{head}`"), rest, lambda c: c.contains(term)))
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests)) if tests else F.lit(False), F.lit(False))


def parse_schemas(given: Sequence[str]) -> list[str]:
    """Schema names, each perhaps a comma-separated list; order is kept, repeats go."""
    return list(dict.fromkeys(parse_names(given)))


def search_all(sources: Sequence[tuple[EntitySchema, DataFrame]], condition: Condition | None = None, term: str | None = None) -> DataFrame:
    """Matching rows of all types: schema_ord, schema_name, row_id, attributes (JSON). Without a condition all match."""
    parts = []
    for k, (schema, df) in enumerate(sources):
        found = filter_entities(df, schema, condition)
        found = found.where(has_term(df, schema, term)) if term else found
        body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "row_id")))
        parts.append(found.select(F.lit(k).alias("schema_ord"), F.lit(schema.name).alias("schema_name"), "row_id", body.alias("attributes")))
    return reduce(DataFrame.unionByName, parts)


def search_totals(found: DataFrame) -> DataFrame:
    """Matches by schema."""
    return found.groupBy("schema_name").agg(F.count(F.lit(1)).alias("total"))


def search_page(found: DataFrame, page: Page) -> DataFrame:
    """A page over all types, in the order of the request and then of the row id, across type boundaries."""
    return found.orderBy("schema_ord", "row_id").offset(page.offset).limit(page.size)


@dataclass(frozen=True)
class SearchResult:
    """A page of a search, facts of all of it, and the matches of each type that has some."""

    data: DataFrame
    facts: dict[str, int | bool]
    totals: dict[str, int]


def search_entities(
    sources: Sequence[tuple[EntitySchema, DataFrame]], condition: Condition | None = None, term: str | None = None, page: Page = Page()
) -> SearchResult:
    """Search several types at once: page, facts and totals. What comes to the driver is a count for each type."""
    found = search_all(sources, condition, term)
    totals = {r["schema_name"]: r["total"] for r in search_totals(found).collect()}
    facts = page.facts(sum(totals.values()))
    return SearchResult(search_page(found, page) if page.offset < facts["total_records"] else found.limit(0), facts, totals)
