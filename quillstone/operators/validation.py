"""JSON Schema keywords as Columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMATS = {
    "uuid": "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uri": r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$",
}


def _tests(node: dict[str, Any], kind: T.DataType, value: Column, path: str) -> list[tuple[Column, str]]:
    """(violated, message) of a value and all below it that are not in arrays."""
    text = value.cast("string") if not isinstance(kind, T.StructType | T.ArrayType | T.MapType) else None
    found: list[tuple[Column, str]] = []

    def add(bad: Column, keyword: str) -> None:
        found.append((value.isNotNull() & bad, f"{path}: {keyword}"))

    if "enum" in node and text is not None:
        add(~text.isin(*map(str, node["enum"])), "enum")
    if "const" in node and text is not None:
        add(text != str(node["const"]), "const")
    if isinstance(kind, T.StringType):
        if "pattern" in node:
            add(~value.rlike(node["pattern"]), "pattern")
        if node.get("format") in _FORMATS:
            add(~value.rlike(_FORMATS[node["format"]]), f"format {node['format']}")
        for key, test in (("minLength", lambda n: F.length(value) < n), ("maxLength", lambda n: F.length(value) > n)):
            if key in node:
                add(test(node[key]), key)
    if isinstance(kind, T.NumericType):
        for key, test in (
            ("minimum", lambda n: value < n), ("maximum", lambda n: value > n),
            ("exclusiveMinimum", lambda n: value <= n), ("exclusiveMaximum", lambda n: value >= n),
            ("multipleOf", lambda n: value % n != 0),
        ):
            if key in node:
                add(test(node[key]), key)
    if isinstance(kind, T.ArrayType):
        for key, test in (("minItems", lambda n: F.size(value) < n), ("maxItems", lambda n: F.size(value) > n)):
            if key in node:
                add(test(node[key]), key)
        if node.get("uniqueItems"):
            add(F.size(F.array_distinct(value)) < F.size(value), "uniqueItems")
        inner = _tests(node.get("items", {}), kind.elementType, F.lit(None), path) if isinstance(node.get("items"), dict) else []
        for k, (_, message) in enumerate(inner):
            bad = F.exists(value, _violated(node["items"], kind.elementType, path, k))
            found.append((F.coalesce(bad, F.lit(False)), message.replace(path, f"{path}[]", 1)))
    if isinstance(kind, T.StructType):
        for name, child in node.get("properties", {}).items():
            below = f"{path}.{name}" if path else name
            if name in kind.names:
                found += _tests(child, kind[name].dataType, value.getField(name), below)
            if name in node.get("required", ()):
                lacks = value.getField(name).isNull() if name in kind.names else F.lit(True)
                found.append((value.isNotNull() & lacks, f"{below}: required"))
    return found


def _violated(node: dict[str, Any], kind: T.DataType, path: str, k: int) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(_tests(node, kind, x, path)[k][0], F.lit(False))


def violations(df: DataFrame, json_schema: dict[str, Any]) -> Column:
    """Messages (``path: keyword``) of what a row violates in an inlined JSON Schema, as an array; opt-in."""
    tests = _tests(json_schema, df.schema, F.struct(*(F.col(f"`{c}`") for c in df.columns)), "")
    if not tests:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.when(bad, F.lit(message)) for bad, message in tests)), lambda m: m.isNotNull())
