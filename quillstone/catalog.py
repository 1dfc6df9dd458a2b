"""Entity types: attributes, their Spark types, and how both follow from JSON Schema.

Catalogs are small and live on the driver; data never does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

VALUE_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "uuid": T.StringType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "numeric": T.DoubleType(),
    "date": T.TimestampType(),
    "datetime": T.TimestampType(),
    "bool": T.BooleanType(),
}
ENCODINGS = ("default", "unix_ms", "iso8601", "bool_smallint", "bool_text")
#: First id of a schema that has none.
FIRST_ID = 100


class CatalogError(ValueError):
    """A schema, attribute or reference that cannot be resolved."""


@dataclass(frozen=True)
class Attribute:
    """A leaf of an entity: dotted path, id, value type, and perhaps a column of the hot layout."""

    name: str
    id: int
    value_type: str
    required: bool = False
    column: str | None = None
    encoding: str = "default"

    def __post_init__(self) -> None:
        if self.value_type not in VALUE_TYPES:
            raise CatalogError(f"attribute {self.name}: unknown value type {self.value_type!r}")
        if self.encoding not in ENCODINGS:
            raise CatalogError(f"attribute {self.name}: unknown encoding {self.encoding!r}")

    @property
    def spark_type(self) -> T.DataType:
        return VALUE_TYPES[self.value_type]

    @property
    def numeric(self) -> bool:
        """Whether the attribute-value layout keeps it as a number."""
        return self.value_type not in ("text", "uuid")


@dataclass(frozen=True)
class Relation:
    """A child's computed property that is copied from the parent its key points to."""

    child_path: str
    parent: str
    parent_path: str
    key: str
    parent_key: str = "id"
    key_required: bool = False


@dataclass(frozen=True)
class EntitySchema:
    """An entity type. `arrays` are the dotted paths of arrays, of which a path below is an element's."""

    name: str
    id: int
    attributes: dict[str, Attribute]
    arrays: frozenset[str] = frozenset()
    relations: tuple[Relation, ...] = ()
    json_schema: dict[str, Any] = field(default_factory=dict, compare=False, repr=False)

    def attribute(self, name: str) -> Attribute:
        """By dotted path, or by the hot column that it is bound to."""
        if name in self.attributes:
            return self.attributes[name]
        for found in self.attributes.values():
            if found.column == name:
                return found
        raise CatalogError(f"unknown attribute {name!r} in schema {self.name!r}")

    def by_id(self) -> dict[int, Attribute]:
        return {a.id: a for a in self.attributes.values()}

    def spark_type(self) -> T.StructType:
        """Nested type of an entity, with ids and flags as field metadata."""
        tree: dict[str, Any] = {}
        for name, found in sorted(self.attributes.items()):
            at = tree
            *above, leaf = name.split(".")
            for part in above:
                at = at.setdefault(part, {})
            at[leaf] = found

        def typed(node: Any, path: str) -> T.DataType:
            if isinstance(node, Attribute):
                kind = node.spark_type
            else:
                kind = T.StructType([one(k, v, f"{path}.{k}" if path else k) for k, v in node.items()])
            return T.ArrayType(kind) if path in self.arrays else kind

        def one(name: str, node: Any, path: str) -> T.StructField:
            notes = {"attr_id": node.id, "required": node.required} if isinstance(node, Attribute) else {}
            return T.StructField(name, typed(node, path), True, notes)

        return typed(tree, "")  # type: ignore[return-value]


def schema_type(node: dict[str, Any]) -> str:
    """The type of a JSON Schema node; of several the first that is a string."""
    kind = node.get("type", "")
    return kind if isinstance(kind, str) else next((k for k in kind if isinstance(k, str)), "")


def value_type(node: dict[str, Any]) -> str:
    kind = schema_type(node)
    if kind == "string":
        return "date" if node.get("format") in ("date", "date-time") else "text"
    return {"integer": "numeric", "number": "numeric", "boolean": "bool"}.get(kind, "text")


def pointer(document: Any, path: str) -> Any:
    """What a JSON pointer such as ``/$defs/contact`` leads to."""
    for part in path.strip("/").split("/") if path.strip("/") else []:
        part = part.replace("~1", "/").replace("~0", "~")
        if not isinstance(document, dict) or part not in document:
            raise CatalogError(f"no {path!r} in the document")
        document = document[part]
    return document


def inline(name: str, documents: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """The document `name` with all references replaced, over files; ``x-`` keys and ``$defs`` are dropped."""

    def walk(node: Any, file: str, open_refs: tuple[str, ...]) -> Any:
        if isinstance(node, list):
            return [walk(x, file, open_refs) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            target, _, path = node["$ref"].partition("#")
            target = target or file
            ref = f"{target}#{path}"
            if ref in open_refs:
                raise CatalogError(f"references run in a circle: {' -> '.join((*open_refs, ref))}")
            if target not in documents:
                raise CatalogError(f"{file} refers to {target}, which is not there")
            found = walk(pointer(documents[target], path), target, (*open_refs, ref))
            beside = {k: walk(v, file, open_refs) for k, v in node.items() if k != "$ref" and not k.startswith("x-")}
            return {**found, **beside} if isinstance(found, dict) else found
        return {k: walk(v, file, open_refs) for k, v in node.items() if k != "$defs" and not k.startswith("x-")}

    return walk(documents[name], name, ())


def leaves(node: dict[str, Any], path: str = "", required: bool = True) -> Iterator[tuple[str, str, bool]]:
    """Attributes of an inlined JSON Schema: path, value type, and whether every step to it is required.

    Elements of an array share its path, and what is inside an array of objects is never required. Arrays of arrays
    have no attribute.
    """
    if isinstance(node.get("properties"), dict):
        need = {k for k in node.get("required", ()) if isinstance(k, str)}
        for key, child in node["properties"].items():
            if isinstance(child, dict):
                yield from leaves(child, f"{path}.{key}" if path else key, required and key in need)
    elif schema_type(node) == "array":
        items = node.get("items")
        if isinstance(items, dict):
            if schema_type(items) == "object" and "properties" in items:
                yield from leaves(items, path, False)
            elif schema_type(items) in ("string", "integer", "number", "boolean"):
                yield path, value_type(items), required
    else:
        yield path, value_type(node), required


def array_paths(node: dict[str, Any], path: str = "") -> set[str]:
    """Paths of the arrays of an inlined JSON Schema."""
    found: set[str] = set()
    if isinstance(node.get("properties"), dict):
        for key, child in node["properties"].items():
            if isinstance(child, dict):
                found |= array_paths(child, f"{path}.{key}" if path else key)
    elif schema_type(node) == "array":
        found.add(path)
        if isinstance(node.get("items"), dict):
            found |= array_paths(node["items"], path)
    return found


def allocate(node: dict[str, Any], existing: dict[str, dict[str, Any]] | None = None) -> dict[str, dict[str, Any]]:
    """The attribute file of an inlined JSON Schema, merged into an existing one.

    Known attributes keep their id and binding and get the schema's type and required flag; attributes that have left
    the schema stay; new names, in order, get ids above the largest.
    """
    merged = {k: dict(v) for k, v in (existing or {}).items()}
    top = max((int(v["attributeID"]) for v in merged.values() if "attributeID" in v), default=0)
    for name, kind, required in sorted(leaves(node)):
        if name not in merged:
            top += 1
            merged[name] = {"attributeID": top}
        merged[name]["valueType"] = kind
        merged[name].pop("required", None)
        if required:
            merged[name]["required"] = True
    return merged


def attribute_text(attributes: dict[str, dict[str, Any]]) -> str:
    """An attribute file, with keys in order."""
    return json.dumps(attributes, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def parse_attributes(given: dict[str, Any]) -> dict[str, Attribute]:
    """Attributes of a parsed attribute file."""
    found = {}
    for name, one in given.items():
        if not isinstance(one, dict) or not isinstance(one.get("attributeID"), int | float):
            raise CatalogError(f"attribute {name!r} has no numeric attributeID")
        if not isinstance(one.get("valueType"), str):
            raise CatalogError(f"attribute {name!r} has no valueType")
        bound = one.get("column_binding") or {}
        found[name] = Attribute(
            name,
            int(one["attributeID"]),
            one["valueType"],
            bool(one.get("required", False)),
            bound.get("col_name"),
            bound.get("encoding") or "default",
        )
    ids = [a.id for a in found.values()]
    if len(ids) != len(set(ids)):
        raise CatalogError("two attributes share an id")
    return found


def find_relations(document: dict[str, Any]) -> tuple[Relation, ...]:
    """Properties with a reference into another file and an ``x-relation`` that names the key."""
    found = []
    need = set(document.get("required", ()))
    for name, node in document.get("properties", {}).items():
        key = node.get("x-relation", {}).get("key_property") if isinstance(node, dict) else None
        file, _, path = str(node.get("$ref", "") if isinstance(node, dict) else "").partition("#")
        if key and file.endswith(".json"):
            parts = [p for p in path.strip("/").split("/") if p and p not in ("$defs", "properties", "definitions")]
            found.append(Relation(name, Path(file).stem, ".".join(parts), key, "id", key in need))
    return tuple(found)


@dataclass(frozen=True)
class Catalog:
    """Entity types by name."""

    schemas: dict[str, EntitySchema]

    def get(self, name: str) -> EntitySchema:
        if name not in self.schemas:
            raise CatalogError(f"unknown schema {name!r}")
        return self.schemas[name]

    def by_id(self, schema_id: int) -> EntitySchema:
        for found in self.schemas.values():
            if found.id == schema_id:
                return found
        raise CatalogError(f"unknown schema id {schema_id}")

    def names(self) -> list[str]:
        return sorted(self.schemas)

    def drift(self, name: str) -> dict[str, list[str]]:
        """Properties of the JSON Schema without an attribute, and attributes without a property."""
        found = self.get(name)
        try:
            known = {path for path, _, _ in leaves(found.json_schema)}
        except CatalogError:
            known = set()
        return {"unmapped": sorted(known - set(found.attributes)), "orphaned": sorted(set(found.attributes) - known)}


def build_catalog(
    documents: dict[str, dict[str, Any]], attributes: dict[str, dict[str, Any]], ids: dict[str, int] | None = None
) -> Catalog:
    """From parsed JSON Schemas (``lead.json``) and attribute files (``lead``). Names without an id get the next ones,
    in order from 100 on; a schema without attributes is an error."""
    names = sorted(Path(f).stem for f in documents)
    ids = dict(ids or {})
    free = max([FIRST_ID - 1, *ids.values()]) + 1
    schemas = {}
    for name in names:
        if name not in attributes:
            raise CatalogError(f"schema {name!r} has no attribute file")
        if name not in ids:
            ids[name], free = free, free + 1
        document = documents[f"{name}.json"]
        whole = inline(f"{name}.json", documents)
        schemas[name] = EntitySchema(
            name, ids[name], parse_attributes(attributes[name]), frozenset(array_paths(whole)), find_relations(document), whole
        )
    return Catalog(schemas)


def with_attributes(schema: EntitySchema, *more: Attribute) -> EntitySchema:
    return replace(schema, attributes={**schema.attributes, **{a.name: a for a in more}})
