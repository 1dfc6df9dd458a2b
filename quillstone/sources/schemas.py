"""Catalogs from folders and from registry tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillstone.catalog import Catalog, allocate, attribute_text, build_catalog, inline

#: Files that lie beside schemas and are none.
_BESIDE = ("_attributes.json", "_full.json")


def _read(folder: str | Path) -> tuple[dict, dict]:
    files = sorted(Path(folder).glob("*.json"))
    documents = {f.name: json.loads(f.read_text("utf-8")) for f in files if not f.name.endswith(_BESIDE)}
    beside = {f.name.removesuffix("_attributes.json"): json.loads(f.read_text("utf-8")) for f in files if f.name.endswith("_attributes.json")}
    return documents, beside


def catalog_from_folder(folder: str | Path) -> Catalog:
    """``<name>.json`` and ``<name>_attributes.json`` of a folder; ids from 100 on in the order of names."""
    return build_catalog(*_read(folder))


def catalog_from_table(registry: DataFrame, folder: str | Path) -> Catalog:
    """The schemas that a registry table (schema_name, schema_id) lists, from the files of a folder."""
    ids = {r["schema_name"]: r["schema_id"] for r in registry.select("schema_name", "schema_id").orderBy("schema_name").collect()}
    documents, attributes = _read(folder)
    whole = build_catalog(documents, {**{Path(d).stem: {} for d in documents}, **attributes}, ids)
    missing = [n for n in ids if n not in whole.schemas or n not in attributes]
    if missing:
        raise FileNotFoundError(f"no schema or attribute file for {', '.join(missing)}")
    return Catalog({n: whole.schemas[n] for n in ids})


def registry_table(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """The registry table of a catalog."""
    return spark.createDataFrame([(s.name, s.id) for s in catalog.schemas.values()], "schema_name string, schema_id smallint")


def generate_attributes(folder: str | Path, name: str) -> str:
    """Write ``<name>_attributes.json`` from the schema and what the file holds so far; returns its text."""
    documents, attributes = _read(folder)
    text = attribute_text(allocate(inline(f"{name}.json", documents), attributes.get(name)))
    (Path(folder) / f"{name}_attributes.json").write_text(text, "utf-8")
    return text


def known_tables(spark: SparkSession) -> list[str]:
    """Names of the tables and views of the current database."""
    return sorted({t.name for t in spark.catalog.listTables()})
