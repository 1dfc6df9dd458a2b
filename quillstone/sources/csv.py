"""CSV files to entities: mappings from columns to paths, with an error for each row that fails."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import fields as ff


@dataclass(frozen=True)
class Mapping:
    column: str
    path: str
    transformer: ff.Transformer
    required: bool = False


@dataclass(frozen=True)
class Mapper:
    """Mappings of one entity type; built by chaining."""

    schema_name: str
    mappings: tuple[Mapping, ...] = ()

    def map(self, column: str, path: str, transformer: ff.Transformer | None = None, required: bool = False) -> Mapper:
        return Mapper(self.schema_name, (*self.mappings, Mapping(column, path, transformer or ff.identity(), required)))

    def required(self, column: str, path: str, transformer: ff.Transformer | None = None) -> Mapper:
        return self.map(column, path, transformer, True)


@dataclass(frozen=True)
class Imported:
    """Rows that could be mapped, and the errors of those that could not."""

    rows: DataFrame
    errors: DataFrame
    all_rows: DataFrame = field(repr=False, default=None)  # type: ignore[assignment]

    def counts(self) -> DataFrame:
        """total, success and failed, in one pass."""
        bad = F.col("error").isNotNull()
        return self.all_rows.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("failed")
        )


#: Column with the text of a record that has more or fewer cells than the header.
MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", comment: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns as texts, and `MALFORMED`. Quoted cells may hold doubled quotes; blanks before a cell are dropped.

    With `multi_line` cells may hold line breaks, and a file is read by one task; without, large files are split.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "sep": delimiter}
    reader = spark.read.options(**options, **({"comment": comment} if comment else {}))
    kind = T.StructType([*reader.csv(path).schema, T.StructField(MALFORMED, T.StringType())])
    return reader.option("columnNameOfCorruptRecord", MALFORMED).schema(kind).csv(path)


def path_parts(path: str) -> list[str | int]:
    """``items[0].id`` as ['items', 0, 'id']."""
    parts: list[str | int] = []
    for step in path.split("."):
        name, _, rest = step.partition("[")
        parts.append(name)
        parts += [int(i.rstrip("]")) for i in rest.split("[")] if rest else []
    return parts


def _tree(values: list[tuple[list[str | int], Column]]) -> Column:
    """Nested structs and arrays of values at paths."""
    if len(values) == 1 and not values[0][0]:
        return values[0][1]
    groups: dict[Any, list] = {}
    for (head, *rest), value in values:
        groups.setdefault(head, []).append((rest, value))
    if all(isinstance(k, int) for k in groups):
        return F.array(*(_tree(groups[k]) for k in sorted(groups)))
    return F.struct(*(_tree(v).alias(str(k)) for k, v in groups.items()))


def import_rows(rows: DataFrame, mapper: Mapper, row_number: Column | None = None) -> Imported:
    """Map rows in one pass. The first failing field of a row is its error: row, column, path, value, reason.

    A record that `read_csv` marks as malformed is an error of its own. Without `row_number` rows are numbered as they are
    read, from 1 in each partition's range: as in the file, if one task reads one file.
    """
    made = []
    for one in mapper.mappings:
        source = F.col(f"`{one.column}`") if one.column in rows.columns else F.lit(None).cast("string")
        text = F.coalesce(source, F.lit(""))
        found = one.transformer(text)
        if one.required:
            missing = F.when(F.trim(text) == "", F.lit("required value is missing"))
            found = ff.Field(found.value, F.coalesce(missing, found.error))
        value = found.value if ff.takes_empty(one.transformer) else F.when(F.trim(text) != "", found.value)
        made.append((one, source, ff.Field(value, found.error)))
    number = F.monotonically_increasing_id() + 1 if row_number is None else row_number
    tops: dict[str, list] = {}
    for one, _, found in made:
        head, *rest = path_parts(one.path)
        tops.setdefault(str(head), []).append((rest, found.value))
    fields = [(m.column, m.path, s, f) for m, s, f in made]
    if MALFORMED in rows.columns:
        record = F.col(MALFORMED)
        fields.insert(0, ("", "", record, ff.Field(record, F.when(record.isNotNull(), F.lit("malformed record")))))
    error = ff.first_error(fields)
    mapped = rows.select(number.alias("row"), error.alias("error"), *(_tree(v).alias(k) for k, v in tops.items()))
    good = mapped.where(F.col("error").isNull()).drop("error")
    bad = mapped.where(F.col("error").isNotNull()).select("row", "error.*")
    return Imported(good, bad, mapped)


def watch_mapper() -> Mapper:
    """The mapper of the sample watch list."""
    return (
        Mapper("watch")
        .required("id", "id", ff.to_int())
        .required("name", "name")
        .required("brand", "brand")
        .map("price", "price.value", ff.to_price())
        .map("price", "price.display")
        .map("model", "model")
        .map("ref", "reference")
        .map("mvmt", "movement")
        .map("casem", "material.case")
        .map("bracem", "material.bracelet")
        .map("yop", "yearOfProduction.year", ff.to_year())
        .map("yop", "yearOfProduction.approximate", ff.is_year_approximate())
        .map("cond", "condition", ff.enum("Unworn", "New", "Very good", "Good", "Fair"))
        .map("sex", "gender")
        .map("size", "size.width", ff.to_size_width())
        .map("size", "size.height", ff.to_size_height())
    )
