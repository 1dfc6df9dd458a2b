"""Entity tables as Parquet, parted by schema id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog import EntitySchema


def write_entities(df: DataFrame, schema: EntitySchema, path: str, mode: str = "overwrite") -> None:
    """Write entities of one type to its folder below `path`."""
    df.drop("schema_id").write.mode(mode).parquet(f"{path}/schema_id={schema.id}")


def read_entities(spark: SparkSession, schema: EntitySchema, path: str) -> DataFrame:
    """Entities of one type; only its folder is read. Columns are row_id and those of the entity's type."""
    typed = schema.spark_type().add("row_id", "string")
    return spark.read.schema(typed).parquet(f"{path}/schema_id={schema.id}")


def write_layout(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a hot or attribute-value table, a folder for each schema id."""
    df.write.mode(mode).partitionBy("schema_id").parquet(path)


def read_layout(spark: SparkSession, path: str, schema_id: int) -> DataFrame:
    """A hot or attribute-value table of one type; the other folders are not read."""
    return spark.read.parquet(path).where(F.col("schema_id") == schema_id)


def get_entity(df: DataFrame, row_id: str) -> DataFrame:
    """The row with an id, or none."""
    return df.where(F.col("row_id") == row_id)
