"""Catalog tables: Parquet folders under one- or two-part names, and scans by name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_tables(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Expose the Parquet tables of ``folder`` as temporary views."""
    for name in tables:
        parquet_table(spark, folder, name).createOrReplaceTempView(name)


def _quoted(name: str) -> str:
    """A one- or two-part name with each part quoted; anything else is an error."""
    parts = name.split(".")
    if len(parts) > 2 or not all(parts):
        raise ValueError(f"not a table name of one or two parts: {name!r}")
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def create_schema(spark: SparkSession, schema: str) -> None:
    """Create a namespace of the session catalog unless it is there."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {_quoted(schema)}")


def create_table(spark: SparkSession, name: str, location: str) -> None:
    """Make the Parquet folder at ``location`` the table ``name`` ("schema.table"; its schema is created as needed).

    The table is external: the catalog holds columns and place, and a table that had the name loses its entry but no file. Columns are read from the
    files, and folders like ``year=2001`` become a partition column, by which scans are pruned.
    """
    if "." in name:
        create_schema(spark, name.split(".")[0])
    place = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
    spark.sql(f"CREATE TABLE {_quoted(name)} USING parquet LOCATION '{place}'")
    if any(column.isPartition for column in spark.catalog.listColumns(_quoted(name))):
        spark.catalog.recoverPartitions(_quoted(name))


def create_tables(spark: SparkSession, locations: Mapping[str, str]) -> None:
    """``create_table`` for each name and location."""
    for name, location in locations.items():
        create_table(spark, name, location)


def scan(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table by its (possibly two-part) name."""
    return spark.table(_quoted(name))


def catalog_listing(spark: SparkSession, schemas: Iterable[str] | None = None) -> DataFrame:
    """(table_name) of all tables in the schemas (by default all), as "schema.table"; temporary views have no schema and are not listed."""
    if schemas is None:
        schemas = [row[0] for row in spark.sql("SHOW SCHEMAS").collect()]
    out = spark.createDataFrame([], "table_name string")
    for schema in schemas:
        shown = spark.sql(f"SHOW TABLES IN {_quoted(schema)}").filter("not isTemporary")
        out = out.union(shown.select(F.concat_ws(".", "namespace", "tableName").alias("table_name")))
    return out
