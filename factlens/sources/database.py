"""The catalogue of a database: rows (schema, table, column, ordinal, type, nullable).

Both readers take metadata only, so what they gather is bounded by the number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "schema string, table string, column string, ordinal int, type string, nullable boolean"


def from_session(spark: SparkSession, schemas: list[str] | None = None) -> DataFrame:
    """Tables and views that the session's catalogue knows; temporary views have an empty schema."""
    rows = []
    for db in schemas or [d.name for d in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(db):
            name = t.name if t.isTemporary else f"`{db}`.`{t.name}`"
            rows += described(spark.table(name), "" if t.isTemporary else db, t.name)
    return spark.createDataFrame(sorted(set(rows)), COLUMNS)


def described(table: DataFrame, schema: str, name: str) -> list[tuple]:
    return [(schema, name, f.name, n, f.dataType.simpleString(), f.nullable) for n, f in enumerate(table.schema.fields, 1)]


def from_folder(spark: SparkSession, path: str, names: list[str], schema: str = "main") -> DataFrame:
    """The catalogue of a folder of Parquet tables, of their footers alone."""
    return spark.createDataFrame([r for n in names for r in described(spark.read.parquet(f"{path}/{n}.parquet"), schema, n)], COLUMNS)


def from_jdbc(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The catalogue of a server with an information schema; the server's own schemas are left out."""
    read = spark.read.format("jdbc").options(url=url, dbtable="information_schema.columns", **options).load()
    low = read.toDF(*(c.lower() for c in read.columns))
    return low.where(~F.lower("table_schema").isin("information_schema", "pg_catalog", "sys")).select(
        F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("column_name").alias("column"), F.col("ordinal_position").cast("int").alias("ordinal"), F.col("data_type").alias("type"), (F.upper("is_nullable") == "YES").alias("nullable")
    )
