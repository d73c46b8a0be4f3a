"""Test runs in JSON, one run a line, as four frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = "struct<attempt:int,outcome:string,duration_ms:bigint,failure:string>"
RUN = f"run_id bigint, started timestamp, environment map<string,string>, cases array<struct<id:string,package:string,name:string,attempts:array<{ATTEMPT}>>>, coverage array<struct<test_id:string,symbol_id:string,statements:bigint,covered:bigint>>"
OUTCOMES = ("pass", "fail", "error", "skip")


@dataclass
class TestRuns:
    cases: DataFrame
    runs: DataFrame
    attempts: DataFrame
    coverage: DataFrame


def map_digest(values: Column) -> Column:
    """SHA-256 over a map's entries sorted by key, each as `<bytes>:<key>,<bytes>:<value>,`."""
    sized = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x, F.lit(","))
    entry = F.transform(F.array_sort(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>")))), lambda e: F.concat(sized(e["key"]), sized(F.coalesce(e["value"], F.lit("")))))
    return F.sha2(F.array_join(entry, "").cast("binary"), 256)


def read(spark: SparkSession, path: str) -> TestRuns:
    """Unknown types and outcomes fail; a failure's text is kept as its digest beside it."""
    rows = spark.read.schema(RUN).option("mode", "FAILFAST").json(path)
    runs = rows.select("run_id", "started", map_digest(F.col("environment")).alias("environment"))
    case = rows.select("run_id", F.explode("cases").alias("c"))
    cases = case.select(F.col("c.id").alias("test_id"), "c.package", "c.name").distinct()
    tries = case.select(F.col("c.id").alias("test_id"), "run_id", F.explode("c.attempts").alias("a")).select("test_id", "run_id", "a.*")
    sound = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("no such outcome: "), F.coalesce("outcome", F.lit("null")))).cast("string"))
    attempts = tries.withColumn("outcome", sound).withColumn("failure_digest", F.sha2(F.col("failure").cast("binary"), 256))
    return TestRuns(cases, runs, attempts, rows.select("run_id", F.explode("coverage").alias("v")).select("run_id", "v.*"))


def linked(cases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(test_id, symbol_id) of cases whose package and name declare one function.

    The functions of a package and name are joined as their first and last id, which tell
    whether they are one, so that no case meets each of its namesakes.
    """
    s = symbols.where("kind = 'func'").groupBy("package", "name").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    ends = cases.join(s, ["package", "name"]).groupBy("test_id").agg(F.min("first").alias("symbol_id"), F.max("last").alias("last"))
    return ends.where("symbol_id = last").select("test_id", "symbol_id")
