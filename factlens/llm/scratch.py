"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under `spark.checkpoint.dir` and reading it back, so
that a lost executor costs a reread and no recomputation.  A run's folder is deleted when
the driver ends, as its results may be read until then; tables that later steps don't
need go at once.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from factlens.sources import shared


class Scratch:
    """Named tables of one operator run; `drop` frees what later steps no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, shared.folder(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def observed(self, df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, Row]:
        """The written table, and sums over its rows that were made as they were written."""
        seen = Observation()
        out = self.write(df.observe(seen, *sums), name)
        return out, Row(**seen.get)

    def counted(self, df: DataFrame, name: str, **when: str) -> tuple[DataFrame, dict[str, int]]:
        """The written table, and how many of its rows hold each condition."""
        out, seen = self.observed(df, name, *(F.count(F.expr(f"CASE WHEN {c} THEN 1 END")).alias(k) for k, c in when.items()))
        return out, {k: int(v or 0) for k, v in seen.asDict().items()}

    def drop(self, *names: str) -> None:
        for name in names:
            shared.remove(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Lets the driver's cleaner remove shuffle files of finished jobs now, as they take disk."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
