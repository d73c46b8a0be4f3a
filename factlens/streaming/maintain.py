"""Effective state kept up to date from a stream of deltas.

Deltas (ordinal, key, op, fp) arrive as an append-only stream.  Each micro-batch is
written under its own number, so a batch that is run again replaces itself; the state is
the newest delta of each key over all batches, tombstones dropped last.

`compact` puts the newest delta of every key so far into one base, after which batches up
to its number are not read again, and are dropped.  A base that was not completed does not
count.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlens.sources.shared import remove

SCHEMA = "ordinal long, key string, op string, fp long"


def maintain(deltas: DataFrame, path: str, checkpoint: str, compact_every: int = 0) -> StreamingQuery:
    """Takes what has arrived; with `compact_every` the batches are put together at each such number."""

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("key").agg(F.max_by(F.struct("ordinal", "op", "fp"), "ordinal").alias("x")).select("x.ordinal", "key", "x.op", "x.fp")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if compact_every and number and number % compact_every == 0:
            compact(batch.sparkSession, path)

    return deltas.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> tuple[int, dict[str, list[tuple[int, str]]]]:
    """The number of the newest complete base, -1 without one, and all (number, folder) by kind, complete ones alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[tuple[int, str]]] = {"batch": [], "base": []}
    for name in (x.getPath().getName() for x in fs.listStatus(at(path))) if fs.exists(at(path)) else ():
        if (m := re.fullmatch(r"(batch|base)=(\d+)", name)) and fs.exists(at(f"{path}/{name}/_SUCCESS")):
            found[m[1]].append((int(m[2]), f"{path}/{name}"))
    return max((n for n, _ in found["base"]), default=-1), found


def _newest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The newest delta of each key, tombstones too, and the number of the last batch."""
    base, found = _parts(spark, path)
    read = lambda n, f: spark.read.schema(SCHEMA).parquet(f).withColumn("batch", F.lit(n).cast("long"))
    rows = spark.createDataFrame([], SCHEMA + ", batch long")
    for n, f in found["base"]:
        rows = rows.union(read(n, f)) if n == base else rows
    late = [(n, f) for n, f in found["batch"] if n > base]
    if late:
        number = F.regexp_extract(F.input_file_name(), r"batch=(\d+)/[^/]*$", 1).cast("long")
        rows = rows.union(spark.read.schema(SCHEMA).parquet(*(f for _, f in late)).withColumn("batch", number))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("ordinal", "op", "fp"), F.struct("ordinal", "batch")).alias("x"))
    return newest.select("x.ordinal", "key", "x.op", "x.fp"), max([base, *(n for n, _ in late)])


def compact(spark: SparkSession, path: str) -> None:
    rows, last = _newest(spark, path)
    base, found = _parts(spark, path)
    if last > base:
        rows.write.mode("overwrite").parquet(f"{path}/base={last}")
    for kind, parts in found.items():
        for n, f in parts:
            if n < last or (n == last and kind == "batch"):
                remove(spark, f)


def state(spark: SparkSession, path: str) -> DataFrame:
    return _newest(spark, path)[0].where("op = 'set'").select("key", "ordinal", "fp")
