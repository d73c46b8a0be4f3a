"""The corpus pipeline: language, repeated lines, near copies, benchmark leaks, mixing.

Each stage takes what its predecessor kept and returns the columns of documents; the last
one adds what the mix takes of each document.

Defined results: rows whose text is null, empty or without letters leave in the first
stage, and so do those of no known language.  Repeated rows are near copies of each other,
of which one stays; rows of one doc_id are one document to the second stage, which keeps
its lines in all of them.  A null doc_id counts as the largest.  A text that loses all its
lines stays as the empty text until the mix, which takes nothing of it.  Empty tables give
empty tables.  Other columns pass through all stages; those named size, source_size, target
and taken are replaced by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from factlens.llm.scratch import Scratch

#: Texts less like every profile than this are of no known language.  Of 1,960 labelled rows held out
#: at sf0.1 the least score was 0.42; random Latin letters had 0.18, base64 0.19, hex 0.12.
LEAST_LIKE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, LEAST_LIKE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs, counts=("__n_lines", "__n_dropped"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, num=4, den=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_copies), ("decontaminate", benchmark), ("mix", mix)]

#: Language profiles and string tiling have no SQL form; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
