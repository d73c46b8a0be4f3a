"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of `block` code points.  Distinct blocks, sorted, get integer
names; then each adjacent pair of names gets one, and so on, until one name is left.  The
number of rounds and that name are the text's identity.  Names are given to the blocks
themselves and never to hashes of them, so two texts share an identity only if they are
equal.

At every level the HOT most frequent keys are named apart and sent to all tasks, HOT keys
of bounded length, and their rows then go on under keys of their own, so that no task gets
all rows of one block, pair or text.  Tables after the first level hold integers only.

Defined results: a null text is the empty text, which is one empty block.  Of equal
texts the largest doc_id stays, a null doc_id counting as the smallest; of rows that
repeat it, each is marked kept.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK = 4096
HOT = 64


def _blocks(text: Column, block: int) -> Column:
    """The text in blocks, cut in one pass; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def _hot(rows: DataFrame, *keys: str) -> list[int]:
    """Hashes of the most frequent keys, HOT at most."""
    often = rows.groupBy(F.xxhash64(*keys).alias("h")).count().where("count > 8")
    return [r["h"] for r in often.orderBy(F.col("count").desc(), "h").limit(HOT).collect()]


def _split(values: DataFrame, hot: list[int], *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """Values of the other keys, and those of the hot ones."""
    is_hot = F.xxhash64(*keys).isin(hot)
    return (values.where(~is_hot), values.where(is_hot)) if hot else (values, None)


def _with(rows: DataFrame, cold: DataFrame, few: DataFrame | None, *keys: str) -> DataFrame:
    """Rows, which have a number `row`, with the values of their keys: hot ones from a broadcast of HOT rows, the others by a join.

    A hot row takes part in that join under a key that nothing has.
    """
    if few is None:
        return rows.join(cold, list(keys))
    values = [c for c in cold.columns if c not in keys]
    rows = rows.join(F.broadcast(few.withColumnsRenamed({c: f"hot_{c}" for c in values})), list(keys), "left")
    found = F.col(f"hot_{values[0]}").isNotNull()
    away = {k: F.when(found, F.concat(F.lit("\0"), F.col("row").cast("string")) if t == "string" else -(1 << 61) - F.col("row")).otherwise(F.col(k)) for k, t in rows.dtypes if k in keys}
    joined = rows.withColumns(away).join(cold, list(keys), "left")
    return joined.select(*(c for c in rows.columns if not c.startswith("hot_")), *(F.coalesce(f"hot_{c}", c).alias(c) for c in values))


def _names(keys: DataFrame, hot: list[int], *cols: str) -> tuple[DataFrame, DataFrame | None]:
    """Distinct keys with an integer name each: sorted within their partition, and counted on; hot ones from -1 down."""
    cold, few = _split(keys, hot, *cols)
    cold = cold.distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())
    if few is not None:
        few = few.distinct().withColumn("name", -1 - F.row_number().over(Window.orderBy(*cols)).cast("long"))
    return cold, few


def identities(docs: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(row, doc_id, sha, rounds, name) for each row of `docs` (doc_id, text); equal texts have equal (rounds, name)."""
    scratch = scratch or Scratch(docs.sparkSession, "block-names")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bare = rows.select(F.explode(_blocks(F.col("text"), block)).alias("block"))
    # the row number stands below the explode, so that all blocks of a row have one
    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.posexplode(_blocks(F.col("text"), block)).alias("pos", "block"))
    parts = parts.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    named = _with(parts, *_names(bare, _hot(bare, "block"), "block"), "block").drop("block")
    level, seen = scratch.counted(named.select("row", "doc_id", "sha", F.col("pos").cast("long").alias("pos"), F.col("name").cast("long").alias("name"), F.lit(0).alias("rounds")), "names-0", more="pos > 0")
    scratch.release()
    if not seen["more"]:
        return level.select("row", "doc_id", "sha", "rounds", "name")
    level, seen = scratch.counted(level.join(level.groupBy("row").agg(F.max("pos").alias("last")), "row"), "named-0", more="last > 0")
    scratch.drop("names-0")
    done, rounds = [], 0
    while seen["more"]:
        done.append(level.where("last = 0").select("row", "doc_id", "sha", "rounds", "name"))
        pairs = level.where("last > 0").groupBy("row", F.expr("pos div 2").alias("pos")).agg(
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.expr("max(last) div 2").alias("last"), F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("one"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("two")
        )
        pairs = scratch.write(pairs.withColumn("two", F.coalesce("two", F.lit(-(1 << 62)))), f"pairs-{rounds}")
        hot = _hot(pairs, "one", "two")
        names, few = _names(pairs.select("one", "two"), hot, "one", "two")
        names = scratch.write(names, f"pair-names-{rounds}")
        rounds += 1
        level, seen = scratch.counted(_with(pairs, names, few, "one", "two").drop("one", "two").withColumn("rounds", F.lit(rounds)), f"named-{rounds}", more="last > 0")
    done.append(level.select("row", "doc_id", "sha", "rounds", "name"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.write(identities(docs.select("doc_id", "text"), block, scratch), "identities")
    groups = scratch.write(rows.groupBy("rounds", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    hot = [r["h"] for r in groups.where("group_size > 8").orderBy(F.col("group_size").desc(), "rounds", "name").limit(HOT).select(F.xxhash64(F.col("rounds").cast("long"), "name").alias("h")).collect()]
    out = _with(rows.withColumn("rounds", F.col("rounds").cast("long")), *_split(groups.withColumn("rounds", F.col("rounds").cast("long")), hot, "rounds", "name"), "rounds", "name")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op4(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
