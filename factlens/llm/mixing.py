"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document of a source stands in a fixed shuffled order.  Its virtual finish time is
the source's words up to and with it, over the source's target; a second copy follows one
whole source later.  All copies are ranged by that time and taken until the budget is
spent, so that the sources run dry in the proportion of their targets.

Running sums are in two levels (a sum for each part, then within the part), so that no
source and no global order is ever one task.

Defined results: null texts have size 0; a null source is a source of its own, the last
one; sources without words, and all documents of them, take nothing.  Repeated rows are
documents of their own.  Ties in time go by source, copy, shuffle key, doc_id and text, so
that reruns over the rows in any order agree, up to rows that are equal in all of them.
A document's other columns are not read, and a column of `docs` that has a name of the
result is replaced in `mixed`.  One task orders the sources, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
PART_ROWS = 50_000
#: Virtual time is cut into this many ranges, and the one that holds the end once more.
RANGES = 1024
#: Sources up to this number are sent to all tasks, a row each; more are joined.
FEW_SOURCES = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with ord and target: shares by weight, none above `most` times its size.

    Levels are filled as water: in the order of size over weight, sources are full until
    the rest, shared by weight, leaves the next one below its bound.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("ord", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % n + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("ratio", "ord")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "ord"))).over(every))
    return s.select("source", "source_size", "ord", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def _cut(spent: list[tuple[int, int]], budget: float) -> tuple[int, int]:
    """The first range that does not fit, and what is taken before it."""
    total = 0
    for at, n in sorted(spent):
        if total + n > budget:
            return at, total
        total += n
    return 1 << 62, total


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, part_rows: int = PART_ROWS) -> DataFrame:
    """Each row's (__row, doc_id, size, source_size, target, taken) for `docs` with doc_id, text and source.

    __row is that of `docs` if it has one, and else counts rows and is stable within one
    result.  The driver gets one row for each of RANGES ranges of time, and never more.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    row = F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id().alias("__row")
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary")), 1, 15), 16, 10).cast("long")
    sized = scratch.write(docs.select(row, "doc_id", "source", word_count("text").alias("size"), key.alias("key"), F.xxhash64("text").alias("tie")), "sized")
    return queue(sized, scratch, weights, share, most, part_rows)


def queue(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, most: int, part_rows: int) -> DataFrame:
    goal = scratch.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "goal")
    (n_sources, total), n_rows = goal.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first(), sized.count()
    budget = total * share
    bits = max(8, (max(1, n_rows // part_rows) - 1).bit_length())
    side = F.broadcast(goal) if n_sources <= FEW_SOURCES else goal
    rows = sized.join(side, sized["source"].eqNullSafe(goal["source"])).drop("source").withColumn("part", F.shiftright("key", 60 - bits))
    base = rows.groupBy("ord", "part").agg(F.sum("size").alias("n"))
    base = base.withColumn("base", F.sum("n").over(Window.partitionBy("ord").orderBy("part")) - F.col("n")).select("ord", "part", "base")
    own = Window.partitionBy("ord", "part").orderBy("key", "doc_id", "tie", "__row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("size").over(own)).join(base, ["ord", "part"]).withColumn("sum", F.col("base") + F.col("own"))
    rows = scratch.write(rows.select("__row", "doc_id", "size", "source_size", "target", "ord", "key", "tie", "sum"), "rows")

    def finish(copy: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("sum") + F.lit(copy) * F.col("source_size")) / F.col("target"))

    live = rows.where("size > 0 and target > 0")
    copies = live.select("*", F.explode(F.array(*(F.struct(finish(c).alias("time"), F.lit(c).alias("copy")) for c in range(most)))).alias("x")).select("*", "x.*").drop("x")
    coarse = F.least(F.floor(F.col("time") * RANGES), F.lit(most * RANGES * 4)).cast("long")
    at, before = _cut([tuple(r) for r in copies.groupBy(coarse).agg(F.sum("size")).collect()], budget)
    fine = F.floor((F.col("time") * RANGES - at) * RANGES).cast("long")
    inner = copies.where(coarse == at)
    at2, before2 = _cut([tuple(r) for r in inner.groupBy(F.least(fine, F.lit(RANGES))).agg(F.sum("size")).collect()], budget - before)
    last = inner.where(F.least(fine, F.lit(RANGES)) == at2)
    line = ("time", "ord", "copy", "key", "doc_id", "tie", "__row")
    spent = F.sum("size").over(Window.orderBy(*line).rowsBetween(Window.unboundedPreceding, 0))
    end = last.withColumn("spent", spent).where(F.col("spent") <= budget - before - before2).agg(F.max(F.struct(*line)).alias("end")).first()[0]

    def taken(copy: int) -> Column:
        time = finish(copy)
        where = F.least(F.floor(time * RANGES), F.lit(most * RANGES * 4)).cast("long")
        within = F.least(F.floor((time * RANGES - at) * RANGES).cast("long"), F.lit(RANGES))
        tie = F.lit(False)
        if end is not None:
            mine = F.struct(time.alias("time"), "ord", F.lit(copy).alias("copy"), "key", "doc_id", "tie", "__row")
            tie = mine <= F.struct(*(F.lit(end[c]).cast(last.schema[c].dataType).alias(c) for c in line))
        return F.when(F.coalesce((where < at) | ((where == at) & ((within < at2) | ((within == at2) & tie))), F.lit(False)), F.col("size")).otherwise(F.lit(0))

    out = rows.withColumn("taken", sum((taken(c) for c in range(most)), F.lit(0)).cast("long"))
    return out.select("__row", "doc_id", "size", "source_size", "target", "taken")


def op7(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("__row")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, one row each, with all their columns and size, source_size, target and taken."""
    scratch = Scratch(docs.sparkSession, "mixed")
    docs = docs.drop("size", "source_size", "target", "taken", "__row")
    numbered = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered.select("__row", "doc_id", "text", "source")).where("taken > 0").drop("doc_id")
    return numbered.join(taken, "__row").select(*(F.col(f"`{c}`") for c in docs.columns), "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix'), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((ord - 1) % 3 + 1 AS INT)] AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, ord LIMIT 1),
t AS (SELECT source, source_size, ord, least(cap::DOUBLE, coalesce((SELECT level FROM v) * weight, cap::DOUBLE)) AS target FROM l),
q AS (
  SELECT d.doc_id, d.size, d.key, t.source_size, t.target, t.ord,
         CAST(sum(d.size) OVER (PARTITION BY t.ord ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.*, k.copy, (upto + k.copy * source_size) / target AS time
  FROM q, (VALUES (0), (1)) AS k(copy) WHERE size > 0 AND target > 0),
g AS (
  SELECT *, sum(size) OVER (ORDER BY time, ord, copy, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM c),
n AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM g
  WHERE spent <= (SELECT sum(source_size) FROM s) * 1.5::DOUBLE GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN n USING (doc_id)
"""
