"""More differences: files, members, statements, tokens, database schemas and whole graphs."""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factlens.functions import sequence

from .traverse import reachable

_TOKEN = re.compile(r"\w+|[^\w\s]")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of rows (path, digest) that are on one side only or differ."""
    a, b = before.select("path", F.col("digest").alias("d0"), F.lit(1).alias("a")), after.select("path", F.col("digest").alias("d1"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("d0").eqNullSafe(F.col("d1")), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def roll_up(rows: DataFrame) -> DataFrame:
    """Added and removed lines of rows (package, path, added, removed) by file, by package and in all; `level` counts what is left out."""
    return rows.rollup("package", "path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), (F.grouping("package") + F.grouping("path")).cast("long").alias("level"))


def format_only(pairs: DataFrame) -> DataFrame:
    """Pairs (key, old_hash, new_hash, old_text, new_text) of one meaning in another form."""
    return pairs.where("old_hash = new_hash AND NOT (old_text <=> new_text)").select("key")


def retyped(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new) of rows (id, package, kind, owner_id, name): one removed and one added symbol of the same place and name."""
    place = ["package", "kind", "owner_id", "name"]
    gone, came = before.where("id IS NOT NULL").join(after.select("id"), "id", "left_anti"), after.where("id IS NOT NULL").join(before.select("id"), "id", "left_anti")
    one = lambda d, as_: d.withColumn("owner_id", F.coalesce("owner_id", F.lit(""))).groupBy(*place).agg(F.min("id").alias(as_), F.count("*").alias("n")).where("n = 1").drop("n")
    return one(gone, "old").join(one(came, "new"), place).select("old", "new")


def relocation(old_package: Column, new_package: Column, old_name: Column, new_name: Column) -> Column:
    """rename_move, moved, renamed, or null where both stayed."""
    away, other = ~old_package.eqNullSafe(new_package), ~old_name.eqNullSafe(new_name)
    return F.when(away & other, "rename_move").when(away, "moved").when(other, "renamed")


def layer(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """The outermost layer that differs: public, private, content, or null."""
    differs = lambda name: ~old[name].eqNullSafe(new[name])
    return F.when(differs("public"), "public").when(differs("private"), "private").when(differs("content"), "content")


def members(before: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, key, change) of rows (owner, key, nth, hash): members pair by key and number among equals; the rest goes or comes."""
    on = ["owner", "key", "nth"]
    a, b = before.select(*on, F.col("hash").alias("h0"), F.lit(1).alias("a")), after.select(*on, F.col("hash").alias("h1"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")), "changed")
    return a.join(b, on, "full").select("owner", "key", "nth", change.alias("change")).where("change IS NOT NULL")


def columns_diff(before: DataFrame, after: DataFrame, metadata: tuple[str, ...] = ("type", "nullable")) -> DataFrame:
    """(table, column, change) of catalogue rows (schema, table, column, type, nullable), compared by the named metadata.

    With one schema on each side the two are aligned whatever their names; else schemas pair by name.
    """
    single = all(d.select("schema").distinct().limit(2).count() == 1 for d in (before, after))
    space = F.lit("") if single else F.col("schema")
    keyed = lambda d, x, y: d.select(space.alias("space"), "table", "column", F.struct(F.lit(0).alias("there"), *metadata).alias(x), F.lit(1).alias(y))
    j = keyed(before, "t0", "a").join(keyed(after, "t1", "b"), ["space", "table", "column"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("t0").eqNullSafe(F.col("t1")), "changed")
    return j.select("table", "column", change.alias("change")).where("change IS NOT NULL")


#: Rows that a task hands on at once.
PAGE = 1 << 12


def _per_row(rows: DataFrame, work, schema: str) -> DataFrame:
    """What `work` gives for each row (key, old, new), in pages, so that a task holds the rows of one text and a page alone."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def made(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield from work(*(batch.column(c)[at].as_py() for c in ("key", "old", "new")))

    def pages(batches):
        left = made(batches)
        while page := list(islice(left, PAGE)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*page, strict=True), out, strict=True)], schema=out)

    return rows.select(F.col("key").cast("string").alias("key"), "old", "new").mapInArrow(pages, schema)


def line_changes(texts: DataFrame) -> DataFrame:
    """(key, added, removed) lines of the smallest script of rows (key, old, new)."""

    def work(key, old, new):
        a, b = sequence.lines(old), sequence.lines(new)
        same = len(sequence.matches(a, b))
        return [(key, len(b) - same, len(a) - same)]

    return _per_row(texts, work, "key string, added long, removed long")


def changed_lines(texts: DataFrame) -> DataFrame:
    """(key, op, line) of the smallest script of rows (key, old, new): a removed line by its old number, an added one by its new."""

    def work(key, old, new):
        return [(key, op, (j if op == "+" else i) + 1) for op, i, j in sequence.script(sequence.lines(old), sequence.lines(new))]

    return _per_row(texts, work, "key string, op string, line int")


def attributed(lines: DataFrame, old_extents: DataFrame, new_extents: DataFrame) -> DataFrame:
    """(key, id, added, removed): changed lines given to the shortest extent (key, id, first, last) around them on their side; lines in none have a null id."""
    sides = []
    for op, extents in (("-", old_extents), ("+", new_extents)):
        own = lines.where(F.col("op") == op)
        hit = own.join(extents, "key").where(F.col("line").between(F.col("first"), F.col("last")))
        near = hit.groupBy("key", "op", "line").agg(F.min_by("id", F.struct((F.col("last") - F.col("first")).alias("size"), "id")).alias("id"))
        sides.append(own.join(near, ["key", "op", "line"], "left").select("key", "id", "op"))
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    return sides[0].union(sides[1]).groupBy("key", "id").agg(n("+").alias("added"), n("-").alias("removed"))


def token_changes(texts: DataFrame, same: bool = True) -> DataFrame:
    """(key, n, op, token): the steps between the words and signs of rows (key, old, new), without those that stay unless `same`."""

    def work(key, old, new):
        a, b = _TOKEN.findall(old or ""), _TOKEN.findall(new or "")
        return ((key, n, op, b[j] if op == "+" else a[i]) for n, (op, i, j) in enumerate(sequence.script(a, b)) if same or op != " ")

    return _per_row(texts, work, "key string, n int, op string, token string")


def statement_changes(bodies: DataFrame) -> DataFrame:
    """(key, change, old_at, new_at, hash) of rows (key, old, new) of lists of statement hashes.

    A hash that goes once and comes once has moved.
    """

    def work(key, old, new):
        a, b = list(old if old is not None else []), list(new if new is not None else [])
        steps = sequence.script(a, b)
        gone: dict[str, list[int]] = {}
        came: dict[str, list[int]] = {}
        for op, i, j in steps:
            if op == "-":
                gone.setdefault(a[i], []).append(i)
            elif op == "+":
                came.setdefault(b[j], []).append(j)
        moved = {h for h, at in gone.items() if len(at) == 1 and len(came.get(h, [])) == 1}
        rows = [(key, "moved", gone[h][0], came[h][0], h) for h in sorted(moved)]
        rows += [(key, "removed", i, None, h) for h, at in sorted(gone.items()) if h not in moved for i in at]
        return rows + [(key, "added", None, j, h) for h, at in sorted(came.items()) if h not in moved for j in at]

    return _per_row(bodies, work, "key string, change string, old_at int, new_at int, hash string").select("key", "change", "old_at", "new_at", "hash")


def patches(files: DataFrame, context: int = 3) -> DataFrame:
    """(path, patch) of rows (path, old, new); unchanged files give none."""
    work = lambda key, old, new: [(key, p)] if (p := sequence.patch(key, old, new, context)) else []
    return _per_row(files.select(F.col("path").alias("key"), "old", "new"), work, "key string, patch string").withColumnRenamed("key", "path")


def hunks(patch_texts: DataFrame) -> DataFrame:
    """Hunks of rows (patch): paths, ranges and counts."""
    names = ["old_path", "new_path", "old_start", "old_lines", "new_start", "new_lines", "added", "removed"]

    def pages(batches):
        for pdf in batches:
            yield pd.DataFrame([h for p in pdf["patch"] for h in sequence.read_patch(p)], columns=names)

    return patch_texts.select("patch").mapInPandas(pages, "old_path string, new_path string, old_start int, old_lines int, new_start int, new_lines int, added int, removed int")


def since(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], roots: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that differ between the walks from the same roots over two versions, each (edges, nodes with id and fp).

    Nodes have the change and the least depth at which a version reaches them; edges have (source, target, change).
    """
    walks = [reachable(e, roots, depth, True) for e, _ in (before, after)]
    drawn = []
    for (edges, _), walk in zip((before, after), walks, strict=True):
        drawn.append(edges.join(walk.where(F.col("depth") < depth).select(F.col("id").alias("source")), "source", "left_semi").select("source", "target").distinct())
    side = lambda k: walks[k].join((before, after)[k][1].select("id", F.col("fp").alias(f"fp{k}")), "id", "left").select("id", F.col("depth").alias(f"depth{k}"), f"fp{k}")
    change = F.when(F.col("depth0").isNull(), "added").when(F.col("depth1").isNull(), "removed").when(~F.col("fp0").eqNullSafe(F.col("fp1")), "changed")
    nodes = side(0).join(side(1), "id", "full").select("id", change.alias("change"), F.least("depth0", "depth1").alias("depth")).where("change IS NOT NULL")
    lost, new = drawn[0].join(drawn[1], ["source", "target"], "left_anti"), drawn[1].join(drawn[0], ["source", "target"], "left_anti")
    return nodes, lost.withColumn("change", F.lit("removed")).union(new.withColumn("change", F.lit("added")))
