"""Versioned facts: effective state, generations and pruning over chains of snapshots."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

MOST_LINKS = 100_000


def chain(snapshots: DataFrame, head: int, most: int = MOST_LINKS) -> DataFrame:
    """(ordinal, depth): the snapshot and its bases.

    A base that isn't there, a cycle and more than `most` links are errors, so the chain
    is small by its bound and comes back as a local relation of known size.
    """
    found = kernels.chain(snapshots, head, most).toArrow()
    return snapshots.sparkSession.createDataFrame(pa.table({"ordinal": found.column("ordinal"), "depth": found.column("depth")}), "ordinal long, depth int")


def effective(deltas: DataFrame, links: DataFrame, *key: str) -> DataFrame:
    """The newest delta of each key along a chain (ordinal, depth); deletes go after that choice, not before."""
    rest = [c for c in deltas.columns if c not in key]
    newest = deltas.join(links, "ordinal").groupBy(*key).agg(F.min_by(F.struct(*rest), "depth").alias("x"))
    return newest.select(*key, *(F.col(f"x.{c}").alias(c) for c in rest)).where("op = 'set'").select(*deltas.columns)


def generations(deltas: DataFrame) -> DataFrame:
    """Deltas (ordinal, key, op, fp) of one chain with `generation`: it rises when a key is set anew or its content differs.

    Deletes of keys that were never set before are dropped.
    """
    by = Window.partitionBy("key").orderBy("ordinal")
    d = deltas.withColumn("was", F.lag("op").over(by)).withColumn("was_fp", F.lag("fp").over(by))
    rise = (F.col("op") == "set") & (F.col("was").isNull() | (F.col("was") == "delete") | (F.col("was_fp") != F.col("fp")))
    d = d.withColumn("generation", F.sum(rise.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("generation > 0").select("ordinal", "key", "op", "fp", "generation")


def symbol_history(generation: DataFrame) -> DataFrame:
    """Rows at which a key's generation exceeds all before."""
    before = Window.partitionBy("key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return generation.withColumn("m", F.max("generation").over(before)).where("m IS NULL OR generation > m").drop("m")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, op, fp): the deltas that lead from one effective state (key, fp) to another."""
    x, y = before.select("key", F.col("fp").alias("old")), after.select("key", F.col("fp").alias("new"))
    d = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "key", "full")
    d = d.withColumn("op", F.when(F.col("b").isNull(), "delete").when(F.col("a").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "set"))
    return d.where("op IS NOT NULL").select("key", "op", F.col("new").alias("fp"))


def stats(deltas: DataFrame) -> DataFrame:
    """Per snapshot: keys added, changed and deleted against the state before."""
    g = deltas.withColumn("was", F.lag("op").over(Window.partitionBy("key").orderBy("ordinal")))
    n = lambda c: F.count(F.when(c, 1))
    new = F.col("was").isNull() | (F.col("was") == "delete")
    return g.groupBy("ordinal").agg(n((F.col("op") == "set") & new).alias("added"), n((F.col("op") == "set") & ~new).alias("changed"), n((F.col("op") == "delete") & ~new).alias("deleted"))


def sizes(files: DataFrame, symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row of files, symbols, occurrences and bytes of a snapshot's frames."""
    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    return one.crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(occurrences.agg(F.count("*").alias("occurrences")))


def reconciled(stated: DataFrame, documents: DataFrame) -> DataFrame:
    """(package, stated, found) where the number of documents that a snapshot states for a package is not that of its documents (package)."""
    found = documents.groupBy("package").agg(F.count("*").alias("found"))
    both = stated.select("package", F.col("documents").alias("stated")).join(found, "package", "full")
    return both.select("package", F.coalesce("stated", F.lit(0)).cast("long").alias("stated"), F.coalesce("found", F.lit(0)).alias("found")).where("stated != found")


def kept_snapshots(snapshots: DataFrame, newest: int, pinned: DataFrame, depends: DataFrame | None = None) -> DataFrame:
    """Snapshots that a prune keeps: the newest ones and the pinned (heads), and whatever these depend on, each with its new base.

    depends (ordinal, on) is followed to its end.  A survivor's base is the nearest
    surviving ordinal below it.
    """
    keep = snapshots.orderBy(F.col("ordinal").desc()).limit(newest).select("ordinal").union(pinned.select("ordinal")).distinct()
    if depends is not None:
        from .traverse import Rounds

        cut = Rounds(snapshots.sparkSession).cut
        new = keep = cut(keep)
        while new.limit(1).count():
            new = cut(depends.join(new, "ordinal").select(F.col("on").alias("ordinal")).distinct().join(keep, "ordinal", "left_anti"))
            keep = cut(keep.union(new))
        keep = keep.join(snapshots.select("ordinal"), "ordinal", "left_semi")
    # snapshots are rows of a register, and one task orders them
    return keep.withColumn("new_base", F.lag("ordinal").over(Window.orderBy("ordinal")))


def rebased(deltas: DataFrame, kept: DataFrame) -> DataFrame:
    """Deltas (ordinal, key, ...) of kept snapshots (ordinal) alone: each survivor takes the newest delta of a key since the survivor before it."""
    edges = kept.select("ordinal").distinct().orderBy("ordinal")
    # the survivor at or after each ordinal: a merge over the ordinals alone, which are few
    every = deltas.select("ordinal").distinct().withColumn("kept", F.lit(None).cast("long")).union(edges.select("ordinal", F.col("ordinal").alias("kept")))
    at = every.groupBy("ordinal").agg(F.max("kept").alias("kept")).withColumn("to", F.min("kept").over(Window.orderBy("ordinal").rowsBetween(0, Window.unboundedFollowing))).where("to IS NOT NULL").select("ordinal", "to")
    rest = [c for c in deltas.columns if c not in ("ordinal", "key")]
    newest = deltas.join(at, "ordinal").groupBy("to", "key").agg(F.max_by(F.struct(*rest), "ordinal").alias("x"))
    return newest.select(F.col("to").alias("ordinal"), "key", *(F.col(f"x.{c}").alias(c) for c in rest)).select(*deltas.columns)


def orphans(stored: DataFrame, *users: DataFrame) -> DataFrame:
    """Stored rows (id, ...) that no frame (id) of users names."""
    for u in users:
        stored = stored.join(u.select("id"), "id", "left_anti")
    return stored


def dense_numbers(items: DataFrame, *group: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Numbers within each group in input order: from 1, or on from the greatest number that `taken` (group, item, number) has.

    Items that have a number there keep it; `order` names the item.
    """
    if taken is None:
        return items.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(order)))
    known = items.join(taken.select(*group, order, "number"), [*group, order])
    last = taken.groupBy(*group).agg(F.max("number").alias("last"))
    fresh = items.join(taken.select(*group, order), [*group, order], "left_anti").join(last, list(group), "left")
    number = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return known.select(*items.columns, F.col("number").cast("int").alias("number")).union(fresh.select(*items.columns, number.cast("int").alias("number")))


def fold_fingerprints(triples: DataFrame, key: str, *layers: str) -> DataFrame:
    """One value a layer for each key: its only distinct tuple's own, else the first eight bytes of a SHA-256 over the sorted tuples' big-endian values."""
    every = triples.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*layers))).alias("t"))

    def folded(layer: str) -> Column:
        text = F.array_join(F.transform("t", lambda x: F.lpad(F.hex(x[layer]), 16, "0")), "")
        return F.when(F.size("t") == 1, F.col("t")[0][layer]).otherwise(F.conv(F.substring(F.sha2(F.unhex(text), 256), 1, 16), 16, -10).cast("long")).alias(layer)

    return every.select(key, *(folded(x) for x in layers))


def unseen(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents (root, path, digest, ...) whose content is not stored yet under their root and path."""
    return documents.join(stored.select("root", "path", "digest").distinct(), ["root", "path", "digest"], "left_anti").select(*documents.columns)


def carry_forward(rows: DataFrame, base: int, snapshot: int) -> DataFrame:
    """The base's rows under a snapshot that has no deltas of its own."""
    return rows.where(F.col("snapshot") == base).withColumn("snapshot", F.lit(snapshot).cast("long"))


def symbol_deltas(before: DataFrame, after: DataFrame, changed_packages: DataFrame) -> DataFrame:
    """(key, op, fp, generation) of declarations (key, package, fp) against the base's (key, package, fp, generation): what the changed packages set and delete.

    A key that is new or whose content changed goes up by one; a delete keeps its last generation.
    """
    inside = lambda d: d.join(changed_packages.select("package").distinct(), "package", "left_semi")
    a = inside(before).select("key", F.col("fp").alias("old"), F.col("generation").alias("was"), F.lit(1).alias("a"))
    b = inside(after).select("key", F.col("fp").alias("new"), F.lit(1).alias("b"))
    op = F.when(F.col("b").isNull(), "delete").when(F.col("a").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "set")
    d = a.join(b, "key", "full").withColumn("op", op).where("op IS NOT NULL")
    generation = F.coalesce("was", F.lit(0)) + F.when(F.col("op") == "set", 1).otherwise(0)
    return d.select("key", "op", F.col("new").alias("fp"), generation.cast("long").alias("generation"))


def current_generations(deltas: DataFrame) -> DataFrame:
    """(key, generation, fp) of the keys whose newest delta sets them."""
    last = generations(deltas).groupBy("key").agg(F.max_by(F.struct("op", "generation", "fp"), "ordinal").alias("x"))
    return last.where("x.op = 'set'").select("key", F.col("x.generation").alias("generation"), F.col("x.fp").alias("fp"))


def coalesce_types(nodes: DataFrame) -> DataFrame:
    """Type nodes (module, package, name, members, source) of one name as one, members in the order of their sources."""
    parts = F.array_sort(F.collect_list(F.struct("source", "members")))
    return nodes.groupBy("module", "package", "name").agg(F.flatten(F.transform(parts, lambda x: x["members"])).alias("members"))
