"""Differences between two versions of symbols, of trees and of texts."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.glob import match_list

from .traverse import Rounds


def classify(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change) of rows (key, package, public_fp, private_fp, content_fp) that differ: the first that applies."""
    a, b = (x.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("package", "public_fp", "private_fp", "content_fp")), F.lit(1).alias(p)) for x, p in ((before, "a"), (after, "b")))
    differs = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differs("public_fp"), "signature").when(differs("private_fp"), "structure").when(differs("content_fp"), "body").when(differs("package"), "moved")
    return a.join(b, "key", "full").select("key", change.alias("change")).where("change IS NOT NULL")


def unique_matches(before: DataFrame, after: DataFrame, *on: str) -> DataFrame:
    """(old, new) of rows (key, ...) whose values are unique on both sides, and not null."""
    filled = " AND ".join(f"{c} IS NOT NULL" for c in on)
    x, y = (d.where(filled).groupBy(*on).agg(F.count("*").alias("n"), F.min("key").alias(name)).where("n = 1").drop("n") for d, name in ((before, "old"), (after, "new")))
    return x.join(y, list(on)).select("old", "new")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Moves between packages: of the rows (key, package, kind, name, shape) on one side only, unique by kind, name and shape."""
    gone, came = before.join(after, "key", "left_anti"), after.join(before, "key", "left_anti")
    pair = unique_matches(gone, came, "kind", "name", "shape")
    where = lambda d, k, p: d.select(F.col("key").alias(k), F.col("package").alias(p))
    return pair.join(where(gone, "old", "p0"), "old").join(where(came, "new", "p1"), "new").where("p0 != p1").select("old", "new")


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Renames: of the rows (key, package, kind, name, shape) on one side only, unique by package, kind and shape, with another name."""
    gone, came = before.join(after, "key", "left_anti"), after.join(before, "key", "left_anti")
    pair = unique_matches(gone, came, "package", "kind", "shape")
    name = lambda d, k, n: d.select(F.col("key").alias(k), F.col("name").alias(n))
    return pair.join(name(gone, "old", "n0"), "old").join(name(came, "new", "n1"), "new").where("n0 != n1").select("old", "new")


def renamed_children(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(old, new) of the members of renamed owners (old, new): rows (key, owner, kind, name) that have one kind and name on both sides, each once."""
    a = before.join(pairs.select(F.col("old").alias("owner"), F.col("new").alias("to")), "owner")
    b = after.join(pairs.select(F.col("new").alias("owner")), "owner", "left_semi").withColumn("to", F.col("owner"))
    return unique_matches(a, b, "to", "kind", "name")


def tree_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(old, new, by) of tree nodes (key, uuid, symbol, hash): passes by uuid, symbol and hash, unique keys only, each over what is left.

    A pass counts both sides in one aggregation; its matches are written before the next.
    """
    cut = Rounds(a.sparkSession).cut
    cols = ("key", "uuid", "symbol", "hash")
    left = a.select(*cols, F.lit(0).alias("side")).union(b.select(*cols, F.lit(1)))
    out: list[DataFrame] = []
    for c in ("uuid", "symbol", "hash"):
        on = [F.when(F.col("side") == k, F.col("key")) for k in (0, 1)]
        both = left.where(F.col(c).isNotNull()).groupBy(c).agg(*(F.count(x).alias(f"n{k}") for k, x in enumerate(on)), F.min(on[0]).alias("old"), F.min(on[1]).alias("new"))
        found = both.where("n0 = 1 AND n1 = 1").select("old", "new", F.lit(c).alias("by"))
        out.append(found if c == "hash" else cut(found))
        used = out[-1].select(F.col("old").alias("key"), F.lit(0).alias("side")).union(out[-1].select("new", F.lit(1)))
        left = left.join(used, ["key", "side"], "left_anti").select(*cols, "side")
    return out[0].union(out[1]).union(out[2])


def tree_layers(nodes: DataFrame) -> DataFrame:
    """(id, public, private, content) of tree nodes (id, parent, kind, name, visibility, body, depth): hashes of a node and all below it.

    The public layer takes public nodes alone, the private one all, and the content their
    bodies too.  Children are taken from the deepest level up, in the order of their hash.
    """
    cut = Rounds(nodes.sparkSession).cut
    last = nodes.agg(F.max("depth")).first()[0]
    digest = lambda *parts: F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(",")) for p in parts)).cast("binary"), 256)
    done: DataFrame | None = None
    below: DataFrame | None = None
    for k in range(last if last is not None else -1, -1, -1):
        here = nodes.where(F.col("depth") == k)
        if below is not None:
            inner = below.groupBy("parent").agg(*(F.array_join(F.array_sort(F.collect_list(c)), ",").alias(f"c_{c}") for c in ("public", "private", "content")))
            here = here.join(inner.withColumnRenamed("parent", "id"), "id", "left")
        else:
            here = here.select("*", *(F.lit("").alias(f"c_{c}") for c in ("public", "private", "content")))
        head = [F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit(""))]
        inside = {c: F.coalesce(F.col(f"c_{c}"), F.lit("")) for c in ("public", "private", "content")}
        public = F.when(F.col("visibility") == "public", digest(*head, inside["public"]))
        layer = cut(here.select("id", "parent", public.alias("public"), digest(*head, F.coalesce("visibility", F.lit("")), inside["private"]).alias("private"), digest(*head, F.coalesce("body", F.lit("")), inside["content"]).alias("content")))
        below = layer
        done = layer if done is None else done.union(layer)
    out = ("id", "public", "private", "content")
    return nodes.sparkSession.createDataFrame([], "id string, public string, private string, content string") if done is None else done.select(*out)


def tree_find(nodes: DataFrame, kinds: list[str] = (), not_kinds: list[str] = (), name: str | None = None, depth: int | None = None, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Tree nodes (id, kind, name, depth) by kind, name pattern, greatest depth and a condition, the first `limit` in the order of depth and id."""
    out = nodes.where(F.col("kind").isin(list(kinds))) if kinds else nodes
    out = out.where(~F.col("kind").isin(list(not_kinds))) if not_kinds else out
    out = out.where(match_list(F.col("name"), name)) if name is not None else out
    out = out.where(F.col("depth") <= depth) if depth is not None else out
    out = out.where(where) if where is not None else out
    return out.orderBy("depth", "id").limit(limit) if limit is not None else out


def node_publication(nodes: DataFrame) -> DataFrame:
    """Symbols (id, module, package, kind, owner_id, name, visibility) of tree nodes (id, parent, kind, name, module, package, visibility): containers are no symbols, and nobody's owner."""
    held = nodes.where(~F.col("kind").isin("module", "package", "file"))
    owner = held.select(F.col("id").alias("parent"), F.col("id").alias("owner_id"))
    return held.join(owner, "parent", "left").select("id", "module", "package", "kind", "owner_id", "name", "visibility")


def plain_shape(shape: Column, *packages: Column) -> Column:
    """A declaration's shape without the qualifiers of these packages, so that a moved one has the shape it had."""
    for p in packages:
        shape = F.regexp_replace(shape, F.concat(F.lit(r"\b"), F.regexp_replace(F.substring_index(p, "/", -1), r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\.")), F.lit(""))
    return shape


def shown(changes: DataFrame, visibility: str = "all", kinds: list[str] = ()) -> DataFrame:
    """Changes (change, visibility, ...) of the kinds asked for; `exported` shows what is public, and no change of structure."""
    if visibility not in ("all", "exported", "private"):
        raise ValueError("a visibility is all, exported or private")
    out = changes.where(F.col("change").isin(list(kinds))) if kinds else changes
    if visibility == "exported":
        return out.where((F.col("visibility") == "public") & (F.col("change") != "structure"))
    return out.where(F.col("visibility") != "public") if visibility == "private" else out


def paired(before: DataFrame, after: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with one key on both sides, the k-th with the k-th."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return before.withColumn("nth", nth).join(after.withColumn("nth", nth).withColumnRenamed(order, f"new_{order}"), [key, "nth"], "full")


def imports_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, alias, change) of import rows (path, alias, target)."""
    j = before.withColumnRenamed("target", "t0").join(after.withColumnRenamed("target", "t1"), ["path", "alias"], "full")
    return j.where("NOT (t0 <=> t1)").select("path", "alias", F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed").otherwise("changed").alias("change"))


def kept_order(old: list[str], new: list[str]) -> set[str]:
    """Members that stay in order: a longest increasing run of the old positions in the new order."""
    at = {c: i for i, c in enumerate(old)}
    both = [c for c in new if c in at]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, c in enumerate(both):
        k = bisect.bisect_left(tails, at[c])
        tails[k : k + 1] = [at[c]]
        ends[k : k + 1] = [i]
        back.append(ends[k - 1] if k else -1)
    out, i = set(), ends[-1] if ends else -1
    while i >= 0:
        out.add(both[i])
        i = back[i]
    return out


def reordered(tables: DataFrame) -> DataFrame:
    """(name, member) of rows (name, old, new) of member lists: those that moved against the rest."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, old, new in zip(pdf["name"], pdf["old"], pdf["new"], strict=True):
            stay, was = kept_order(list(old), list(new)), set(old)
            rows += [(name, c) for c in new if c in was and c not in stay]
        return pd.DataFrame(rows, columns=["name", "member"])

    return tables.mapInPandas(lambda it: map(work, it), "name string, member string")
