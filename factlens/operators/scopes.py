"""Scopes: which snapshot of which location a question is about.

A registry has locations (root, location), heads (location, snapshot) and primaries
(root, location).  Rows that carry `root` and `snapshot` can be aligned and intersected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    locations: DataFrame
    heads: DataFrame
    primaries: DataFrame

    def select(self, roots: list[str] | None = None, locations: list[str] | None = None, snapshots: list[int] | None = None) -> DataFrame:
        """(root, location, snapshot) of the scopes asked for; with nothing asked, the primary head of every root."""
        every = self.locations.join(self.heads, "location").select("root", "location", "snapshot")
        if snapshots:
            return every.where(F.col("snapshot").isin(snapshots))
        if locations:
            return every.where(F.col("location").isin(locations))
        primary = every.join(self.primaries.select("root", "location"), ["root", "location"], "left_semi")
        return primary.where(F.col("root").isin(roots)) if roots else primary

    def missing_heads(self) -> DataFrame:
        """Registered locations without a head."""
        return self.locations.join(self.heads, "location", "left_anti").select("root", "location")

    def listing(self) -> DataFrame:
        """Each location with its head, if any, and whether it is its root's primary."""
        own = self.primaries.select("root", "location", F.lit(True).alias("primary"))
        return self.locations.join(self.heads, "location", "left").join(own, ["root", "location"], "left").select("root", "location", "snapshot", F.coalesce("primary", F.lit(False)).alias("is_primary"))


def align(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows (symbol_id, root, snapshot, ...) in the snapshots that selected their symbol; a root that selected none of it keeps its rows."""
    at = selected.select("symbol_id", "root", "snapshot").distinct()
    bound = at.select("symbol_id", "root").distinct()
    inside = rows.join(at, ["symbol_id", "root", "snapshot"], "left_semi")
    return inside.select(*rows.columns).unionByName(rows.join(bound, ["symbol_id", "root"], "left_anti").select(*rows.columns))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, root, snapshot) selected on both sides in the same scope; symbols whose scopes don't meet drop out."""
    return a.select("id", "root", "snapshot").distinct().join(b.select("id", "root", "snapshot").distinct(), ["id", "root", "snapshot"], "left_semi")


def own_root(symbols: DataFrame, defined: DataFrame) -> DataFrame:
    """Symbols that are defined in the root of their own module: defined has (root, symbol_id)."""
    at = defined.select(F.col("symbol_id").alias("id"), F.col("root").alias("module")).distinct()
    return symbols.join(at, ["id", "module"], "left_semi").select(*symbols.columns)


def in_scope(rows: DataFrame, modules: list[str] = (), packages: list[str] = ()) -> DataFrame:
    """Rows (module, package) inside any of the modules or package trees: a test, not a set of symbols."""
    inside = F.col("module").isin(list(modules))
    for p in packages:
        inside = inside | (F.col("package") == p) | F.col("package").startswith(f"{p}/")
    return rows.where(inside)


def active(symbols: DataFrame, occurrences: DataFrame, implements: DataFrame) -> DataFrame:
    """Symbols that are defined, referenced or implemented in the scope of the other frames."""
    seen = occurrences.select(F.col("symbol_id").alias("id")).union(implements.select("interface_id")).union(implements.select("type_id")).where("id IS NOT NULL").distinct()
    return symbols.join(seen, "id", "left_semi")


def preferred(rows: DataFrame, declarations: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (symbol_id, snapshot, ...) with `declared_at`: their own snapshot if it declares the symbol, else the first that does, else null.

    With `strict` several others are an error, as none of them is the row's.
    """
    d = declarations.select("symbol_id", F.col("snapshot").alias("there")).distinct()
    first = d.groupBy("symbol_id").agg(F.min("there").alias("first"), F.count("*").alias("several"))
    if strict:
        ambiguous = F.raise_error(F.concat(F.lit("several snapshots declare "), F.col("symbol_id"))).cast("long")
        first = first.withColumn("first", F.when(F.col("several") == 1, F.col("first")))
    own = d.select("symbol_id", F.col("there").alias("snapshot"), F.col("there").alias("own"))
    return rows.join(own, ["symbol_id", "snapshot"], "left").join(first, "symbol_id", "left").select(*rows.columns, F.coalesce("own", "first", *([F.when(F.col("several") > 1, ambiguous)] if strict else [])).alias("declared_at"))


def dependencies(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """(root, needs): the other modules whose symbols a root's files refer to."""
    used = occurrences.where("symbol_id IS NOT NULL").select(F.split("package", "/")[0].alias("root"), "symbol_id").distinct()
    return used.join(symbols.select(F.col("id").alias("symbol_id"), F.col("module").alias("needs")), "symbol_id").where("root != needs").select("root", "needs").distinct()
