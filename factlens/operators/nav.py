"""Navigation: witness rows of a set of symbols, each an equi-join on a symbol id.

A witness has the projected symbol `proj` (null if unresolved), the site and its role.
Targets are frames with a column `id`; joins are left to the optimizer, which broadcasts
a small side only by its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.sources.facts import Facts

SITE = ("symbol_id", "enclosing_id", "role", "path", "package", "line", "column", "target_name")
WITNESS = ("proj", *SITE, "dispatch", "depth")


def _rows(df: DataFrame, proj: str, dispatch: bool = False) -> DataFrame:
    return df.select(F.col(proj).alias("proj"), *SITE, F.lit(dispatch).alias("dispatch"), F.lit(1).alias("depth"))


def _occ(facts: Facts, targets: DataFrame, key: str = "symbol_id") -> DataFrame:
    ids = targets.select(F.col("id").alias(key)).distinct()
    return facts.occurrences.join(ids, key, "left_semi").select(*SITE)


def interface_methods(facts: Facts, own: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """(method_id, interface_method_id): methods of equal name and parameters of a type and an interface it implements.

    `own` and `of` (id) keep the pairs of those methods and interface methods alone.
    """
    m = facts.symbols.where("kind = 'method'").select("id", "owner_id", "name", "params")
    take = lambda d, ids: d if ids is None else d.join(ids.select("id"), "id", "left_semi")
    mine = take(m, own).select(F.col("id").alias("method_id"), F.col("owner_id").alias("type_id"), "name", "params")
    theirs = take(m, of).select(F.col("id").alias("interface_method_id"), F.col("owner_id").alias("interface_id"), "name", "params")
    return mine.join(facts.implements, "type_id").join(theirs, ["interface_id", "name", "params"]).select("method_id", "interface_method_id").distinct()


def definitions(facts: Facts, targets: DataFrame) -> DataFrame:
    return facts.symbols.join(targets.select("id").distinct(), "id", "left_semi")


def callers(facts: Facts, targets: DataFrame) -> DataFrame:
    """Calls of the targets, and calls of interface methods that a target implements (dispatch)."""
    calls = facts.occurrences.where("role = 'call'")
    direct = _rows(calls.join(targets.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi"), "enclosing_id")
    via = interface_methods(facts, own=targets).select(F.col("interface_method_id").alias("symbol_id")).distinct()
    return direct.union(_rows(calls.join(via, "symbol_id", "left_semi"), "enclosing_id", True))


def callees(facts: Facts, targets: DataFrame) -> DataFrame:
    """Calls in the bodies of the targets; unresolved ones stay with a null symbol."""
    ids = targets.select(F.col("id").alias("enclosing_id")).distinct()
    return _rows(facts.occurrences.where("role = 'call'").join(ids, "enclosing_id", "left_semi"), "symbol_id")


def references(facts: Facts, targets: DataFrame) -> DataFrame:
    return _rows(_occ(facts, targets).where("role != 'definition'"), "symbol_id")


def reads(facts: Facts, targets: DataFrame) -> DataFrame:
    return _rows(_occ(facts, targets).where("role = 'reference'"), "symbol_id")


def writes(facts: Facts, targets: DataFrame) -> DataFrame:
    return _rows(_occ(facts, targets).where("role = 'write'"), "symbol_id")


def uses(facts: Facts, targets: DataFrame) -> DataFrame:
    """Resolved symbols that occur in the bodies of the targets, without what the targets declare themselves.

    A body is what names the target as enclosing, and what stands within its extent.
    """
    ids = targets.select("id").distinct()
    inner = facts.symbols.where("owner_id IS NOT NULL").select(F.col("owner_id").alias("body"), F.col("id").alias("symbol_id"))
    occ = facts.occurrences.where("role != 'definition' AND symbol_id IS NOT NULL")
    extent = facts.extents.join(ids.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi").select(F.col("symbol_id").alias("body"), F.col("path").alias("at"), F.col("start").alias("from_"), F.col("stop").alias("to_"))
    within = occ.join(extent, (F.col("path") == F.col("at")) & (F.col("start") >= F.col("from_")) & (F.col("stop") <= F.col("to_")) & ~F.col("enclosing_id").eqNullSafe(F.col("body")))
    named = occ.join(ids.withColumnRenamed("id", "body"), F.col("enclosing_id") == F.col("body"))
    body = named.select(*SITE, "body").unionByName(within.select(*SITE, "body"))
    return _rows(body.join(inner, ["body", "symbol_id"], "left_anti"), "symbol_id")


def _declared(facts: Facts, ids: DataFrame) -> DataFrame:
    """Witnesses of declarations: a column `proj` of ids."""
    none = F.lit(None).cast("string")
    return ids.select("proj").distinct().select("proj", F.col("proj").alias("symbol_id"), none.alias("enclosing_id"), F.lit("definition").alias("role"), none.alias("path"), none.alias("package"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), none.alias("target_name"), F.lit(False).alias("dispatch"), F.lit(1).alias("depth"))


def methods(facts: Facts, targets: DataFrame) -> DataFrame:
    ids = targets.select(F.col("id").alias("owner_id")).distinct()
    return _declared(facts, facts.symbols.where("kind = 'method'").join(ids, "owner_id", "left_semi").select(F.col("id").alias("proj")))


def implementers(facts: Facts, targets: DataFrame) -> DataFrame:
    ids = targets.select(F.col("id").alias("interface_id")).distinct()
    return _declared(facts, facts.implements.join(ids, "interface_id", "left_semi").select(F.col("type_id").alias("proj")))


def inheritors(facts: Facts, targets: DataFrame) -> DataFrame:
    ids = targets.select(F.col("id").alias("embedded")).distinct()
    return _declared(facts, facts.embeds.join(ids, "embedded", "left_semi").select(F.col("id").alias("proj")))


def incoming(facts: Facts, targets: DataFrame, via: str | None = None) -> DataFrame:
    """(source_id, target_id, kind, path, line, resolution): relationships that end in a target; `via` lists kinds."""
    r = native(facts, via).select("source_id", F.explode("targets").alias("target_id"), "kind", "path", "line", "resolution")
    return r.join(targets.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id", "kind", "path", "line", "resolution")


def outgoing(facts: Facts, targets: DataFrame, via: str | None = None) -> DataFrame:
    """The same from a target's side; a relationship without targets is one row with a null target."""
    r = native(facts, via).join(targets.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return r.select("source_id", F.explode_outer("targets").alias("target_id"), "kind", "path", "line", "resolution")


def native(facts: Facts, via: str | None = None) -> DataFrame:
    """Relationships of the kinds that the comma list `via` names, or of all."""
    kinds = [k.strip() for k in (via or "").split(",") if k.strip()]
    return facts.relationships.where(F.col("kind").isin(kinds)) if kinds else facts.relationships


def native_edges(facts: Facts, via: str) -> DataFrame:
    """(source, target) of relationships of these kinds."""
    return native(facts, via).select(F.col("source_id").alias("source"), F.explode("targets").alias("target")).distinct()


def call_candidates(facts: Facts, name: str) -> DataFrame:
    """Call sites by the name they call, resolved or not."""
    return facts.occurrences.where((F.col("role") == "call") & (F.col("target_name") == name)).dropDuplicates(["path", "line", "column", "enclosing_id", "target_name"]).select(*SITE)


def implementations(facts: Facts, targets: DataFrame) -> DataFrame:
    """Methods that a call of a target, an interface's method, may reach."""
    return _declared(facts, interface_methods(facts, of=targets).select(F.col("method_id").alias("proj")))


def find_references(facts: Facts, targets: DataFrame) -> DataFrame:
    """One occurrence of the targets at each position; a definition goes before other roles, then the role's name."""
    best = F.min_by(F.struct(*SITE), F.struct(F.col("role") != "definition", F.col("role"), F.col("symbol_id"), F.col("enclosing_id")))
    return _occ(facts, targets).groupBy("path", "line", "column").agg(best.alias("x")).select(*(F.col(f"x.{c}") for c in SITE))


def projected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, omitted): the distinct symbols that witnesses project, and how many of the rows project none."""
    return rows.where("proj IS NOT NULL").select(F.col("proj").alias("id")).distinct(), rows.agg(F.count(F.when(F.col("proj").isNull(), 1)).alias("omitted"))


def file_graph(facts: Facts, paths: Column) -> DataFrame:
    """(id, enclosing_id, path, line, target_name, resolved): the calls in files of these paths, resolved or not."""
    return facts.occurrences.where((F.col("role") == "call") & paths).select(F.col("symbol_id").alias("id"), "enclosing_id", "path", "line", "target_name", F.col("symbol_id").isNotNull().alias("resolved"))


# The coarse types that a kind of relationship may have.
COARSE = ("import", "call", "reference", "inheritance", "implements", "includes", "foreign_key", "read", "write", "dispatch")


def coarse(relationships: DataFrame, types: dict[str, str]) -> DataFrame:
    """Relationships with the coarse `type` of their kind; a kind that isn't registered, or has no such type, is an error."""
    if wrong := sorted(k for k, t in types.items() if t not in COARSE):
        raise ValueError(f"no coarse type: {', '.join(wrong)}")
    known = F.lit(None).cast("string")
    for kind, t in types.items():
        known = F.when(F.col("kind") == kind, t).otherwise(known)
    return relationships.withColumn("type", F.coalesce(known, F.raise_error(F.concat(F.lit("a kind of relationship that isn't registered: "), F.col("kind"))).cast("string")))


#: Categories of symbols that a relation applies to; the others take all but containers.
APPLIES = {"callees": ("callable",), "implementers": ("type",), "inheritors": ("type",), "methods": ("type",)}


def applicable(facts: Facts, relation: str, targets: DataFrame) -> DataFrame:
    """The targets (id, kind) that a relation applies to; if it applies to none of some, that is an error."""
    takes = APPLIES.get(relation, ("callable", "type", "data"))
    fit = targets.where(F.col("kind").isin(facts.kinds_in(*takes)))
    if not fit.limit(1).count() and targets.limit(1).count():
        raise ValueError(f"{relation} applies to none of these symbols")
    return fit


RELATIONS = {"callers": callers, "callees": callees, "references": references, "reads": reads, "writes": writes, "methods": methods, "implementers": implementers, "inheritors": inheritors, "uses": uses}
