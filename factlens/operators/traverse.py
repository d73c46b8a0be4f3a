"""Traversal over an edge frame (source, target).

A graph whose edges are few by count is walked in one task (see `kernels`).  A larger one
takes rounds of a join of the frontier and an anti-join with what is seen; each round is
written to the folder that the cluster shares, so that it does not repeat the ones before
it and outlives a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.sources.shared import folder

from . import kernels

MOST_DEPTH, MOST_SYMBOLS = 8, 10_000


class Rounds:
    """Frames of one traversal, cut off from their lineage."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, "", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.root = self.root or folder(self.spark, "rounds")
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 3, include_roots: bool = False, most: int | None = None) -> DataFrame:
    """(id, depth): every symbol within `depth` hops of a root with its least number of hops; roots never come back.

    More than `most` symbols are an error.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"a depth from 1 to {MOST_DEPTH}")
    if kernels.fits(edges):
        return kernels.reachable(edges, roots, depth, include_roots, most)
    cut = Rounds(edges.sparkSession).cut
    edges = cut(edges.select("source", "target").distinct())
    seen = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    out = seen if include_roots else seen.where("depth > 0")
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"the walk reaches more than {most} symbols")
    return out


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def shortest_path(edges: DataFrame, start: DataFrame, end: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(hop, id) of one shortest path from the start (id) to the nearest of the end (id), empty if there is none; the smallest parent at each step."""
    if kernels.fits(edges):
        return kernels.paths_to(edges, start, end, depth, True).select("hop", "id")
    every = paths_to(edges, start, end, depth)
    best = every.where(F.col("id") == F.col("target")).orderBy("hop", "target").limit(1).select(F.col("target").alias("best"))
    return every.join(best, F.col("target") == F.col("best"), "left_semi").select("hop", "id")


def signed(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(id, depth) of walks down and up: depth is signed, the nearer way stays, of equal ones the one up."""
    if direction not in ("both", "out", "in"):
        raise ValueError("a direction is both, out or in")
    if kernels.fits(edges):
        return kernels.both_ways(edges, roots, depth, direction != "in", direction != "out")
    start = roots.select("id").distinct().withColumn("depth", F.lit(0))
    down = reachable(edges, roots, depth) if direction != "in" else start.limit(0)
    up = reachable(reverse(edges), roots, depth).select("id", (-F.col("depth")).alias("depth")) if direction != "out" else start.limit(0)
    return start.union(down).union(up).groupBy("id").agg(F.min_by("depth", F.struct(F.abs("depth"), F.col("depth"))).alias("depth"))


def graph(edges: DataFrame, roots: DataFrame, depth: int = 2, nodes: int = 150, direction: str = "both") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted) of a bounded walk: depth is signed, the nearest nodes stay, ties by id."""
    cut = Rounds(edges.sparkSession).cut
    every = cut(signed(edges, roots, depth, direction))
    kept = every.orderBy(F.abs("depth"), "depth", "id").limit(nodes)
    drawn = edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")
    counts = every.agg(F.greatest(F.count("*") - nodes, F.lit(0)).alias("node_limit"))
    return kept, drawn, counts


#: Groups of nodes that a graph leaves out by default.
EXCLUDED = ("std", "builtin")


def excluded_ids(groups: DataFrame, patterns: tuple[str, ...] = EXCLUDED, modules: tuple[str, ...] = ()) -> DataFrame:
    """(id, grp) of nodes (id, grp) whose group is named, or lies below a `path/...`.

    `external` takes what lies in none of the `modules`; `none` alone takes nothing.  An
    empty or repeated pattern, or `none` with others, is an error.
    """
    if any(not p for p in patterns) or len(set(patterns)) < len(patterns) or ("none" in patterns and len(patterns) > 1):
        raise ValueError("exclusions are distinct names, and `none` stands alone")
    inside = lambda tree: (F.col("grp") == tree) | F.col("grp").startswith(f"{tree}/")
    hit = F.lit(False)
    for p in () if "none" in patterns else patterns:
        if p == "external":
            own = F.lit(False)
            for m in modules:
                own = own | inside(m)
            hit = hit | ~F.coalesce(own, F.lit(False))
        else:
            tree = p.removesuffix("/...")
            hit = hit | (inside(tree) if tree != p else F.col("grp") == tree)
    return groups.where(hit).select("id", "grp")


def without(nodes: DataFrame, kinds: tuple[str, ...] = (), groups: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (kind, grp, ...) whose kind and group match none of these whole-value patterns with `*`, whatever their case."""
    for column, patterns in (("kind", kinds), ("grp", groups)):
        for p in patterns:
            nodes = nodes.where(~F.coalesce(F.lower(F.col(column)).rlike("^" + ".*".join(map(_literal, p.lower().split("*"))) + "$"), F.lit(False)))
    return nodes


def _literal(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == "_") else c for c in text)


def bounded_graph(edges: DataFrame, roots: DataFrame, groups: DataFrame, depth: int = 2, nodes: int = 150, exclude: tuple[str, ...] = EXCLUDED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted): a walk down that neither draws nor passes excluded groups, with what is left out counted.

    `omitted` has (reason, grp, n): excluded nodes next to a drawn one, nodes over the
    node limit, and edges that lead from the last depth to nodes beyond it.
    """
    out = excluded_ids(groups, exclude)
    ids = lambda d, k: d.select(F.col("id").alias(k))
    inner = edges.join(ids(out, "target"), "target", "left_anti").join(ids(out, "source"), "source", "left_anti").select("source", "target")
    cut = Rounds(edges.sparkSession).cut
    every = cut(reachable(inner, roots, depth, True))
    kept = cut(every.orderBy("depth", "id").limit(nodes))
    drawn = inner.join(ids(kept, "source"), "source", "left_semi").join(ids(kept, "target"), "target", "left_semi").select("source", "target")
    count = lambda d, why: d.join(groups, "id", "left").groupBy("grp").agg(F.count("*").alias("n")).select(F.lit(why).alias("reason"), "grp", "n")
    beside = edges.join(ids(kept, "source"), "source", "left_semi").join(ids(out, "target"), "target", "left_semi").select(F.col("target").alias("id")).distinct()
    beyond = inner.join(ids(kept.where(F.col("depth") == depth), "source"), "source", "left_semi").join(ids(every, "target"), "target", "left_anti").select(F.col("target").alias("id"))
    return kept, drawn, count(beside, "excluded").union(count(every.join(kept.select("id"), "id", "left_anti"), "node_limit")).union(count(beyond, "beyond_depth"))


def access_edges(steps: DataFrame, *access: str) -> DataFrame:
    """Steps (source, target, role, ...) of the named kinds of access: call (with dispatch), read, write; none named takes all."""
    role = {"call": ["call", "dispatch"], "read": ["reference"], "write": ["write"]}
    return steps.where(F.col("role").isin([r for a in access for r in role[a]])) if access else steps


def forward_edges(calls: DataFrame, implementations: DataFrame) -> DataFrame:
    """(source, target, dispatch): calls (source, target), and for a called interface method its implementations (method_id, interface_method_id)."""
    direct = calls.where("target IS NOT NULL").select("source", "target", F.lit(False).alias("dispatch"))
    via = implementations.select(F.col("interface_method_id").alias("target"), "method_id")
    return direct.union(calls.join(via, "target").select("source", F.col("method_id").alias("target"), F.lit(True).alias("dispatch"))).distinct()


def paths_to(edges: DataFrame, roots: DataFrame, targets: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(target, hop, id): for each target in reach one shortest path from any root, the smallest parent at each step."""
    if kernels.fits(edges):
        return kernels.paths_to(edges, roots, targets, depth, False)
    cut = Rounds(edges.sparkSession).cut
    level = cut(roots.select("id", F.lit(None).cast("string").alias("parent")).distinct())
    levels, seen = [level], level.select("id")
    while len(levels) <= depth:
        step = edges.join(level.select(F.col("id").alias("source")), "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        level = cut(step.join(seen, "id", "left_anti"))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = seen.union(level.select("id"))
    # from the last level to the roots: targets of a level start there, the others come from below
    goal = targets.select(F.col("id").alias("goal")).distinct()
    rows, at = [], None
    for hop in range(len(levels) - 1, -1, -1):
        here = levels[hop].join(goal, F.col("id") == F.col("goal")).select(F.col("goal").alias("target"), "id", "parent")
        if at is not None:
            here = here.union(at.join(levels[hop], F.col("above") == F.col("id")).select("target", "id", "parent"))
        here = cut(here)
        rows.append(here.select("target", F.lit(hop).alias("hop"), "id"))
        at = here.select("target", F.col("parent").alias("above"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def nearest_effects(edges: DataFrame, own: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(symbol_id, effect, hops, via): how near a symbol's effect is, and the next symbol on a shortest way to it, null if its own."""
    cut = Rounds(edges.sparkSession).cut
    level = cut(own.select("symbol_id", "effect", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")).distinct())
    every = level
    for k in range(1, depth + 1):
        step = edges.join(level.select(F.col("symbol_id").alias("target"), "effect"), "target").groupBy(F.col("source").alias("symbol_id"), "effect").agg(F.lit(k).alias("hops"), F.min("target").alias("via"))
        level = cut(step.join(every, ["symbol_id", "effect"], "left_anti").select("symbol_id", "effect", "hops", "via"))
        if not level.limit(1).count():
            break
        every = every.union(level)
    return every


def package_closure(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, needs): each package with itself and all that it imports, directly or not, by imports (source, target)."""
    cut = Rounds(imports.sparkSession).cut
    reach = cut(packages.select("package", F.col("package").alias("needs")).distinct())
    new, parts = reach, 1
    while new.limit(1).count():
        step = new.join(imports.select(F.col("source").alias("needs"), F.col("target").alias("next")), "needs").select("package", F.col("next").alias("needs")).distinct()
        new = cut(step.join(reach, ["package", "needs"], "left_anti").select("package", "needs"))
        parts += 1
        reach = cut(reach.union(new)) if parts % 8 == 0 else reach.union(new)
    return reach


def package_fingerprints(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(package, digest) over the files (package, path, digest) of a package and of all that it imports."""
    from .analysis import set_digest

    item = files.select(F.col("package").alias("needs"), F.concat_ws("\n", "package", "path", "digest").alias("item"))
    own = set_digest(item, "needs", "item").select("needs", F.concat_ws("\n", "needs", "digest").alias("item"))
    return set_digest(package_closure(imports, files.select("package")).join(own, "needs").select("package", "item"), "package", "item")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("target"), F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def merge_edges(steps: DataFrame) -> DataFrame:
    """Steps (source, target, kind, path, line) as one edge for each pair and kind, with its sites in order; equal sites are counted before they are gathered."""
    site = F.struct("path", "line")
    ranked = steps.groupBy("source", "target", "kind", "path", "line").agg(F.count("*").alias("times"))
    merged = ranked.groupBy("source", "target", "kind").agg(F.sum("times").alias("n_sites"), F.array_sort(F.collect_list(F.struct(site.alias("site"), "times"))).alias("all"))
    sites = F.flatten(F.transform("all", lambda x: F.array_repeat(x["site"], x["times"].cast("int"))))
    return merged.select("source", "target", "kind", sites.alias("sites"), "n_sites")


def fold_members(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between owners in place of members: owners (id, owner); inner edges go, members are listed."""
    a = edges.join(owners.select(F.col("id").alias("source"), F.col("owner").alias("so")), "source", "left")
    b = a.join(owners.select(F.col("id").alias("target"), F.col("owner").alias("to")), "target", "left")
    b = b.select(F.coalesce("so", "source").alias("from_id"), F.coalesce("to", "target").alias("to_id"), "source", "target").where("from_id != to_id").distinct()
    return b.groupBy("from_id", "to_id").agg(F.count("*").alias("n_edges"), F.array_sort(F.collect_set("source")).alias("members"))


def covered_sites(steps: DataFrame, owners: DataFrame) -> DataFrame:
    """Steps (source, target, kind, path, line) without those of an owner that a member of it makes on the same line, with the same kind."""
    member = steps.join(owners.select(F.col("id").alias("source"), "owner"), "source").where("owner != source").select(F.col("owner").alias("source"), "kind", "path", "line").distinct()
    return steps.join(member, ["source", "kind", "path", "line"], "left_anti").select(*steps.columns)


def absorb(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with the `gone` nodes spliced out: their callees become their callers' own; a cycle of them is an error."""
    cut = Rounds(edges.sparkSession).cut
    ids = gone.select("id").distinct()
    on = lambda d, end: d.join(ids.withColumnRenamed("id", end), end, "left_semi")
    now = cut(edges.select("source", "target").distinct())
    inner = cut(on(on(now, "source"), "target").select("source", "target"))
    if inner.where("source = target").limit(1).count() or strong_components(inner).where("id != component").limit(1).count():
        raise ValueError("the absorbed nodes form a cycle")
    leave = cut(on(now, "source").select(F.col("source").alias("target"), F.col("target").alias("next")))
    while True:
        into = on(now, "target")
        if not into.limit(1).count():
            return now.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target")
        spliced = into.join(leave, "target").select("source", F.col("next").alias("target"))
        now = cut(now.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target").union(spliced).distinct())


def effects_closure(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(symbol_id, effect): own effects and those of all reachable symbols."""
    if kernels.fits(edges, own):
        return kernels.closure(edges, own)
    cut = Rounds(edges.sparkSession).cut
    every = cut(own.select("symbol_id", "effect").distinct())
    new, parts = every, 1
    back = cut(edges.select(F.col("source").alias("symbol_id"), F.col("target").alias("via")).distinct())
    while new.limit(1).count():
        step = new.withColumnRenamed("symbol_id", "via").join(back, "via").select("symbol_id", "effect").distinct()
        new = cut(step.join(every, ["symbol_id", "effect"], "left_anti"))
        parts += 1
        every = cut(every.union(new)) if parts % 8 == 0 else every.union(new)
    return every


#: The effect of a symbol that calls what no fact declares.
UNPROVED = "unknown"


def own_effects(symbols: DataFrame, edges: DataFrame, effects: DataFrame) -> DataFrame:
    """(symbol_id, effect): what is recorded, and `unknown` for called symbols that are neither declared nor have recorded effects."""
    called = edges.select(F.col("target").alias("symbol_id")).distinct()
    open_ = called.join(symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti").join(effects.select("symbol_id"), "symbol_id", "left_anti")
    return effects.select("symbol_id", "effect").union(open_.select("symbol_id", F.lit(UNPROVED)))


# Effects that leave a symbol deterministic.
HARMLESS = ("lock.read", "lock.write", "map.order")


def effect_lists(closure: DataFrame) -> DataFrame:
    """(symbol_id, effects, deterministic): the sorted comma list, and whether all of it is harmless."""
    return closure.groupBy("symbol_id").agg(F.array_join(F.array_sort(F.collect_set("effect")), ",").alias("effects"), (F.count(F.when(~F.col("effect").isin(*HARMLESS), 1)) == 0).alias("deterministic"))


def catalog_effects(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """Effects by name: rules (pattern, effect); the exact name wins, else the longest `prefix*`.

    Names are joined by equality: each with itself, and with its beginnings of the lengths
    that the prefixes have.
    """
    head = F.when(F.col("pattern").endswith("*"), F.substring("pattern", 1, F.length("pattern") - 1)).otherwise(F.col("pattern"))
    r = rules.select(head.alias("head"), (~F.col("pattern").endswith("*")).alias("exact"), "effect")
    lengths = sorted(x[0] for x in r.where("NOT exact").select(F.length("head")).distinct().collect())
    starts = F.array(*(F.struct(F.substring("query_name", 1, n).alias("head"), F.lit(False).alias("exact"), F.lit(n).alias("n")) for n in lengths)) if lengths else F.array()
    own = F.array(F.struct(F.col("query_name").alias("head"), F.lit(True).alias("exact"), F.lit(1 << 30).alias("n")))
    tried = symbols.select(F.col("id").alias("symbol_id"), F.length("query_name").alias("whole"), F.explode(F.concat(own, starts) if lengths else own).alias("x")).select("symbol_id", "whole", "x.*").where("exact OR n <= whole")
    return tried.join(r, ["head", "exact"]).groupBy("symbol_id").agg(F.max_by("effect", F.struct("n", "effect")).alias("effect"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): symbols that reach each other, over any number of hops, share the smallest id.

    Beyond one task, the greatest id that reaches a node is its colour; what reaches the
    colour's own node within the colour is one component, and the rest goes on.
    """
    if kernels.fits(edges):
        return kernels.strong_components(edges)
    cut = Rounds(edges.sparkSession).cut
    nodes = cut(edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct())
    e = cut(edges.select("source", "target").where("source != target").distinct())
    done: list[DataFrame] = []
    while e.limit(1).count():
        # what nothing calls, and what calls nothing, is in no cycle
        ends = lambda a, b: e.join(e.select(F.col(b).alias(a)).distinct(), a, "left_semi")  # noqa: B023, E731
        e = cut(ends("source", "target").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if not e.limit(1).count():
            break
        ids = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
        colour = _settled(cut(ids.withColumn("c", F.col("id"))), lambda now: e.join(now.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("m")), cut)
        paint = lambda end, to: colour.select(F.col("id").alias(end), F.col("c").alias(to))  # noqa: B023, E731
        same = cut(e.join(paint("source", "c"), "source").join(paint("target", "d"), "target").where("c = d").select("source", "target", "c"))
        member = frontier = cut(colour.where("id = c"))
        while frontier.limit(1).count():
            back = same.join(frontier.select(F.col("id").alias("target"), "c"), ["target", "c"]).select(F.col("source").alias("id"), "c").distinct()
            frontier = cut(back.join(member, ["id", "c"], "left_anti").select("id", "c"))
            member = cut(member.union(frontier))
        # a component of one node needs no row
        several = member.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = cut(several.join(member, "c").select("id", "component"))
        if found.limit(1).count():
            done.append(found)
        gone = member.select("id")
        e = cut(e.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target"))
    if not done:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(reduce(DataFrame.union, done), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _settled(now: DataFrame, step: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Colours (id, c) raised by a step's (id, m) until none rises."""
    while True:
        raised: Column = F.greatest("c", F.coalesce("m", "c"))
        after = cut(now.join(step(now), "id", "left").select("id", raised.alias("c"), (raised != F.col("c")).alias("rose")))
        if not after.where("rose").limit(1).count():
            return after.select("id", "c")
        now = after.select("id", "c")


def walk_source(source: Callable[[DataFrame], DataFrame], roots: DataFrame, depth: int = MOST_DEPTH, most: int | None = MOST_SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """(nodes, steps) of a walk over what a function gives: for a frame of ids, steps (source, target, ...) that leave them.

    So a graph can come from any resolver; each level is asked once.  More than `most`
    symbols are an error, and None takes any number.
    """
    cut = Rounds(roots.sparkSession).cut
    seen = level = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    steps: DataFrame | None = None
    for k in range(1, depth + 1):
        found = cut(source(level.select("id")))
        steps = found if steps is None else steps.union(found)
        level = cut(found.where("target IS NOT NULL").select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(k)))
        if not level.limit(1).count():
            break
        seen = seen.union(level)
        if most is not None and seen.limit(most + 1).count() > most:
            raise ValueError(f"the walk reaches more than {most} symbols")
    return seen, steps


def themed(nodes: DataFrame, theme: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes with the columns that a theme, a function of the nodes, gives each id; ids that it has nothing for keep nulls."""
    style = theme(nodes)
    if len(set(style.columns) & set(nodes.columns)) != 1 or "id" not in style.columns:
        raise ValueError("a theme gives an id and columns that the nodes lack")
    return nodes.join(style.dropDuplicates(["id"]), "id", "left")
