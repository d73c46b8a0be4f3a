"""The compact path language: selectors, relations, sets and paths, as DataFrame plans.

    a | b      union                 a & b     intersection
    x <        callers (any uses, for what can't be called);  x <<3  callers within 3 hops
    x >        callees;  x :methods  x :impl  x :inherits  x :uses  x ~w  (writes)
    x < y      of those, the ones that y holds
    a >> b     a shortest chain of calls;  a >>5 b  with at most 5 hops
    x +sel     only what sel holds too;  x -sel  without what sel holds
    x < -f a.x  rows of files that end so;  x < +pkg p, -pkg p  rows of packages

Modifiers of one kind of selector are alternatives, those of different kinds must all
hold, and a negative one wins.  `>>` binds least, then `|`, `&`, and relations and modifiers from left to right.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.operators import nav, traverse
from factlens.operators.select import select
from factlens.sources.facts import Facts

from .sqlnav import MOST_ROWS, ROWS, QueryError

_LEX = re.compile(r"\s*(?:(>>\d*|<<\d*|[<>|&()])|(-f\s+\S+|[+-]pkg\s+\S+)|(:methods|:impl|:inherits|:uses|~w)(?![\w*])|([+-])(?=\S)|((?:\"(?:[^\"\\]|\\.)*\"|[\w*?/.\\#'$@])+(?:[:,](?:\"(?:[^\"\\]|\\.)*\"|[\w*?/.\\#'$@-])+)*))")
RELATION = {"<": "callers", ">": "callees", ":methods": "methods", ":impl": "implementers", ":inherits": "inheritors", ":uses": "uses", "~w": "writes"}
# The categories that a relation can start from.
STARTS = {">": ("callable",), ":impl": ("type",), ":inherits": ("type",), ":methods": ("type",)}


@dataclass
class Node:
    op: str
    left: object = None
    right: object = None
    depth: int = 0
    filters: tuple[str, ...] = ()


def parse(text: str) -> Node:
    tokens, at, text = [], 0, text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at : at + 10]!r}")
        tokens.append((("op", "filter", "rel", "mod", "sel")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    pos = 0

    def peek() -> tuple[str, str]:
        return tokens[pos] if pos < len(tokens) else ("end", "")

    def depth_of(t: str, usual: int) -> int:
        n = int(t[2:] or usual)
        if not 1 <= n <= traverse.MOST_DEPTH:
            raise QueryError(f"a depth from 1 to {traverse.MOST_DEPTH}")
        return n

    def atom() -> Node:
        nonlocal pos
        kind, t = peek()
        pos += 1
        if (kind, t) == ("op", "("):
            out = path()
            if peek() != ("op", ")"):
                raise QueryError("a parenthesis is open")
            pos += 1
            return out
        if kind != "sel":
            raise QueryError(f"expected a selector at {t!r}")
        return Node("select", t)

    def chain() -> Node:
        nonlocal pos
        out = atom()
        while True:
            kind, t = peek()
            if kind == "rel" or (kind == "op" and t in "<>"):
                pos += 1
                right = atom() if peek()[0] == "sel" or peek() == ("op", "(") else None
                out = Node(t, out, right)
            elif kind == "op" and t.startswith("<<"):
                pos += 1
                out = Node("<<", out, depth=depth_of(t, 3))
            elif kind == "filter":
                pos += 1
                if out.op not in (*RELATION, "<<"):
                    raise QueryError(f"{t} is for the rows of a relation")
                out.filters = (*out.filters, t)
            elif kind == "mod":
                pos += 1
                held = out.right if out.op == "+-" else []
                out = Node("+-", out.left if held else out, [*held, (t, atom())])
            else:
                return out

    def level(ops: str, inner) -> Node:
        nonlocal pos
        out = inner()
        while peek()[0] == "op" and peek()[1] == ops:
            pos += 1
            out = Node(ops, out, inner())
        return out

    def path() -> Node:
        nonlocal pos
        out = level("|", lambda: level("&", chain))
        if peek()[0] == "op" and peek()[1].startswith(">>"):
            n = depth_of(peek()[1], traverse.MOST_DEPTH)
            pos += 1
            out = Node(">>", out, level("|", lambda: level("&", chain)), n)
        return out

    out = path()
    if peek()[0] != "end":
        raise QueryError(f"unexpected {peek()[1]!r}")
    return out


def symbols(facts: Facts, node: Node) -> DataFrame:
    """Distinct ids of an expression."""
    if node.op == "select":
        out = select(facts, node.left.split(",")[0])
        for more in node.left.split(",")[1:]:
            out = out.union(select(facts, more).select(*out.columns))
        return out.select("id").distinct()
    left = symbols(facts, node.left)
    if node.op == "|":
        return left.union(symbols(facts, node.right)).distinct()
    if node.op == "&":
        return left.join(symbols(facts, node.right), "id", "left_semi")
    if node.op == "+-":
        return modified(facts, left, node.right)
    if node.op == "<<":
        return callers_within(facts, left, node)
    if node.op == ">>":
        right = symbols(facts, node.right)
        if any(len(x.limit(2).collect()) != 1 for x in (left, right)):
            raise QueryError("a path has one symbol at each end")
        return traverse.shortest_path(facts.edges, left, right, node.depth).select("id")
    out = witnesses(facts, node).select(F.col("proj").alias("id")).where("id IS NOT NULL").distinct()
    return out


def modified(facts: Facts, ids: DataFrame, modifiers: list[tuple[str, Node]]) -> DataFrame:
    """Ids that, for every kind of selector, some positive modifier holds, if there is one, and no negative one."""
    kinds: dict[str, tuple[list[DataFrame], list[DataFrame]]] = {}
    for sign, node in modifiers:
        kind = node.left.split(":")[0] if node.op == "select" and ":" in node.left else ""
        kinds.setdefault(kind, ([], []))[sign == "-"].append(symbols(facts, node))
    for yes, no in kinds.values():
        if yes:
            ids = ids.join(reduce(DataFrame.union, yes), "id", "left_semi")
        for d in no:
            ids = ids.join(d, "id", "left_anti")
    return ids


def row_filter(rows: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """Rows (path, package) that all filters leave: `-f` an ending of the path, `+pkg` and `-pkg` a package, a tree `p/...`, or the last part of its path."""
    for f in filters:
        name, value = f.split(None, 1)
        if name == "-f":
            rows = rows.where(F.col("path").endswith(value))
            continue
        if value.endswith("/..."):
            hit = (F.col("package") == value[:-4]) | F.col("package").startswith(value[:-3])
        else:
            hit = F.col("package") == value
            hit = hit if "/" in value else hit | F.col("package").endswith(f"/{value}")
        rows = rows.where(F.coalesce(hit, F.lit(False)) if name == "+pkg" else ~F.coalesce(hit, F.lit(False)))
    return rows


def callers_within(facts: Facts, ids: DataFrame, node: Node) -> DataFrame:
    """Callers within a number of hops; the node's filters hold at every level."""
    calls = facts.occurrences.where("role = 'call' AND symbol_id IS NOT NULL AND enclosing_id IS NOT NULL")
    edges = row_filter(calls, node.filters).select(F.col("symbol_id").alias("source"), F.col("enclosing_id").alias("target"))
    edges = edges.distinct() if node.filters else edges.union(traverse.reverse(facts.edges).select("source", "target")).distinct()
    return traverse.reachable(edges, ids, node.depth).select("id")


def _of(facts: Facts, ids: DataFrame, *categories: str) -> DataFrame:
    return ids.join(facts.symbols.where(F.col("kind").isin(facts.kinds_in(*categories))).select("id"), "id", "left_semi")


def witnesses(facts: Facts, node: Node) -> DataFrame:
    """Witness rows of a relation; what can't start it is left out, and nothing left is an error of the query."""
    left = symbols(facts, node.left)
    if node.op in STARTS:
        left = _of(facts, left, *STARTS[node.op])
    if node.op == "<":
        # what can't be called gives the bodies that refer to it
        called = _of(facts, left, "callable")
        calls = nav.callers(facts, called)
        other = nav.references(facts, left.join(called, "id", "left_anti")).withColumn("proj", F.col("enclosing_id"))
        rows = calls.union(other.select(*calls.columns))
    elif node.op == "~w":
        rows = nav.writes(facts, left).withColumn("proj", F.col("enclosing_id"))
    else:
        rows = nav.RELATIONS[RELATION[node.op]](facts, left)
    rows = row_filter(rows, node.filters)
    if node.right is not None:
        rows = rows.join(symbols(facts, node.right).withColumnRenamed("id", "proj"), "proj", "left_semi")
    return rows


def listing(facts: Facts, text: str, limit: int = ROWS) -> DataFrame:
    """The rows of an expression in order, at most `limit`: a relation's witnesses, or the declarations it selects."""
    if not 1 <= limit <= MOST_ROWS:
        raise QueryError(f"a limit from 1 to {MOST_ROWS}")
    node = parse(text)
    if node.op in RELATION:
        rows = witnesses(facts, node)
    else:
        rows = nav.definitions(facts, symbols(facts, node)).select(F.col("id").alias("proj"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), "package")
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in ("path", "line", "column", "proj"))).limit(limit)


def run(facts: Facts, text: str, roots: list[str] | None = None) -> DataFrame:
    """The ids that an expression selects, among the facts of these roots if given."""
    return symbols(facts.scoped(roots) if roots else facts, parse(text))


def structured(kinds: list[str], include: list[str] = (), exclude: list[str] = (), relation: str = "") -> str:
    """An expression from separate options: kinds are united, include and exclude are modifiers."""
    out = "(" + " | ".join(kinds) + ")"
    out += "".join(f" +path:{x}" for x in include) + "".join(f" -path:{x}" for x in exclude)
    return f"({out}) {relation}".strip() if relation else out
