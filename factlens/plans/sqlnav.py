"""The SQL navigation dialect: text to a DataFrame plan.

    SELECT field [AS name], ... | * FROM selector | function(selector | function(...), option => value) [[AS] alias]
    [WHERE predicate] [ORDER BY field [ASC | DESC], ...] [LIMIT n]

A filter applies after navigation.  Nulls come last in ascending order and first in
descending order, and equal rows are ordered by snapshot, path, line, column and symbol
id.  With an alias `r`, `r.x` is the symbol's property x, and of files() the file's field x.
Fields beside a row's own are joined only where a query asks for them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.build_tags import requires
from factlens.functions.glob import glob, iglob
from factlens.operators import analysis, history, nav, traverse
from factlens.operators.select import CONTAINERS, EXACT, kinds_of, named, own_facts, parts_of, select
from factlens.sources.facts import Facts

MOST_BYTES, MOST_NESTING, MOST_ROWS, ROWS = 65_536, 64, 1000, 100
#: Functions with the number of their arguments and their options.
SIGNATURES = {
    "files": (0, ("include_excluded",)), "definitions": (1, ()), "callers": (1, ("depth",)), "callees": (1, ("depth",)),
    **{f: (1, ()) for f in ("references", "reads", "writes", "methods", "implementers", "inheritors", "uses")},
    "incoming": (1, ("via",)), "outgoing": (1, ("via",)), "traverse": (1, ("direction", "via", "depth")),
    "path": (2, ("via", "depth")), "graph": (1, ("direction", "via", "depth", "nodes", "exclude", "access")),
}
FUNCTIONS = frozenset(SIGNATURES)
#: Functions whose result can't be an argument.
TERMINAL = frozenset(("files", "path", "graph"))
MOST_NODES = 10_000
SYMBOL = ("id", "module", "package", "kind", "owner_id", "name", "visibility", "owner_name", "query_name", "type", "props")
#: Fields of a row and their types; what a source's rows lack is null there.
SITE = {
    "path": "string", "line": "int", "column": "int", "package": "string", "module": "string", "role": "string", "dispatch": "boolean", "depth": "int", "snapshot": "string",
    "relationship.kind": "string", "relationship.resolution": "string", "relationship.props": "string",
}
#: What `*` gives for symbols and for files.
WILDCARD = ("symbol", "symbol.id", "symbol.kind", "symbol.name", "symbol.query_name", "symbol.module", "symbol.package", "symbol.owner", "symbol.visibility", "symbol.props", "path", "line", "column", "package", "module", "role", "dispatch", "depth", "snapshot", "relationship.kind", "relationship.resolution", "relationship.props")
FILE_WILDCARD = ("path", "module", "package", "snapshot", "file.lines", "file.definitions", "file.functions", "file.structs")
FILE_FIELDS = (*FILE_WILDCARD, "file.build_constraint", "file.digest", "file.language")
KEYWORDS = frozenset("WHERE ORDER LIMIT AS BY AND OR NOT".split())
_LEX = re.compile(r"\s*(?:('(?:[^']|'')*')|(-?\d+(?:\.\d+)?)|(=>|!=|<=|>=|[=<>(),*])|([A-Za-z_][\w.]*(?::(?:\"(?:[^\"\\]|\\.)*\"|[^\s(),'\"]|\\.)+)?|[^\s(),']+:[^\s(),']+))")


class QueryError(ValueError):
    """A query that the dialect does not have."""


@dataclass
class Source:
    name: str
    args: list[Source] = field(default_factory=list)
    options: dict[str, object] = field(default_factory=dict)
    selector: str | None = None


@dataclass
class Query:
    columns: list[tuple[str, str]] | None
    source: Source
    where: tuple | None
    order: list[tuple[str, bool]]
    limit: int | None
    alias: str = ""


class Parser:
    def __init__(self, text: str) -> None:
        if len(text.encode()) > MOST_BYTES:
            raise QueryError("the query is too long")
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 10]!r}")
            kind = ("string", "number", "op", "word")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.i, self.depth = 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def is_word(self, *words: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1].upper() in words

    def take(self, *words: str) -> bool:
        if self.is_word(*words) or (self.peek()[0] == "op" and self.peek()[1] in words):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise QueryError(f"expected {' or '.join(words)} at {self.peek()[1]!r}")

    def word(self) -> str:
        kind, text = self.peek()
        if kind != "word":
            raise QueryError(f"expected a name at {text!r}")
        self.i += 1
        return text

    def parse(self) -> Query:
        self.need("SELECT")
        columns = None
        if not self.take("*"):
            columns = []
            while True:
                name = self.word()
                columns.append((name, self.word() if self.take("AS") else name))
                if not self.take(","):
                    break
            if len({c[1] for c in columns}) < len(columns):
                raise QueryError("two columns have one name")
        self.need("FROM")
        source = self.source()
        alias = ""
        if self.take("AS") or (self.peek()[0] == "word" and self.peek()[1].upper() not in KEYWORDS):
            alias = self.word()
        where = self.either() if self.take("WHERE") else None
        order, limit = [], None
        if self.take("ORDER"):
            self.need("BY")
            while True:
                name = self.word()
                order.append((name, bool(self.take("DESC")) or (self.take("ASC") and False)))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            kind, text = self.peek()
            self.i += 1
            if kind != "number" or not text.isdigit() or not 1 <= int(text) <= MOST_ROWS:
                raise QueryError(f"a limit from 1 to {MOST_ROWS}")
            limit = int(text)
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return Query(columns, source, where, order, limit, alias)

    def source(self, inner: bool = False) -> Source:
        kind, text = self.peek()
        if kind == "string":
            self.i += 1
            return Source("select", selector=text[1:-1].replace("''", "'"))
        name = self.word()
        if not self.take("("):
            return Source("select", selector=name)
        if name not in FUNCTIONS:
            raise QueryError(f"no function {name}")
        if inner and name in TERMINAL:
            raise QueryError(f"{name} can't be an argument")
        out = Source(name)
        arguments, options = SIGNATURES[name]
        while not self.take(")"):
            if self.peek()[0] == "word" and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1][1] == "=>":
                key = self.word()
                self.need("=>")
                if key not in options or key in out.options:
                    raise QueryError(f"{name} has no option {key}" if key not in options else f"{key} is given twice")
                out.options[key] = self.literal()
            elif out.options:
                raise QueryError("arguments come before options")
            else:
                out.args.append(self.source(True))
            self.take(",")
            if self.peek()[0] == "end":
                raise QueryError("a parenthesis is open")
        if len(out.args) != arguments:
            raise QueryError(f"{name} takes {arguments} arguments")
        return out

    def literal(self) -> object:
        kind, text = self.peek()
        self.i += 1
        if kind == "string":
            return text[1:-1].replace("''", "'")
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "word" and text.upper() in ("TRUE", "FALSE"):
            return text.upper() == "TRUE"
        if kind == "word" and text.upper() == "NULL":
            return None
        raise QueryError(f"expected a value at {text!r}")

    def either(self) -> tuple:
        out = self.both()
        while self.take("OR"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.one()
        while self.take("AND"):
            out = ("and", out, self.one())
        return out

    def one(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_NESTING:
            raise QueryError("the predicate is nested too deeply")
        try:
            if self.take("NOT"):
                return ("not", self.one())
            if self.take("("):
                out = self.either()
                self.need(")")
                return out
            name = self.word()
            if self.take("IS"):
                negative = self.take("NOT")
                self.need("NULL")
                return ("null", name, negative)
            negative = self.take("NOT")
            for op in ("IN", "MATCH", "IMATCH", "REQUIRES"):
                if self.take(op):
                    out = (op.lower(), name, self.source(True) if op == "IN" else self.literal())
                    return ("not", out) if negative else out
            if negative or self.peek()[1] not in ("=", "!=", "<", "<=", ">", ">="):
                raise QueryError(f"expected an operator at {self.peek()[1]!r}")
            op = self.peek()[1]
            self.i += 1
            return ("cmp", name, op, self.literal())
        finally:
            self.depth -= 1


def parse(text: str) -> Query:
    return Parser(text).parse()


def targets(facts: Facts, s: Source, most: int | None = traverse.MOST_SYMBOLS) -> DataFrame:
    """Distinct ids that a nested source projects; a walk that reaches more than `most` symbols is an error."""
    if s.name == "select":
        return select(facts, s.selector).select("id").distinct()
    rows, key = witnesses(facts, s, most)
    return rows.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()


def _number(s: Source, name: str, usual: int, most: int) -> int:
    n = s.options.get(name, usual)
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= most:
        raise QueryError(f"{name} is a number from 1 to {most}")
    return n


def _listed(s: Source, name: str) -> tuple[str, ...]:
    value = s.options.get(name)
    if value is not None and not isinstance(value, str):
        raise QueryError(f"{name} is a text")
    return tuple(x.strip() for x in (value or "").split(",") if x.strip())


def _edges(facts: Facts, s: Source) -> DataFrame:
    """The edges that a walk follows: calls, or relationships of the kinds that `via` names."""
    return nav.native_edges(facts, s.options["via"]) if s.options.get("via") else facts.edges


def _graph(facts: Facts, s: Source, most: int | None) -> DataFrame:
    """Nodes of a bounded graph from one root."""
    roots = targets(facts, s.args[0], most)
    if len(roots.limit(2).collect()) > 1:
        raise QueryError("a graph has one root")
    edges, access = _edges(facts, s), _listed(s, "access")
    if not set(access) <= {"call", "read", "write"}:
        raise QueryError("access is call, read or write")
    if access:
        if s.options.get("via"):
            raise QueryError("via and access exclude each other")
        occ = facts.occurrences.where("symbol_id IS NOT NULL AND enclosing_id IS NOT NULL").select(F.col("enclosing_id").alias("source"), F.col("symbol_id").alias("target"), "role")
        steps = occ.union(facts.edges.select("source", "target", F.lit("call")))
        edges = traverse.access_edges(steps, *access).select("source", "target").distinct()
    if exclude := _listed(s, "exclude"):
        try:
            out = traverse.excluded_ids(facts.symbols.select("id", F.col("package").alias("grp")), exclude, tuple(sorted(r[0] for r in facts.symbols.select("module").distinct().limit(MOST_NODES).collect())) if "external" in exclude else ())
        except ValueError as e:
            raise QueryError(str(e)) from e
        out = out.join(roots, "id", "left_anti").select("id")
        edges = edges.join(out.withColumnRenamed("id", "target"), "target", "left_anti").join(out.withColumnRenamed("id", "source"), "source", "left_anti")
    direction = s.options.get("direction", "both")
    if direction not in ("both", "out", "in"):
        raise QueryError("a direction is both, out or in")
    return traverse.graph(edges, roots, _number(s, "depth", 2, traverse.MOST_DEPTH), _number(s, "nodes", 150, MOST_NODES), direction)[0].withColumnRenamed("id", "proj")


def _applicable(facts: Facts, s: Source, ids: DataFrame) -> DataFrame:
    """The ids that a relation applies to; a selector of kinds that it never applies to is an error."""
    takes = nav.APPLIES.get(s.name, ("callable", "type", "data"))
    arg = s.args[0]
    head = parts_of(arg.selector)[0] if arg.name == "select" and ":" in arg.selector else ""
    kinds = set(kinds_of(facts, head)) if head in EXACT or head in facts.categories() else set()
    fit = set(facts.kinds_in(*takes))
    if (kinds and not kinds & fit) or head in CONTAINERS:
        raise QueryError(f"{s.name} does not apply to {head}")
    if kinds and kinds <= fit:
        return ids
    other = facts.symbols.where(~F.col("kind").isin(sorted(fit))).select("id")
    return ids.join(other, "id", "left_anti")


def witnesses(facts: Facts, s: Source, most: int | None = traverse.MOST_SYMBOLS) -> tuple[DataFrame, str]:
    """Rows of a source and the column with the projected symbol."""
    if s.name == "select":
        return select(facts, s.selector).select(F.col("id").alias("proj")), "proj"
    if s.name == "files":
        return analysis.file_rows(facts.files, bool(s.options.get("include_excluded"))), ""
    if s.name == "graph":
        return _graph(facts, s, most), "proj"
    ids = targets(facts, s.args[0], most)
    if s.name == "definitions":
        return nav.definitions(facts, ids).select(F.col("id").alias("proj")), "proj"
    if s.name in ("incoming", "outgoing"):
        rows = getattr(nav, s.name)(facts, ids, ",".join(_listed(s, "via")))
        return rows.withColumn("proj", F.col("source_id" if s.name == "incoming" else "target_id")), "proj"
    if s.name == "traverse":
        direction = s.options.get("direction", "out")
        if direction not in ("out", "in"):
            raise QueryError("a direction is out or in")
        e = _edges(facts, s)
        return traverse.reachable(e if direction == "out" else traverse.reverse(e), ids, _number(s, "depth", 3, traverse.MOST_DEPTH), most=most).withColumnRenamed("id", "proj"), "proj"
    if s.name == "path":
        end = targets(facts, s.args[1], most)
        if not s.options.get("via") and any(len(x.limit(2).collect()) != 1 for x in (ids, end)):
            raise QueryError("a path has one symbol at each end")
        return traverse.shortest_path(_edges(facts, s), ids, end, _number(s, "depth", 8, traverse.MOST_DEPTH)).withColumnRenamed("id", "proj").withColumnRenamed("hop", "depth"), "proj"
    depth = _number(s, "depth", 1, traverse.MOST_DEPTH)
    ids = _applicable(facts, s, ids)
    rows = nav.RELATIONS[s.name](facts, ids)
    if depth == 1:
        return rows, "proj"
    # each level is written before the next asks for it, so that no plan repeats the ones before
    cut = traverse.Rounds(facts.spark).cut
    level, seen = cut(rows), cut(ids)
    rows = level
    for k in range(2, depth + 1):
        new = cut(level.select(F.col("proj").alias("id")).where("id IS NOT NULL").distinct().join(seen, "id", "left_anti"))
        if not new.limit(1).count():
            break
        seen = seen.union(new)
        level = cut(nav.RELATIONS[s.name](facts, new).withColumn("depth", F.lit(k)))
        rows = rows.union(level)
    return rows, "proj"


def _fields(p: tuple | None) -> set[str]:
    if p is None:
        return set()
    if p[0] in ("and", "or", "not"):
        return set().union(*(_fields(x) for x in p[1:]))
    return {p[1]} if p[0] != "in" else set()


def _conjuncts(p: tuple | None) -> list[tuple]:
    return [] if p is None else _conjuncts(p[1]) + _conjuncts(p[2]) if p[0] == "and" else [p]


def effect_fields(facts: Facts) -> DataFrame:
    """(id, effects, deterministic) of all callable symbols and variables: no effect is the empty text, and an unproved one is named."""
    own = traverse.own_effects(facts.symbols, facts.edges, facts.effects)
    lists = traverse.effect_lists(traverse.effects_closure(facts.edges, own)).withColumnRenamed("symbol_id", "id")
    has = facts.symbols.where(F.col("kind").isin([*facts.kinds_in("callable"), "var"])).select("id")
    return has.join(lists, "id", "left").select("id", F.coalesce("effects", F.lit("")).alias("effects"), F.coalesce("deterministic", F.lit(True)).alias("deterministic"))


class Plan:
    """A query bound to facts: the rows with the columns that it asks for."""

    def __init__(self, facts: Facts, query: Query, most: int | None = traverse.MOST_SYMBOLS) -> None:
        self.facts, self.query, self.most, self.flags = facts, query, most, 0
        self.columns = query.columns
        self.is_files = query.source.name == "files"
        if self.columns is None:
            self.columns = [(c, c) for c in (FILE_WILDCARD if self.is_files else WILDCARD)]
        names = {alias: name for name, alias in self.columns}
        self.order = [(names.get(n, n), desc) for n, desc in query.order]
        wanted = {self.real(c) for c in _fields(query.where) | {c for c, _ in self.columns} | {c for c, _ in self.order}}
        rows, _ = witnesses(facts, query.source, most)
        self.rows = self._files(rows, wanted) if self.is_files else self._symbols(rows, wanted)

    def real(self, name: str) -> str:
        """A field's own name behind the source's alias."""
        alias = self.query.alias
        if alias and name.startswith(f"{alias}."):
            rest = name[len(alias) + 1 :]
            return f"symbol.props.{rest}" if not self.is_files else rest if rest in FILE_FIELDS else f"file.{rest}"
        return {"symbol.owner": "symbol.owner_name"}.get(name, name)

    def _files(self, rows: DataFrame, wanted: set[str]) -> DataFrame:
        rows = rows.withColumn("module", F.split("package", "/")[0]).withColumn("snapshot", F.lit(None).cast("string"))
        if wanted & {"file.definitions", "file.functions", "file.structs"}:
            counts = analysis.declaration_counts(self.facts.declared_in, self.facts.symbols)
            rows = rows.join(counts, "path", "left").fillna(0, ["definitions", "functions", "structs"])
        return rows

    def _symbols(self, rows: DataFrame, wanted: set[str]) -> DataFrame:
        f, source = self.facts, self.query.source
        asked = {c.split(".")[1] for c in wanted if c.startswith("symbol.")} | ({*SYMBOL} if "symbol" in wanted else set())
        for c in wanted:
            if c.startswith("symbol.") and not (c.split(".")[1] in (*SYMBOL, "metrics", "effects", "deterministic", "generation", "test_coverage", "test_coverage_generation")):
                raise QueryError(f"no field {c}")
        derived = {"metrics", "effects", "deterministic"} & asked
        if asked - {"id"} or "symbol" in wanted:
            owners = 1 if asked & {"owner_name", "query_name"} else 0
            cols = [c for c in SYMBOL if owners or c not in ("owner_name", "query_name")]
            from_ = named(f, 32 if "query_name" in asked and self._nested() else owners) if owners else f.symbols
            s = from_.select(F.col("id").alias("proj"), F.struct(*cols).alias("symbol"))
            if source.name == "select":
                # a selector's rows are symbols themselves
                chosen = select(f, source.selector)
                have = set(chosen.columns) >= set(cols) and not (owners and self._nested())
                rows = chosen.select(F.col("id").alias("proj"), F.struct(*cols).alias("symbol")) if have else s.join(chosen.select(F.col("id").alias("proj")), "proj", "left_semi")
            elif source.name == "definitions":
                rows = s.join(rows.select("proj"), "proj", "left_semi")
            else:
                rows = rows.join(s, "proj", "left")
        if "kind" in rows.columns:
            rows = rows.withColumn("relationship", F.struct("kind", "resolution", F.lit(None).cast("string").alias("props")))
        on = lambda d: d.withColumnRenamed("id", "proj")
        if derived & {"effects", "deterministic"}:
            rows = rows.join(on(effect_fields(f)), "proj", "left")
        for c in sorted(wanted):
            if c.startswith("symbol.metrics."):
                rows = self._metric(rows, c.split(".", 2)[2])
        if asked & {"generation", "test_coverage", "test_coverage_generation"}:
            now = history.current_generations(f.declarations).select(F.col("key").alias("proj"), "generation", F.col("fp").alias("now_fp"))
            rows = rows.join(now, "proj", "left")
        if asked & {"test_coverage", "test_coverage_generation"}:
            c = analysis.newest_coverage(f.coverage, f.runs).select(F.col("symbol_id").alias("proj"), F.col("fp").alias("now_fp"), F.col("ratio").alias("test_coverage"), F.col("generation").alias("test_coverage_generation"))
            rows = rows.join(c, ["proj", "now_fp"], "left")
        return rows

    def _nested(self) -> bool:
        """Whether owners may have owners themselves; asked of the kinds, which say it for most facts."""
        return any(k in self.facts.categories() and k == "column" for k in ("column",)) and bool(self.facts.symbols.where("owner_id IS NOT NULL AND kind IN ('type', 'struct', 'record', 'enum')").limit(1).count())

    def _metric(self, rows: DataFrame, name: str) -> DataFrame:
        f, to = self.facts, f"metric_{name}"
        if name in ("param_count", "body_lines"):
            m = f.metrics.select(F.col("symbol_id").alias("proj"), F.col("param_count").alias("__count"), F.col("body_lines").alias("__body"))
            lacks = F.col("symbol.kind").isin(f.kinds_in("callable")) & F.col("__count").isNull()
            value = F.col("__count" if name == "param_count" else "__body")
        else:
            declared = {r["kind"] for r in f.declared_measures.where(F.col("name") == name).limit(1000).collect()}
            if not declared:
                raise QueryError(f"no field symbol.metrics.{name}")
            m = f.measures.where(F.col("name") == name).select(F.col("symbol_id").alias("proj"), F.col("value").alias("__count"))
            lacks = F.col("symbol.kind").isin(sorted(declared)) & F.col("__count").isNull()
            value = F.when(F.col("symbol.kind").isin(sorted(declared)), F.col("__count"))
        error = F.raise_error(F.concat(F.lit(f"{name} is missing of "), F.col("proj"), F.lit("; publish it anew"))).cast("int")
        kept = rows.join(m, "proj", "left").withColumn(to, F.when(lacks, error).otherwise(value))
        return kept.drop("__count", "__body")

    def column(self, name: str) -> Column:
        name = self.real(name)
        if self.is_files:
            if name not in FILE_FIELDS:
                raise QueryError(f"no field {name}")
            return F.col({"file.build_constraint": "build"}.get(name, name.removeprefix("file.")))
        if name == "symbol.id":
            return F.col("proj")
        if name == "symbol":
            return F.col("symbol")
        head, _, rest = name.partition(".")
        if head == "symbol":
            if rest.startswith("metrics."):
                return F.col(f"metric_{rest[8:]}")
            if rest == "type":
                return F.when((F.col("symbol.kind") == "var") & F.col("symbol.type").isNull(), F.raise_error(F.concat(F.lit("a variable without a type: "), F.col("proj"))).cast("string")).when(F.col("symbol.kind") == "var", F.col("symbol.type"))
            if rest.startswith("props."):
                return F.try_variant_get(F.try_parse_json("symbol.props"), f"$.{rest[6:]}", "string")
            return F.col(rest) if rest in ("effects", "deterministic", "generation", "test_coverage", "test_coverage_generation") else F.col(f"symbol.{rest}")
        if name in SITE and (head not in self.rows.columns):
            return F.lit(None).cast(SITE[name])
        if head not in self.rows.columns:
            raise QueryError(f"no field {name}")
        return F.col(name)

    def _typed(self, name: str, value: object) -> None:
        """A literal is compared with a field of its own kind."""
        kind = self.rows.select(self.column(name).alias("x")).schema[0].dataType.simpleString()
        fits = {str: ("string",), bool: ("boolean",)}.get(type(value), ("int", "bigint", "double", "float", "smallint", "tinyint"))
        if not kind.startswith(fits) and not (isinstance(value, (int, float)) and self.real(name).startswith("symbol.props.")):
            raise QueryError(f"{name} is not compared with {value!r}")

    def predicate(self, p: tuple) -> Column:
        kind = p[0]
        if kind == "and":
            return self.predicate(p[1]) & self.predicate(p[2])
        if kind == "or":
            return self.predicate(p[1]) | self.predicate(p[2])
        if kind == "not":
            return ~self.predicate(p[1])
        if kind == "in":
            # membership as a flag, unknown for a null id, so that it can stand in any expression
            flag = f"__in{self.flags}"
            self.flags += 1
            ids = targets(self.facts, p[2], self.most).select(F.col("id").alias("proj"), F.lit(True).alias(flag))
            self.rows = self.rows.join(ids, "proj", "left")
            return F.when(F.col("proj").isNotNull(), F.coalesce(flag, F.lit(False)))
        c = self.column(p[1])
        if kind == "null":
            return c.isNotNull() if p[2] else c.isNull()
        if kind in ("match", "imatch", "requires"):
            return {"match": glob, "imatch": iglob, "requires": requires}[kind](c, p[2])
        op, value = p[2], p[3]
        if value is None:
            raise QueryError("compare with IS NULL")
        self._typed(p[1], value)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            # a property that is no number is unlike any
            c = c.try_cast("double")
        v = F.lit(value)
        return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]

    def filtered(self) -> DataFrame:
        """The rows that the query keeps; memberships that must hold are semi- and anti-joins."""
        for p in _conjuncts(self.query.where):
            inner = p[1] if p[0] == "not" else p
            if inner[0] == "in" and not self.is_files:
                ids = targets(self.facts, inner[2], self.most).withColumnRenamed("id", "proj")
                self.rows = self.rows.join(ids, "proj", "left_semi") if p[0] == "in" else self.rows.where("proj IS NOT NULL").join(ids, "proj", "left_anti")
            else:
                hit = self.predicate(p)  # which may join a flag to the rows
                self.rows = self.rows.where(hit)
        return self.rows

    def frame(self, limit: int | None) -> DataFrame:
        q = self.query
        self.filtered()
        order = []
        for name, desc in self.order:
            c = self.column(name)
            if self.rows.select(c.alias("x")).schema[0].dataType.typeName() in ("struct", "array", "map", "variant"):
                raise QueryError(f"{name} has no order")
            order.append(c.desc_nulls_first() if desc else c.asc_nulls_last())
        order += [F.col(c).asc_nulls_last() for c in ("snapshot", "path", "line", "column", "proj") if c in self.rows.columns]
        out = [self.column(name).alias(alias.replace(".", "_") if alias == name else alias) for name, alias in self.columns]
        if limit is None and q.limit is None and not q.order:
            return self.rows.select(*out)
        keep = self.rows.orderBy(*order)
        return (keep.limit(q.limit or limit) if q.limit or limit else keep).select(*out)


def run(facts: Facts, text: str, limit: int | None = ROWS, roots: list[str] | None = None, own: bool = False, most: int | None = traverse.MOST_SYMBOLS) -> DataFrame:
    """The rows of a query; `limit` holds where the query has none, and `most` bounds what a walk may reach; None lifts either.

    With `roots` the facts of these alone are asked, and with `own` selectors take symbols
    that are declared in the root of their own module.
    """
    facts = facts.scoped(roots) if roots else facts
    return Plan(own_facts(facts) if own else facts, parse(text), most).frame(limit)


def row_query(text: str) -> Query:
    """A query whose rows a rule may go through: without a limit, and neither a path nor a graph."""
    q = parse(text)
    if q.limit is not None:
        raise QueryError("a rule's query has no LIMIT")
    if q.source.name in ("path", "graph"):
        raise QueryError(f"a rule can't go through the rows of {q.source.name}")
    return q


#: Fields that a scan of source text alone can tell, and functions that need no resolved symbols.
SYNTAX_FIELDS = frozenset(("path", "line", "column", "package", "module", "role", "snapshot", "symbol.name", "symbol.kind", "symbol.package", "symbol.module", "symbol.owner", "symbol.visibility", "symbol.query_name", "file.lines", "file.definitions", "file.functions", "file.structs", "file.build_constraint"))
SYNTAX_SOURCES = frozenset(("select", "definitions", "files"))


def analysis_mode(text: str) -> str:
    """`syntax` if declarations as written answer the query, `typed` if it needs resolved symbols."""
    q = parse(text)

    def sources(s: Source) -> set[str]:
        return {s.name}.union(*(sources(a) for a in s.args))

    def has_in(p: tuple | None) -> bool:
        return p is not None and (p[0] == "in" or (p[0] in ("and", "or", "not") and any(has_in(x) for x in p[1:])))

    plain = q.columns is not None and ({c for c, _ in q.columns} | {n for n, _ in q.order if n not in {a for _, a in q.columns}} | _fields(q.where)) <= SYNTAX_FIELDS
    return "syntax" if plain and sources(q.source) <= SYNTAX_SOURCES and not has_in(q.where) else "typed"


def run_syntax(facts: Facts, text: str, limit: int | None = ROWS) -> DataFrame:
    """A query over facts whose symbols may lack ids: each declaration stands for itself."""
    if analysis_mode(text) != "syntax":
        raise QueryError("the query needs resolved symbols")
    numbered = facts.symbols.withColumn("id", F.coalesce("id", F.concat_ws("\n", "package", "kind", "name")))
    return run(facts.replaced(symbols=numbered), text, limit)


def total(facts: Facts, text: str) -> int:
    """The number of rows before the limit."""
    return Plan(facts, parse(text)).filtered().count()


def catalog(facts: Facts) -> DataFrame:
    """(sort, name, type): functions with their options, kinds with their category, and fields with their type."""
    functions = [("function", f, ", ".join(o)) for f, (_, o) in sorted(SIGNATURES.items())]
    fields = [("field", f"symbol.{c}", "string") for c in SYMBOL] + [("field", f, t) for f, t in SITE.items()] + [("field", f, "integer" if f.split(".")[-1] in ("lines", "definitions", "functions", "structs") else "string") for f in FILE_FIELDS if f.startswith("file.")]
    derived = [("field", "symbol.metrics.param_count", "integer"), ("field", "symbol.metrics.body_lines", "integer"), ("field", "symbol.generation", "integer"), ("field", "symbol.test_coverage", "number"), ("field", "symbol.test_coverage_generation", "integer"), ("field", "symbol.effects", "string"), ("field", "symbol.deterministic", "boolean")]
    kinds = [("kind", k, c) for k, c in sorted(facts.categories().items())]
    return facts.spark.createDataFrame(functions + fields + derived + kinds, "sort string, name string, type string")
