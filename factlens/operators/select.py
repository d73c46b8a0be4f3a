"""Selectors: declared symbols by kind and pattern."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.glob import glob, search_name
from factlens.sources.facts import Facts

from . import scopes

#: Selector names and the kinds that they stand for; type and api stand for categories.
EXACT = {"method": ("method",), "field": ("field", "column"), "var": ("var", "const"), "struct": ("type", "struct"), "type": None, "func": ("func",), "api": None}
CONTAINERS = ("module", "package")
MOST_OWNERS, MOST_SUGGESTED = 32, 10_000
_PLAIN = re.compile(r"[A-Za-z0-9_./@#$!-]+")


def parts_of(text: str) -> list[str]:
    """A selector's parts: colons divide it outside double quotes and escapes; a quote holds a whole part."""
    parts, now, quoted, closed, i = [], "", False, False, 0
    while i < len(text):
        c = text[i]
        if c == ":" and not quoted:
            parts.append(now)
            now, closed = "", False
        elif closed:
            raise ValueError("text follows a closing quote")
        elif c == "\\":
            if i + 1 == len(text):
                raise ValueError("a selector can't end in a backslash")
            now += text[i : i + 2]
            i += 1
        elif c == '"':
            if not quoted and now:
                raise ValueError("a quote must hold a whole value")
            quoted, closed = not quoted, quoted
        else:
            now += c
        i += 1
    if quoted:
        raise ValueError("a quote is open")
    return [*parts, now]


def quoted(literal: str) -> str:
    """The literal as a part of a selector that matches just it."""
    return literal if _PLAIN.fullmatch(literal) else '"' + re.sub(r'([\\"*?])', r"\\\1", literal) + '"'


def named(facts: Facts, owners: int = 1) -> DataFrame:
    """Symbols with owner_name and query_name (package, owners from the outermost, name), up to `owners` levels of them."""
    s, chain = facts.symbols, []
    for k in range(min(owners, MOST_OWNERS)):
        up = facts.symbols.select(F.col("id").alias(f"up{k}"), F.col("name").alias(f"name{k}"), F.col("owner_id").alias(f"up{k + 1}"))
        s = s.withColumn("up0", F.col("owner_id")) if not k else s
        s = s.join(up, f"up{k}", "left")
        chain.insert(0, F.col(f"name{k}"))
    s = s.withColumn("owner_name", F.col("name0")).withColumn("query_name", F.concat_ws(".", "package", *chain, "name"))
    return s.select(*facts.symbols.columns, "owner_name", "query_name")


def kinds_of(facts: Facts, selector: str) -> list[str]:
    """The kinds that a selector takes."""
    if selector == "type":
        return facts.kinds_in("type")
    if selector == "api":
        return facts.kinds_in("callable", "type")
    if selector == "all":
        return sorted(facts.categories())
    return [k for k in EXACT.get(selector, (selector,)) if k in facts.categories()]


def _needs_owner(pattern: str) -> bool:
    return "/" in pattern or "." in pattern


def _pattern(pattern: str) -> Column:
    """`/` asks for the full name, `.` for the owner's name too, and nothing for the bare name."""
    if "/" in pattern:
        return glob(F.col("query_name"), pattern)
    if "." in pattern:
        return glob(F.concat_ws(".", "owner_name", "name"), pattern)
    return glob(F.col("name"), pattern)


def containers(facts: Facts, kind: str, pattern: str) -> DataFrame:
    """Modules or packages as rows of their own, one for each path of the facts."""
    path = F.col("module" if kind == "module" else "package")
    rows = facts.symbols.select("module", path.alias("path")).distinct().where(F.lit(pattern == "*") | glob(F.col("path"), pattern))
    none = F.lit(None).cast("string")
    cols = {"id": F.concat(F.lit(f"{kind}:"), "path"), "module": F.col("module"), "package": F.col("path"), "kind": F.lit(kind), "name": F.col("path"), "visibility": F.lit("public"), "params": F.array().cast("array<string>")}
    return rows.select(*(cols.get(c, none).alias(c) for c in facts.symbols.columns)).dropDuplicates(["id"])


def select(facts: Facts, text: str, own: bool = False) -> DataFrame:
    """Symbols of `kind:pattern`, `kind:module:pattern`, `Owner:member`, `pkg:...`, `mod:...`, or a bare name.

    With `own` they are declared in the root of their own module: some occurrence or file
    of that root defines them.
    """
    return _selected(own_facts(facts) if own else facts, text)


def own_facts(facts: Facts) -> Facts:
    """The facts with those symbols alone that some file in the root of their own module declares."""
    defined = facts.declared_in.select(F.split("path", "/")[0].alias("root"), "symbol_id")
    return facts.replaced(symbols=scopes.own_root(facts.symbols, defined))


def active_facts(facts: Facts) -> Facts:
    """The facts with those symbols alone that are declared, referred to or implemented in them."""
    declared = facts.declared_in.select("symbol_id")
    seen = facts.occurrences.select("symbol_id").union(declared)
    return facts.replaced(symbols=scopes.active(facts.symbols, seen, facts.implements))


def _selected(facts: Facts, text: str) -> DataFrame:
    parts = parts_of(text)
    if len(parts) == 1:
        return resolve(facts, parts[0]).drop("rank")
    head, rest = parts[0], parts[1:]
    if head == "mod":
        return facts.symbols.where(glob(F.col("module"), rest[0]))
    if head == "pkg":
        if len(rest) == 2:
            inner = F.expr("substring(package, length(module) + 2)")
            own = F.when(F.col("package") == F.col("module"), F.lit(".")).otherwise(inner)
            return facts.symbols.where(glob(F.col("module"), rest[0]) & (F.col("package").startswith(F.col("module"))) & (own == "." if rest[1] == "." else glob(own, rest[1])))
        return facts.symbols.where(glob(F.col("package"), rest[0]))
    if head == "path":
        return named(facts).where(F.exists(F.array("module", "package", F.coalesce("owner_name", F.lit("")), "query_name"), lambda x: glob(x, rest[0])))
    if head in CONTAINERS:
        return containers(facts, head, rest[0])
    if head == "kind":
        head, rest = rest[0], rest[1:] or ["**"]
    if head not in EXACT and head != "all" and head not in facts.categories():
        # members of owners by name
        return named(facts).where(glob(F.col("owner_name"), head) & glob(F.col("name"), rest[0]))
    s = named(facts) if _needs_owner(rest[-1]) else facts.symbols
    if head != "all":
        s = s.where(F.col("kind").isin(kinds_of(facts, head)))
    if head == "struct":
        # a type is a struct by its stored form; the kind of that name needs none
        s = s.where((F.col("kind") == "struct") | (F.col("form") == "struct"))
    if len(rest) == 2:
        s = s.where(glob(F.col("module"), rest[0]))
    return s if rest[-1] in ("*", "**") and head == "all" else s.where(_pattern(rest[-1]))


class Ambiguous(ValueError):
    """A bare name that several symbols have in full."""


def bare_match(pattern: str) -> Column:
    """Whether query_name answers a bare pattern: all of it or a dotted end, `x.*` its direct children, else as a glob."""
    name = F.col("query_name")
    short = F.substring_index(name, "/", -1)
    wild = bool(re.search(r"[*?]", re.sub(r"\\.", "", pattern)))
    literal = re.sub(r"\\(.)", r"\1", pattern)
    if pattern.endswith(".*") and pattern.count("*") == 1 and not re.search(r"[?\\]", pattern):
        child = re.escape(pattern[:-2]) + r"\.[^.]+$"
        return name.rlike("^" + child) if "/" in pattern else short.rlike(r"(^|\.)" + child)
    if "/" in pattern:
        return glob(name, pattern) if wild else name == literal
    if not wild:
        return (short == literal) | short.endswith("." + literal)
    # any dotted end of the short name may match
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split(short, r"\."))), lambda k: F.array_join(F.slice(F.split(short, r"\."), k, 1 << 20), "."))
    return F.exists(ends, lambda e: glob(e, pattern))


def resolve(facts: Facts, name: str) -> DataFrame:
    """Symbols that answer a bare name; `rank` is 0 for its full name and 1 for others."""
    s = named(facts).where(bare_match(name))
    return s.withColumn("rank", F.when(F.col("query_name") == re.sub(r"\\(.)", r"\1", name), 0).otherwise(1)).orderBy("rank", "query_name", "id")


def resolved(facts: Facts, name: str, active: bool = False) -> DataFrame:
    """The same, where several symbols of that full name, or none of any, are errors; with `active` what nothing in the facts touches is left out."""
    found = resolve(active_facts(facts) if active else facts, name)
    first = [(r["rank"], r["id"]) for r in found.select("rank", "id").limit(20).collect()]
    if not first:
        raise ValueError(f"no symbol answers {name!r}")
    exact = [i for rank, i in first if rank == 0]
    if len(exact) > 1:
        raise Ambiguous(f"{name!r} is the name of {', '.join(exact)}")
    return found.where(F.col("rank") == 0).drop("rank") if exact else found.drop("rank")


def referenced(facts: Facts, text: str) -> DataFrame:
    """The ids that a selector takes among all that occur other than as definitions, declared in the facts' roots or not."""
    used = facts.occurrences.where("symbol_id IS NOT NULL AND role != 'definition'").select(F.col("symbol_id").alias("id")).distinct()
    return select(facts, text).join(used, "id", "left_semi")


def suggest(facts: Facts, prefix: str, top: int = 20, most: int | None = MOST_SUGGESTED) -> DataFrame:
    """The first `top` symbols whose searched name starts with the prefix; more than `most` candidates are an error, and None takes any number."""
    if not 1 <= top <= 100:
        raise ValueError("1 to 100 suggestions")
    key = search_name(F.lit(prefix))
    found = facts.symbols.withColumn("search_name", search_name(F.col("name"))).where(F.col("search_name").startswith(key))
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} symbols start with {prefix!r}; give more of the name")
    return found.orderBy("search_name", "id").limit(top)


def any_of(*parts: Column) -> Column:
    return reduce(Column.__or__, parts)
