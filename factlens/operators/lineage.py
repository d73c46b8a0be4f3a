"""Lineage of SQL scripts: the tables that each statement reads, writes and calls.

Names of common table expressions and temporary tables are not tables.  Scripts are read
by their tokens, so that dialects Spark can't parse work too.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|\[[^\]]*\]|`[^`]*`|#{0,2}@?\w+|[^\s\w]", re.S)
_STOP = frozenset("select where set values on using inner left right full cross join group order having union except intersect limit output returning as when then with from into end begin".split())


def statements(script: str) -> list[list[str]]:
    out, now = [], []
    for t in _TOKEN.findall(script):
        if t.startswith(("--", "/*")):
            continue
        if t == ";":
            out.append(now)
            now = []
        else:
            now.append(t)
    return [s for s in [*out, now] if s]


def _name(tokens: list[str], i: int) -> tuple[str, int]:
    """A dotted name at i, and where it ends."""
    parts = []
    while i < len(tokens):
        t = tokens[i]
        if not re.match(r"[\w#@\"\[`]", t):
            break
        parts.append(t.strip('"[]`'))
        i += 1
        if i < len(tokens) and tokens[i] == ".":
            i += 1
            continue
        break
    return ".".join(parts), i


def _closing(low: list[str], i: int) -> int:
    """Where the parenthesis that opens at i closes, or the end."""
    depth = 0
    for k in range(i, len(low)):
        depth += {"(": 1, ")": -1}.get(low[k], 0)
        if not depth:
            return k
    return len(low)


def table_expressions(low: list[str]) -> set[str]:
    """Names that WITH lists give, each with or without a list of columns."""
    names: set[str] = set()
    for start in (i + 1 for i, t in enumerate(low) if t == "with"):
        i = start + 1 if start < len(low) and low[start] == "recursive" else start
        while i < len(low):
            name, k = low[i].strip('"[]`'), i + 1
            if k < len(low) and low[k] == "(":
                k = _closing(low, k) + 1
            if k >= len(low) or low[k] != "as":
                break
            k += 1
            while k < len(low) and low[k] in ("not", "materialized"):
                k += 1
            if k >= len(low) or low[k] != "(":
                break
            names.add(name)
            k = _closing(low, k) + 1
            if k >= len(low) or low[k] != ",":
                break
            i = k + 1
    return names


def access(tokens: list[str]) -> set[tuple[str, str]]:
    """(access, name) of a statement: read, write or call."""
    low = [t.lower() for t in tokens]
    ctes = table_expressions(low)
    out: set[tuple[str, str]] = set()
    alias: dict[str, str] = {}

    def table(i: int, kind: str) -> int:
        name, j = _name(tokens, i)
        if name and name.lower() not in ctes and not name.startswith(("#", "@")) and low[i] not in ("select", "(", "lateral", "unnest"):
            if j < len(low) and low[j] == "(" and kind == "read":
                out.add(("call", name))
                return j
            out.add((kind, name))
            k = j + 1 if j < len(low) and low[j] == "as" else j
            if k < len(low) and re.match(r"\w", low[k]) and low[k] not in _STOP:
                alias[low[k]] = name
        return max(j, i + 1)

    i = 0
    while i < len(low):
        t, nxt = low[i], low[i + 1] if i + 1 < len(low) else ""
        if t == "into" or (t == "update" and nxt != "set" and not (i and low[i - 1] in ("for", "then", "on"))) or (t == "merge" and nxt != "into") or (t == "table" and i and low[i - 1] == "truncate"):
            i = table(i + 1, "write")
        elif t == "delete" and not (i and low[i - 1] in ("then", "on")):
            i = table(i + 2 if nxt == "from" else i + 1, "write")
        elif t in ("from", "join") or (t == "using" and low[0] == "merge"):
            i = table(i + 1, "read")
            while i < len(low) and t == "from":
                k = i + (2 if i < len(low) and low[i] == "as" else 1 if low[i] not in (",", *_STOP) and re.match(r"\w", low[i]) else 0)
                if k < len(low) and low[k] == ",":
                    i = table(k + 1, "read")
                else:
                    break
        elif t in ("exec", "execute", "call", "perform"):
            name, i = _name(tokens, i + 1)
            if name:
                out.add(("call", name))
        else:
            i += 1
    # a DML target given by its alias is the aliased table
    done = set()
    for kind, name in out:
        real = alias.get(name.lower(), name)
        done.add((kind, real))
    return done


def lineage(scripts: DataFrame) -> DataFrame:
    """(path, statement, access, name) of scripts (path, content)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, i, a, n) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, s in enumerate(statements(c or "")) for a, n in sorted(access(s))]
        return pd.DataFrame(rows, columns=["path", "statement", "access", "name"])

    return scripts.mapInPandas(lambda it: map(work, it), "path string, statement int, access string, name string")


# Words that a statement starts with, so that a condition without THEN ends before them.
_STARTS = frozenset("begin insert update delete select exec execute set return merge print if while declare throw raiserror truncate create drop alter with call perform break continue".split())


def guarded(tokens: list[str]) -> list[tuple[list[str], tuple[str, ...]]]:
    """(statement, conditions from the outermost) of a procedural script, with IF, WHILE, FOR, LOOP, CASE and blocks, in both usual forms.

    An ELSE has the conditions before it negated; a script that ends within a block is read
    as if it closed there.
    """
    low = [t.lower() for t in tokens]
    out: list[tuple[list[str], tuple[str, ...]]] = []
    n = len(low)

    def text(i: int, k: int) -> str:
        return " ".join(tokens[i:k])

    def until(i: int, *ends: str) -> int:
        depth = 0
        while i < n:
            depth += {"(": 1, ")": -1}.get(low[i], 0)
            if depth == 0 and low[i] in ends:
                return i
            i += 1
        return n

    def condition(i: int) -> tuple[int, bool]:
        """Where a condition from i on ends, and whether by THEN."""
        depth = 0
        while i < n:
            depth += {"(": 1, ")": -1}.get(low[i], 0)
            if depth == 0 and (low[i] == "then" or low[i] in _STARTS or low[i] == ";"):
                return i, low[i] == "then"
            i += 1
        return n, False

    def block(i: int, guards: tuple[str, ...], *ends: str) -> int:
        while i < n and low[i] not in ends:
            i = statement(i, guards)
        return i

    def closed(i: int) -> int:
        """After an END, the word that it repeats and a semicolon."""
        i += 1
        if i < n and low[i] in ("if", "loop", "case"):
            i += 1
        return i + 1 if i < n and low[i] == ";" else i

    def branches(i: int, guards: tuple[str, ...], first: str) -> int:
        """The branches of an IF or CASE with THEN, from the first condition's THEN on."""
        cond, no = first, []
        while True:
            i = block(i + 1, (*guards, *no, cond), "elsif", "elseif", "when", "else", "end")
            no.append(f"NOT ({cond})")
            if i < n and low[i] in ("elsif", "elseif", "when"):
                k = until(i + 1, "then")
                cond = text(i + 1, k)
                i = k
                continue
            if i < n and low[i] == "else":
                i = block(i + 1, (*guards, *no), "end")
            return closed(i) if i < n else n

    def statement(i: int, guards: tuple[str, ...]) -> int:
        t = low[i]
        if t == ";":
            return i + 1
        if t == "declare" and "begin" in low[i:]:
            k = until(i, "begin", ";")
            return k + 1 if k < n and low[k] == ";" else k
        if t == "begin":
            return closed(block(i + 1, guards, "end", "exception")) if "exception" not in low[i:] else _exception(i, guards)
        if t == "loop":
            return closed(block(i + 1, guards, "end"))
        if t in ("if", "while", "for"):
            k = until(i + 1, "loop") if t == "for" or (t == "while" and "loop" in low[i : condition(i + 1)[0] + 1]) else condition(i + 1)[0]
            cond = text(i + 1, k)
            if k < n and low[k] == "then":
                return branches(k, guards, cond)
            if k < n and low[k] == "loop":
                return closed(block(k + 1, (*guards, cond), "end"))
            i = statement(k, (*guards, cond)) if k < n else n
            if t == "if" and i < n and low[i] == "else":
                return statement(i + 1, (*guards, f"NOT ({cond})")) if i + 1 < n else n
            return i
        if t == "case":
            k = until(i + 1, "when")
            subject = text(i + 1, k)
            end = until(k + 1, "then")
            first = text(k + 1, end)
            return branches(end, guards, f"{subject} = {first}" if subject else first)
        k = until(i, ";") if ";" in low[i:] else _end(i)
        stop = min(k, _end(i))
        out.append((tokens[i:stop], guards))
        return stop + 1 if stop < n and low[stop] == ";" else max(stop, i + 1)

    def _exception(i: int, guards: tuple[str, ...]) -> int:
        i = block(i + 1, guards, "exception", "end")
        if i < n and low[i] == "exception":
            i = block(i + 1, (*guards, "EXCEPTION"), "end")
        return closed(i)

    def _end(i: int) -> int:
        """Where a statement ends that no semicolon ends: before a word of its block's structure."""
        depth, cases, k = 0, 0, i + 1
        while k < n:
            depth += {"(": 1, ")": -1}.get(low[k], 0)
            cases += low[k] == "case"
            if depth == 0 and low[k] == "end" and cases:
                cases -= 1
            elif depth == 0 and not cases and (low[k] in ("end", "else", "elsif", "elseif", ";") or low[k] in ("if", "while") or (low[k] in ("exec", "execute", "print", "return") and k > i)):
                return k
            k += 1
        return n

    at = 0
    while at < n:
        at = closed(at) if low[at] == "end" else statement(at, ()) if low[at] not in ("else", "elsif", "elseif", "exception") else at + 1
    return out


def guarded_lineage(scripts: DataFrame) -> DataFrame:
    """(path, statement, guards, access, name) of procedural scripts (path, content)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p, c in zip(pdf["path"], pdf["content"], strict=True):
            tokens = [t for t in _TOKEN.findall(c or "") if not t.startswith(("--", "/*"))]
            for i, (s, guards) in enumerate(guarded(tokens)):
                rows += [(p, i, list(guards), a, n) for a, n in sorted(access(s))]
        return pd.DataFrame(rows, columns=["path", "statement", "guards", "access", "name"])

    return scripts.mapInPandas(lambda it: map(work, it), "path string, statement int, guards array<string>, access string, name string")
