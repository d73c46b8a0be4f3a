"""Whether a build constraint requires a tag, by the truth table of its expression.

An expression has tags, `!`, `&&`, `||` and parentheses.  It requires a tag if it can hold
and can't hold without the tag.  Cofactors are taken tag by tag and shared, as in an
ordered decision diagram.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_NODES = 65_536


class Diagram:
    def __init__(self, text: str) -> None:
        self.tokens = re.findall(r"&&|\|\||!|\(|\)|[\w.]+", text) + [""]
        self.tags = sorted({t for t in self.tokens if re.match(r"[\w.]", t)})
        self.nodes: dict[tuple[int, int, int], int] = {}
        self.table: list[tuple[int, int, int]] = [(1 << 30, 0, 0), (1 << 30, 1, 1)]
        self.memo: dict = {}
        self.i = 0
        self.root = self._or()
        if self.tokens[self.i]:
            raise ValueError(f"unexpected {self.tokens[self.i]!r}")

    def _node(self, level: int, lo: int, hi: int) -> int:
        if lo == hi:
            return lo
        key = (level, lo, hi)
        if key not in self.nodes:
            if len(self.table) >= MOST_NODES:
                raise ValueError("the constraint is too large")
            self.nodes[key] = len(self.table)
            self.table.append(key)
        return self.nodes[key]

    def _join(self, op: str, a: int, b: int) -> int:
        if a < 2 and b < 2:
            return (a & b) if op == "&" else (a | b)
        if (op, a, b) not in self.memo:
            (la, a0, a1), (lb, b0, b1) = self.table[a], self.table[b]
            level = min(la, lb)
            x, y = (a0, a1) if la == level else (a, a), (b0, b1) if lb == level else (b, b)
            self.memo[op, a, b] = self._node(level, self._join(op, x[0], y[0]), self._join(op, x[1], y[1]))
        return self.memo[op, a, b]

    def _not(self, a: int) -> int:
        if a < 2:
            return 1 - a
        level, lo, hi = self.table[a]
        return self._node(level, self._not(lo), self._not(hi))

    def _or(self) -> int:
        a = self._and()
        while self.tokens[self.i] == "||":
            self.i += 1
            a = self._join("|", a, self._and())
        return a

    def _and(self) -> int:
        a = self._one()
        while self.tokens[self.i] == "&&":
            self.i += 1
            a = self._join("&", a, self._one())
        return a

    def _one(self) -> int:
        t = self.tokens[self.i]
        self.i += 1
        if t == "!":
            return self._not(self._one())
        if t == "(":
            a = self._or()
            self.i += 1
            return a
        if not re.match(r"[\w.]", t):
            raise ValueError("a tag is missing")
        return self._node(self.tags.index(t), 0, 1)

    def without(self, tag: str) -> int:
        """The diagram with the tag false."""
        level = self.tags.index(tag) if tag in self.tags else -1

        def cut(a: int) -> int:
            if a < 2:
                return a
            at, lo, hi = self.table[a]
            return cut(lo) if at == level else self._node(at, cut(lo), cut(hi))

        return cut(self.root)


def needs(text: str | None, tag: str) -> bool | None:
    if text is None:
        return None
    if not text.strip():
        return False
    d = Diagram(text)
    return d.root != 0 and d.without(tag) == 0


def requires(column: Column, tag: str) -> Column:
    @F.pandas_udf("boolean")
    def work(s: pd.Series) -> pd.Series:
        known: dict = {}
        return s.map(lambda x: known.setdefault(x, needs(x, tag)) if isinstance(x, str) else None).astype(object)

    return work(column)
