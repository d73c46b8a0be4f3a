"""Patterns: segment globs, folded comparison and match lists, as regular expressions for `rlike`.

A segment glob is anchored; `*` and `?` stay within one segment, a whole segment `**`
stands for any number of them, and a trailing `/...` for a subtree.  A backslash takes
the next character as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 512
#: Letters whose simple case folding is not their lower case.
FOLDS = {"ſ": "s", "K": "k", "Ω": "ω", "ς": "σ", "µ": "μ"}
_SPECIAL = set(r"\.^$|()[]{}+*?-&~#")


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _segment(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
            if i == len(text):
                raise ValueError("a pattern can't end in a backslash")
            out.append(_quoted(text[i]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or _quoted(c))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Regular expression of a segment glob, anchored by \\A and \\z."""
    if len(pattern.encode()) > MOST_BYTES:
        raise ValueError(f"a pattern has {MOST_BYTES} bytes at most")
    if pattern.endswith("/..."):
        pattern = pattern[:-4] + "/**"
    parts = pattern.split("/")
    if parts == ["**"]:
        return r"\A[\s\S]*\z"
    out = ""
    for i, part in enumerate(parts):
        if part != "**":
            out += ("/" if i and parts[i - 1] != "**" else "") + _segment(part)
        elif i == len(parts) - 1:
            # a subtree: what stands before it, and all below
            out += "(?:/[^/]*)*" if parts[i - 1] != "**" else "[^/]*(?:/[^/]*)*"
        else:
            out += ("/" if i and parts[i - 1] != "**" else "") + "(?:[^/]*/)*"
    return rf"\A(?s:{out})\z"


def literal_head(pattern: str) -> str:
    """What every match of the glob starts with; a pushed-down filter."""
    head = re.match(r"[^*?\\]*", pattern)[0]
    if head != pattern or pattern.endswith("/..."):
        # a subtree pattern also matches its root, without the last slash
        head = head[:-4] if head.endswith("/...") else head.rstrip("/")
    return head


def glob(column: Column, pattern: str) -> Column:
    """Whether the column matches; null stays null.  The value `.` is only matched by `**`, `.` and `\\.`."""
    hit = column.rlike(glob_regex(pattern))
    if (head := literal_head(pattern)) and pattern != "**":
        hit = column.startswith(head) & hit
    return hit if pattern in ("**", ".", "\\.") else hit & (column != ".")


def fold(column: Column) -> Column:
    return F.translate(F.lower(column), "".join(FOLDS), "".join(FOLDS.values()))


def fold_text(text: str) -> str:
    return "".join(FOLDS.get(c, c) for c in text.lower())


def iglob(column: Column, pattern: str) -> Column:
    return glob(fold(column), fold_text(pattern))


def match_list(column: Column, expression: str) -> Column:
    """A comma list of patterns with `*` at either end, without case; `!` excludes and wins; only exclusions take the rest."""
    yes, no = [], []
    for item in filter(None, (x.strip() for x in expression.split(","))):
        out, want = (no, item[1:]) if item.startswith("!") else (yes, item)
        value, want = F.lower(column), want.lower()
        core = want.strip("*")
        if want.startswith("*") and want.endswith("*"):
            out.append(value.contains(core))
        elif want.startswith("*"):
            out.append(value.endswith(core))
        elif want.endswith("*"):
            out.append(value.startswith(core))
        else:
            out.append(value == want)
    hit = F.lit(not yes)
    for x in yes:
        hit = hit | x
    for x in no:
        hit = hit & ~x
    return hit


def search_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[^0-9a-z]", "")


def canonical_id(*parts: Column) -> Column:
    """SHA-256 over `<bytes>:<value>,` of each part, in hex."""
    return F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(",")) for p in parts)).cast("binary"), 256)
