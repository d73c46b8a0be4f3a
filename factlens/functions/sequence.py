"""Smallest edit scripts between two sequences, and unified patches made of them.

The script is the greedy one over furthest-reaching diagonals, split at its middle, so
memory grows with the lengths and not with their product.
"""

from __future__ import annotations

import re
from collections.abc import Hashable, Sequence

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _middle(a: Sequence, b: Sequence) -> tuple[int, int, int, int]:
    """A run of equal items (x0, y0, x1, y1), perhaps empty, on some shortest script of two sequences without common ends."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        low, high = -(d - 2 * max(0, d - m)), d - 2 * max(0, d - n)
        for reach, other, forward in ((ahead, behind, True), (behind, ahead, False)):
            for k in range(low, high + 1, 2):
                down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
                x = reach.get(k + 1, 0) if down else reach.get(k - 1, 0) + 1
                y = x - k
                x0, y0 = x, y
                if forward:
                    while x < n and y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                reach[k] = x
                c = delta - k
                # the two sides met: the forward one after odd, the backward one after even distances
                most = d - 1 if forward else d
                if (delta % 2 == 1) == forward and -most <= c <= most and c in other and x + other[c] >= n:
                    return (x0, y0, x, y) if forward else (n - x, m - y, n - x0, m - y0)
    raise AssertionError("the two sides always meet")


def matches(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        x0, y0, x1, y1 = _middle(a[i0:i1], b[j0:j1])
        out.extend((i0 + x0 + k, j0 + y0 + k) for k in range(x1 - x0))
        for part in ((i0, i0 + x0, j0, j0 + y0), (i0 + x1, i1, j0 + y1, j1)):
            if part != (i0, i1, j0, j1):
                todo.append(part)
    return sorted(out)


def script(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[str, int, int]]:
    """Steps (' ', '-' or '+', index in a, index in b); of a change the removals come first."""
    steps, i, j = [], 0, 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        steps += [("-", k, j) for k in range(i, x)] + [("+", x, k) for k in range(j, y)]
        if x < len(a) or y < len(b):
            steps.append((" ", x, y))
        i, j = x + 1, y + 1
    return steps


def lines(text: str | None) -> list[str]:
    """Lines without their ends; the end of the last line starts no other."""
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def patch(path: str, old: str | None, new: str | None, context: int = 3) -> str:
    """A unified patch of one file; null stands for no file, and equal texts give an empty patch."""
    a, b = lines(old), lines(new)
    steps = script(a, b)
    changed = [k for k, s in enumerate(steps) if s[0] != " "]
    if not changed and (old is None) == (new is None):
        return ""
    out = [f"diff --git a/{path} b/{path}", "--- " + ("/dev/null" if old is None else f"a/{path}"), "+++ " + ("/dev/null" if new is None else f"b/{path}")]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k - groups[-1][1] <= 2 * context + 1:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    for first, last in groups:
        part = steps[max(0, first - context) : last + context + 1]
        n_old, n_new = sum(s[0] != "+" for s in part), sum(s[0] != "-" for s in part)
        out.append(f"@@ -{part[0][1] + (n_old > 0)},{n_old} +{part[0][2] + (n_new > 0)},{n_new} @@")
        out += [s[0] + (b[s[2]] if s[0] == "+" else a[s[1]]) for s in part]
    return "\n".join(out) + "\n"


def read_patch(text: str | None) -> list[dict]:
    """Hunks of a unified patch: paths (null for no file), ranges, and the numbers of added and removed lines.

    The counts of a hunk's header tell where it ends, so that content which looks like a header stays content.
    """
    out: list[dict] = []
    old_path = new_path = None
    left = right = 0
    bare = lambda p, side: None if p == "/dev/null" else p.removeprefix(side)
    for line in lines(text):
        if left > 0 or right > 0:
            mark = line[:1]
            if mark != "\\":
                left -= mark != "+"
                right -= mark != "-"
                out[-1]["added"] += mark == "+"
                out[-1]["removed"] += mark == "-"
        elif line.startswith("--- "):
            old_path = bare(line[4:].split("\t")[0], "a/")
        elif line.startswith("+++ "):
            new_path = bare(line[4:].split("\t")[0], "b/")
        elif found := _HUNK.match(line):
            start, n, to, k = (1 if g is None else int(g) for g in found.groups())
            left, right = n, k
            out.append({"old_path": old_path, "new_path": new_path, "old_start": start, "old_lines": n, "new_start": to, "new_lines": k, "added": 0, "removed": 0})
    return out
