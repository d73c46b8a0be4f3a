import re

import pytest

from factlens.functions.build_tags import needs
from factlens.functions.glob import fold_text, glob_regex, literal_head
from factlens.operators.diff import kept_order
from factlens.operators.lineage import access, statements


def matches(pattern, text):
    return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text) is not None


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("a*", ["a", "abc"], ["ba", "a/b", ""]),
        ("a?c", ["abc"], ["ac", "a/c"]),
        ("a/**", ["a", "a/b", "a/b/c"], ["ab", "b"]),
        ("a/...", ["a", "a/b"], ["ab"]),
        ("**/b", ["b", "a/b", "a/c/b"], ["ab", "b/a"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("**", ["", "a", "a/b\n"], []),
        (r"a\*", ["a*"], ["ab"]),
        ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_glob(pattern, yes, no):
    assert [matches(pattern, x) for x in yes] == [True] * len(yes)
    assert [matches(pattern, x) for x in no] == [False] * len(no)
    assert all(x.startswith(literal_head(pattern)) for x in yes)


def test_glob_refuses():
    with pytest.raises(ValueError):
        glob_regex("a\\")
    with pytest.raises(ValueError):
        glob_regex("x" * 513)


def test_fold():
    assert fold_text("KSsſ") == "ksss" and fold_text("ß") == "ß"


@pytest.mark.parametrize(("text", "tag", "want"), [("linux && !cgo", "linux", True), ("linux || darwin", "linux", False), ("(a && b) || (a && c)", "a", True), ("!a", "a", False), ("a && !a", "a", False), ("", "a", False), (None, "a", None)])
def test_requires(text, tag, want):
    assert needs(text, tag) is want


def test_kept_order():
    assert kept_order(["a", "b", "c", "d"], ["b", "c", "a", "d"]) == {"b", "c", "d"}
    assert kept_order([], ["a"]) == set()


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("INSERT INTO a SELECT * FROM b JOIN c ON 1=1", {("write", "a"), ("read", "b"), ("read", "c")}),
        ("WITH t AS (SELECT * FROM x) SELECT * FROM t, y", {("read", "x"), ("read", "y")}),
        ("UPDATE o SET v = 1 FROM orders o", {("write", "orders"), ("read", "orders")}),
        ("MERGE INTO d USING s ON d.i = s.i WHEN MATCHED THEN UPDATE SET v = 1", {("write", "d"), ("read", "s")}),
        ("SELECT * INTO #tmp FROM [dbo].[t]", {("read", "dbo.t")}),
        ("DELETE FROM a WHERE x IN (SELECT y FROM b)", {("write", "a"), ("read", "b")}),
        ("EXEC dbo.p", {("call", "dbo.p")}),
    ],
)
def test_lineage(sql, want):
    assert access(statements(sql)[0]) == want
