import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions import schemas, sequence
from factlens.operators import compare, history, nav, scopes, traverse
from factlens.sources import database, testruns
from factlens.sources.facts import from_frames


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, last = [0], row
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_matches_are_a_longest_common_subsequence(a, b):
    m = sequence.matches(a, b)
    assert all(a[i] == b[j] for i, j in m) and len(m) == longest(a, b)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:], strict=False))


@given(st.lists(st.sampled_from(["a", "b", "", "-- x", "+++ y", "@@ -1 +1 @@"]), max_size=9), st.lists(st.sampled_from(["a", "c", "", "-- x"]), max_size=9))
def test_patches_are_read_as_they_were_written(a, b):
    old, new = "".join(f"{x}\n" for x in a), "".join(f"{x}\n" for x in b)
    hunks = sequence.read_patch(sequence.patch("p", old, new, 1))
    assert sum(h["added"] for h in hunks) == len(b) - longest(a, b) and sum(h["removed"] for h in hunks) == len(a) - longest(a, b)
    # the hunks turn the old lines into the new ones
    out, at = list(a), 0
    for h in hunks:
        start = h["new_start"] - (h["new_lines"] > 0)
        out[start : start + h["old_lines"]] = b[start : start + h["new_lines"]]
        at = start
    assert out == b and at <= len(b)


def test_patches_of_new_and_gone_files():
    assert "--- /dev/null" in sequence.patch("p", None, "a\n") and sequence.read_patch(sequence.patch("p", "a\n", None))[0]["new_path"] is None
    assert sequence.patch("p", "a\n", "a\n") == "" and sequence.read_patch(None) == []


def test_differences_over_frames(spark):
    t = spark.createDataFrame([("k", "a\nb\n", "b\nc\n"), ("n", None, None), ("e", "", "x")], "key string, old string, new string")
    assert got(compare.line_changes(t)) == [("e", 1, 0), ("k", 1, 1), ("n", 0, 0)]
    assert got(compare.token_changes(spark.createDataFrame([("k", "f(a)", "f(b)")], "key string, old string, new string")), "op", "token") == [(" ", "("), (" ", ")"), (" ", "f"), ("+", "b"), ("-", "a")]
    s = spark.createDataFrame([("k", ["x", "y", "z"], ["z", "x", "y", "w"]), ("n", None, ["q"])], "key string, old array<string>, new array<string>")
    assert got(compare.statement_changes(s), "key", "change", "hash") == [("k", "added", "w"), ("k", "moved", "z"), ("n", "added", "q")]
    assert got(compare.statement_changes(s).where("change = 'added'"), "old_at", "new_at") == [(None, 0), (None, 3)]
    p = compare.patches(t.withColumnRenamed("key", "path"))
    assert got(compare.hunks(p), "new_path", "added", "removed") == [("e", 1, 0), ("k", 1, 1)]
    f = spark.createDataFrame([("k", "h", "h", "a b", "a  b"), ("m", "h", "h", "a", "a"), ("x", "h", "i", "a", "b")], "key string, old_hash string, new_hash string, old_text string, new_text string")
    assert got(compare.format_only(f)) == [("k",)]


def test_classes_of_changes(spark):
    r = spark.createDataFrame([("a", "a", "n", "n"), ("a", "b", "n", "n"), ("a", "a", "n", "m"), ("a", "b", "n", "m")], "p0 string, p1 string, n0 string, n1 string")
    assert [x[0] for x in r.select(compare.relocation(*(F.col(c) for c in r.columns))).collect()] == [None, "moved", "renamed", "rename_move"]
    d = spark.createDataFrame([(1, 1, 1, 1, 1, 1), (1, 1, 1, 2, 1, 2), (1, 1, 1, 1, 1, 2), (1, None, 1, 1, 2, 1)], "a0 int, b0 int, c0 int, a1 int, b1 int, c1 int")
    sides = [dict(zip(("public", "private", "content"), (F.col(f"{x}{k}") for x in "abc"), strict=True)) for k in (0, 1)]
    assert [x[0] for x in d.select(compare.layer(*sides)).collect()] == [None, "public", "content", "private"]


def test_schemas_become_types():
    s = {"allOf": [{"$ref": "#/$defs/b"}], "type": "object", "properties": {"n": {"type": ["integer", "null"]}, "m": {"type": ["string", "integer"]}, "l": {"type": "array", "items": {"type": "string"}}}, "$defs": {"b": {"properties": {"o": {"type": "object", "properties": {"x": {"type": "number"}}}}}}}
    kind = schemas.spark_type(s)
    assert schemas.leaves(kind) == ["l", "n", "o.x"] and kind["n"].dataType == T.LongType()
    loop = {"$ref": "#"}
    with pytest.raises(ValueError, match="deeper"):
        schemas.spark_type(loop)
    schemas.additive({"a": "func"}, {"a": "func", "b": "type"})
    with pytest.raises(ValueError, match="a"):
        schemas.additive({"a": "func"}, {"a": "type"})
    low, high = schemas.handle_range(module=3)
    assert low == 3 << 52 and high == (4 << 52) - 1


def test_handles_refuse_what_does_not_fit(spark):
    df = spark.range(1).select(schemas.pack_handle(**{k: F.lit(1 << 40 if k == "kind" else 1) for k in schemas.HANDLE}).alias("h"))
    with pytest.raises(Exception, match="kind takes more"):
        df.collect()


def test_scopes(spark):
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    r = scopes.Registry(frame([("r", "a"), ("r", "b"), ("q", "c")], "root string, location string"), frame([("a", 1), ("b", 2)], "location string, snapshot long"), frame([("r", "a")], "root string, location string"))
    assert got(r.select()) == [("r", "a", 1)] and got(r.select(snapshots=[2])) == [("r", "b", 2)] and got(r.missing_heads()) == [("q", "c")]
    rows = frame([("s", "r", 1), ("s", "r", 2), ("s", "q", 5), ("t", "r", 1)], "symbol_id string, root string, snapshot long")
    assert got(scopes.align(rows, frame([("s", "r", 1)], "symbol_id string, root string, snapshot long"))) == [("s", "q", 5), ("s", "r", 1), ("t", "r", 1)]


def test_graphs_count_what_they_leave_out(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "c"), ("c", "d"), ("x", "y")], "source string, target string")
    groups = spark.createDataFrame([(i, "std/io" if i in "xy" else "app") for i in "abcdxy"], "id string, grp string")
    root = spark.createDataFrame([("a",)], "id string")
    nodes, drawn, out = traverse.bounded_graph(edges, root, groups, 2, 2, ("std/...",))
    assert got(nodes) == [("a", 0), ("b", 1)] and got(drawn) == [("a", "b")]
    assert got(out) == [("excluded", "std/io", 1), ("node_limit", "app", 1)]
    assert got(traverse.bounded_graph(edges, root, groups, 2, 9, ("std/...",))[2]) == [("beyond_depth", "app", 1), ("excluded", "std/io", 1)]
    assert got(traverse.excluded_ids(groups, ("none",))) == []
    for wrong in (("std/...", "none"), ("a", "a"), ("",)):
        with pytest.raises(ValueError):
            traverse.excluded_ids(groups, wrong)
    paths = traverse.paths_to(edges, root, spark.createDataFrame([("d",), ("b",), ("zz",)], "id string"))
    assert got(paths) == [("b", 0, "a"), ("b", 1, "b"), *(("d", k, n) for k, n in enumerate("abcd"))]
    near = traverse.nearest_effects(edges, spark.createDataFrame([("d", "io"), ("b", "io")], "symbol_id string, effect string"))
    assert got(near) == [("a", "io", 1, "b"), ("b", "io", 0, None), ("c", "io", 1, "d"), ("d", "io", 0, None)]


def test_package_fingerprints_follow_imports(spark):
    imports = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string")
    files = lambda c: spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", c), ("d", "4", "x")], "package string, path string, digest string")
    x, y = (dict(got(traverse.package_fingerprints(imports, files(c)))) for c in "xy")
    assert {k for k in x if x[k] != y[k]} == {"a", "b", "c"}


def test_versions_fold_and_carry(spark):
    t = spark.createDataFrame([("k", 5, 6), ("k", 5, 6), ("m", 1, 2), ("m", 3, -4)], "key string, a long, b long")
    folded = dict((k, (a, b)) for k, a, b in got(history.fold_fingerprints(t, "key", "a", "b")))
    import hashlib

    want = tuple(int.from_bytes(hashlib.sha256(b"".join(v.to_bytes(8, "big", signed=True) for v in vs)).digest()[:8], "big", signed=True) for vs in ((1, 3), (2, -4)))
    assert folded == {"k": (5, 6), "m": want}
    rows = spark.createDataFrame([(1, "c")], "snapshot long, coverage string")
    assert got(history.carry_forward(rows, 1, 2)) == [(2, "c")]
    types = spark.createDataFrame([("m", "p", "T", ["b"], 2), ("m", "p", "T", ["a"], 1)], "module string, package string, name string, members array<string>, source int")
    assert got(history.coalesce_types(types), "members") == [(["a", "b"],)]


def test_relations_apply_to_kinds(spark):
    f = from_frames(spark, symbols=[("t", "m", "p", "struct", None, "T", "public", []), ("f", "m", "p", "func", None, "f", "public", [])])
    assert got(nav.applicable(f, "methods", f.symbols), "id") == [("t",)]
    with pytest.raises(ValueError, match="none"):
        nav.applicable(f, "methods", f.symbols.where("id = 'f'"))


def test_test_runs_are_read_and_checked(spark, tmp_path):
    run = {"run_id": 1, "started": "2024-01-01T00:00:00Z", "environment": {"b": "2", "a": "1"}, "cases": [{"id": "t", "package": "p", "name": "f", "attempts": [{"attempt": 1, "outcome": "fail", "failure": "no"}, {"attempt": 2, "outcome": "pass"}]}], "coverage": [{"symbol_id": "s", "statements": 2, "covered": 1}]}
    (tmp_path / "r.json").write_text(json.dumps(run))
    r = testruns.read(spark, str(tmp_path))
    assert got(r.attempts, "attempt", "outcome") == [(1, "fail"), (2, "pass")] and got(r.coverage, "symbol_id", "covered") == [("s", 1)]
    symbols = spark.createDataFrame([("s", "func", "p", "f")], "id string, kind string, package string, name string")
    assert got(testruns.linked(r.cases, symbols)) == [("t", "s")]
    run["environment"] = {"a": "1", "b": "2"}
    run["cases"][0]["attempts"][0]["outcome"] = "maybe"
    (tmp_path / "r.json").write_text(json.dumps(run))
    again = testruns.read(spark, str(tmp_path))
    assert got(again.runs, "environment") == got(r.runs, "environment")
    with pytest.raises(Exception, match="no such outcome"):
        again.attempts.collect()


def test_catalogues(spark):
    spark.range(1).select("id", F.lit("x").alias("name")).createOrReplaceTempView("catalogued")
    c = database.from_session(spark).where("table = 'catalogued'")
    assert got(c, "column", "type") == [("id", "bigint"), ("name", "string")]
    assert got(compare.columns_diff(c, c.where("column = 'id'"))) == [("catalogued", "name", "removed")]
