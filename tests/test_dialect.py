"""The languages' fields, options and errors, over small facts."""

import pytest

from factlens.operators import analysis, diff, nav, select
from factlens.plans import pathlang, sqlnav
from factlens.sources.facts import from_frames


@pytest.fixture(scope="module")
def facts(spark):
    symbols = [
        ("f", "m", "m/p", "func", None, "f", "public", [], None, None, '{"size": 3, "of": {"brand": "x"}}'),
        ("g", "m", "m/q", "func", None, "g", "public", [], None, None, '{"size": "big"}'),
        ("h", "n", "n/p", "func", None, "h", "private", []),
        ("T", "m", "m/p", "type", None, "T", "public", [], "struct"),
        ("A", "m", "m/p", "type", None, "A", "public", [], "alias"),
        ("T.m", "m", "m/p", "method", "T", "m", "public", ["int"]),
        ("T.x", "m", "m/p", "field", "T", "x", "public", []),
        ("v", "m", "m/p", "var", None, "v", "public", [], None, "*T"),
        ("dup1", "m", "m/p", "func", None, "dup", "public", []),
        ("dup2", "m", "m/p", "var", None, "dup", "public", [], None, "int"),
        ('a:b c', "m", "m/p", "record", None, 'a:b "c"*', "public", []),
    ]
    occ = [
        ("m/p/one.x", "m/p", "g", "call", 3, "f", "g", 7), ("m/p/one.x", "m/p", "g", "call", 3, "f", "g", 2), ("m/q/two.y", "m/q", "h", "call", 9, "g", "h", 1),
        ("n/p/three.x", "n/p", "f", "call", 1, "h", "f", 1), ("n/p/three.x", "n/p", "gone", "call", 2, "h", "gone", 1), ("m/p/one.x", "m/p", "v", "write", 5, "f", "v", 1), ("m/p/one.x", "m/p", "v", "reference", 6, "g", "v", 1),
    ]
    rel = [("f", ["T"], "route", "r", 1, "exact"), ("f", ["g"], "uses", "r", 2, "guess"), ("T", ["A"], "route", "r", 3, "exact")]
    return from_frames(
        spark, symbols=symbols, occurrences=occ, relationships=rel, edges=[("f", "g"), ("g", "h"), ("h", "f"), ("h", "gone")], effects=[("h", "lock.read")],
        metrics=[("f", 1, 4), ("g", 2, None), ("h", 0, 1), ("T.m", 1, 2), ("dup1", 0, 0)], measures=[("f", "cost", 5), ("g", "cost", 6)], declared_measures=[("func", "cost")],
        declarations=[(1, "f", "set", 1), (2, "f", "set", 2), (1, "g", "set", 1), (2, "g", "delete", None)], coverage=[(1, "f", 4, 1, 2, None, 2), (2, "f", 4, 3, 2, None, 2), (3, "f", 1, 1, 2, "t", 2)], runs=[(1, 9), (2, 5), (3, 99)],
        files=[("m/p/one.x", "m/p", "x", "a\nb", False, "linux"), ("m/q/two.y", "m/q", "y", "", False, None)], declared_in=[("m/p/one.x", "f"), ("m/p/one.x", "T"), ("m/p/one.x", "T.m")],
    )


def run(facts, text, **more):
    return [tuple(r) for r in sqlnav.run(facts, text, **more).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SELECT symbol.id FROM 'struct:*'", [("T",)]),
        ("SELECT symbol.metrics.param_count, symbol.metrics.body_lines FROM func:g", [(2, None)]),
        ("SELECT symbol.id, symbol.type FROM 'var:v'", [("v", "*T")]),
        ("SELECT symbol.id, symbol.type FROM 'type:T'", [("T", None)]),
        ("SELECT symbol.id, symbol.generation AS g FROM 'func:*' WHERE symbol.name != 'dup'", [("f", 2), ("g", None), ("h", None)]),
        ("SELECT symbol.test_coverage, symbol.test_coverage_generation FROM func:f", [(0.25, 2)]),
        ("SELECT r.size FROM 'func:f' r", [("3",)]),
        ("SELECT symbol.id, r.of.brand AS b FROM 'func:*' AS r WHERE r.size > 2", [("f", "x")]),
        ("SELECT symbol.id, symbol.effects AS e, symbol.deterministic AS d FROM 'all:*' WHERE symbol.id MATCH '[fTv]' OR symbol.id = 'T' OR symbol.id = 'v' OR symbol.id = 'f'", [("T", None, None), ("f", "lock.read,unknown", False), ("v", "", True)]),
        ("SELECT line, column FROM callers(func:g)", [(3, 2), (3, 7)]),
        ("SELECT symbol.id, depth FROM callers(func:h, depth => 3) ORDER BY depth, symbol.id", [("g", 1), ("f", 2), ("f", 2), ("h", 3)]),
        ("SELECT symbol.id, relationship.kind AS k, relationship.resolution AS r FROM outgoing(func:f, via => 'route,uses') ORDER BY line", [("T", "route", "exact"), ("g", "uses", "guess")]),
        ("SELECT symbol.id, depth FROM traverse(func:f, via => 'route', depth => 4)", [("A", 2), ("T", 1)]),
        ("SELECT symbol.id FROM traverse(func:f, direction => 'in', depth => 1)", [("h",)]),
        ("SELECT symbol.id, depth FROM path(func:f, type:A, via => 'route') ORDER BY depth", [("f", 0), ("T", 1), ("A", 2)]),
        ("SELECT symbol.id, depth FROM graph(func:f, via => 'route', direction => 'out') ORDER BY depth", [("f", 0), ("T", 1), ("A", 2)]),
        ("SELECT symbol.id FROM graph(func:f, access => 'write', direction => 'out') ORDER BY symbol.id", [("f",), ("v",)]),
        ("SELECT symbol.id FROM graph(func:f, exclude => 'm/q', direction => 'out') ORDER BY symbol.id", [("f",)]),
        ("SELECT path, file.definitions, file.functions, f.structs, f.lines FROM files() f", [("m/p/one.x", 3, 2, 1, 2), ("m/q/two.y", 0, 0, 0, 0)]),
        ("SELECT path FROM files() WHERE file.build_constraint REQUIRES 'linux'", [("m/p/one.x",)]),
        ("SELECT symbol.id FROM 'func:*' WHERE symbol IN callers(func:g) OR symbol.name = 'h'", [("f",), ("h",)]),
        ("SELECT symbol.id FROM callees(func:h) WHERE symbol NOT IN func:f", [("gone",)]),
        ("SELECT symbol.id, snapshot, dispatch FROM func:f", [("f", None, None)]),
        ("SELECT symbol.id FROM 'module:*'", [("module:m",), ("module:n",)]),
        ("SELECT symbol.id FROM 'record:\"a:b \\\"c\\\"\\*\"'", [("a:b c",)]),
        ("SELECT symbol.id, symbol.metrics.cost AS c FROM 'all:*' WHERE symbol.module = 'm' AND symbol.name = 'T'", [("T", None)]),
    ],
)
def test_fields(facts, text, want):
    assert run(facts, text) == want


def test_wildcards(facts):
    assert len(sqlnav.run(facts, "SELECT * FROM callers(func:g)").columns) == 22
    assert sqlnav.run(facts, "SELECT * FROM files()").columns == ["path", "module", "package", "snapshot", "file_lines", "file_definitions", "file_functions", "file_structs"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT symbol.id FROM graph(func:f, colour => 'x')", "SELECT symbol.id FROM callers(func:f, via => 'x')", "SELECT symbol.id FROM callers(depth => 2, func:f)", "SELECT symbol.id FROM callers(func:f, depth => 9)",
        "SELECT symbol.id FROM callers(func:f, depth => 2, depth => 3)", "SELECT symbol.id FROM path(func:f)", "SELECT symbol.id FROM traverse(func:f, direction => 'up')", "SELECT symbol.id FROM graph('func:*')",
        "SELECT symbol.id FROM graph(func:f, access => 'eat')", "SELECT symbol.id FROM graph(func:f, exclude => 'none,m/q')", "SELECT symbol.id FROM callers(graph(func:f))", "SELECT symbol.id FROM func:f ORDER BY symbol",
        "SELECT symbol.nothing FROM func:f", "SELECT symbol.metrics.nothing FROM func:f", "SELECT nothing FROM files()", "SELECT symbol.id FROM func:f WHERE symbol.name = 3", "SELECT symbol.id FROM callers(func:f) WHERE line = 'x'",
        "SELECT symbol.id FROM callers(func:f) WHERE dispatch = 'x'", "SELECT symbol.id FROM path(func:f, 'func:*')", "SELECT symbol.id FROM callees('struct:*')", "SELECT symbol.id FROM methods(func:f)", "SELECT symbol.id FROM references('module:*')",
    ],
)
def test_refused(facts, text):
    with pytest.raises(sqlnav.QueryError):
        sqlnav.run(facts, text).collect()


def test_missing_measure_is_an_error(facts):
    for text in ("SELECT symbol.metrics.cost FROM func:h", "SELECT symbol.metrics.param_count FROM callees(func:h) WHERE symbol.name = 'x'"):
        if "cost" in text:
            with pytest.raises(Exception, match="cost is missing of h"):
                run(facts, text)
        else:
            assert run(facts, text) == []


def test_own_and_active_symbols(facts):
    assert run(facts, "SELECT symbol.id FROM 'api:*'", own=True) == [("T",), ("T.m",), ("f",)]
    assert [r["id"] for r in select.select(facts, "func:*", own=True).collect()] == ["f"]
    assert [r["id"] for r in select.resolved(facts, "h", active=True).collect()] == ["h"]
    with pytest.raises(ValueError, match="no symbol"):
        select.resolved(facts, "A", active=True)


def test_scopes(facts):
    assert run(facts, "SELECT symbol.id FROM 'func:*'", roots=["n"]) == [("h",)]
    assert [r[0] for r in pathlang.run(facts, "func:* <", roots=["m"]).collect()] == ["f"]


def test_modes_and_row_queries():
    assert sqlnav.analysis_mode("SELECT symbol.name FROM 'func:*' WHERE symbol.kind = 'func' ORDER BY path") == "syntax"
    for typed in ("SELECT symbol.id FROM 'func:*'", "SELECT path FROM callers(func:a)", "SELECT path FROM 'func:*' WHERE symbol IN func:a", "SELECT * FROM 'func:*'", "SELECT symbol.name FROM 'func:*' WHERE symbol.effects = ''"):
        assert sqlnav.analysis_mode(typed) == "typed"
    for bad in ("SELECT path FROM func:a LIMIT 3", "SELECT symbol.id FROM graph(func:a)", "SELECT symbol.id FROM path(func:a, func:b)"):
        with pytest.raises(sqlnav.QueryError):
            sqlnav.row_query(bad)


def test_syntax_rows(facts):
    bare = facts.replaced(symbols=facts.symbols.withColumn("id", facts.symbols["id"].substr(99, 1)).replace("", None, ["id"]))
    assert [r[0] for r in sqlnav.run_syntax(bare, "SELECT symbol.name FROM 'func:*' WHERE symbol.module = 'm'").collect()] == ["dup", "f", "g"]
    with pytest.raises(sqlnav.QueryError):
        sqlnav.run_syntax(bare, "SELECT symbol.id FROM callers(func:f)")


def test_selector_parts():
    assert select.parts_of('kind:"a:b\\"c":d') == ["kind", 'a:b\\"c', "d"]
    for bad in ('func:"open', 'func:"a"b', 'func:a"b"', "func:a\\"):
        with pytest.raises(ValueError):
            select.parts_of(bad)
    assert select.quoted("plain/x.y") == "plain/x.y" and select.quoted('a "b"*') == '"a \\"b\\"\\*"'


def test_bare_names(facts):
    names = lambda p: sorted(r["id"] for r in select.resolved(facts, p).collect())
    assert names("T.m") == ["T.m"] and names("T.*") == ["T.m", "T.x"] and names("m/p.T.*") == ["T.m", "T.x"] and names("T.?") == ["T.m", "T.x"]
    assert names("m/p.f") == ["f"] and names("dup") == ["dup1", "dup2"]
    with pytest.raises(select.Ambiguous):
        select.resolved(facts, "m/p.dup")
    with pytest.raises(ValueError, match="no symbol"):
        select.resolved(facts, "absent")


def test_referenced_and_file_graph(facts):
    assert sorted(r["id"] for r in select.referenced(facts, "func:*").collect()) == ["f", "g", "h"]
    calls = nav.file_graph(facts, facts.occurrences["path"] == "n/p/three.x").collect()
    assert sorted((r["id"], r["resolved"]) for r in calls) == [("f", True), ("gone", True)]
    with pytest.raises(ValueError):
        nav.coarse(facts.relationships, {"route": "nonsense"})
    with pytest.raises(Exception, match="isn't registered"):
        nav.coarse(facts.relationships, {"route": "call"}).collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("func:* +pkg:m/p +pkg:m/q", ["dup1", "f", "g"]), ("func:* +pkg:m/* +mod:m -func:g", ["dup1", "f"]), ("func:* -pkg:m/p -pkg:m/q", ["h"]), ("func:g < -f one.x", ["f"]), ("func:* < +pkg q", ["g"]),
        ("func:* < -pkg m/...", ["h"]), ("func:h <<2 -f two.y", ["g"]), ("func:h <<3", ["f", "g"]), ('record:"a:b \\"c\\"\\*"', ["a:b c"]),
    ],
)
def test_compact(facts, text, want):
    assert sorted(r[0] for r in pathlang.run(facts, text).collect()) == want


def test_compact_listing(facts):
    assert [(r["proj"], r["line"], r["column"]) for r in pathlang.listing(facts, "func:g <", 1).collect()] == [("f", 3, 2)]
    assert [r["proj"] for r in pathlang.listing(facts, "func:*").collect()] == ["dup1", "f", "g", "h"]
    with pytest.raises(sqlnav.QueryError):
        pathlang.listing(facts, "func:*", 0)
    with pytest.raises(sqlnav.QueryError):
        pathlang.parse("func:* -f x")


def test_grouped_findings(facts):
    rules = [{"name": "r", "severity": "warning", "query": "SELECT symbol.id AS symbol, path, line FROM callers('func:*')", "message": "{symbol}"}, {"name": "s", "severity": "error", "query": "SELECT symbol.id AS symbol, path, line FROM writes(var:v)", "message": "w"}]
    by = {r["path"]: (r["n"], r["worst"], r["messages"]) for r in analysis.findings_by(analysis.lint(facts, rules), "path").collect()}
    assert by == {"m/p/one.x": (2, "error", ["f", "w"]), "m/q/two.y": (1, "warning", ["g"]), "n/p/three.x": (1, "warning", ["h"])}
    with pytest.raises(sqlnav.QueryError):
        analysis.lint(facts, [{"name": "r", "query": "SELECT path FROM func:a LIMIT 2", "message": ""}])


def test_tree_layers_name_the_changed_layer(spark):
    cols = "id string, parent string, kind string, name string, visibility string, body string, depth int"
    base = [("t", None, "type", "T", "public", "", 0), ("a", "t", "method", "A", "public", "1", 1), ("b", "t", "method", "b", "private", "1", 1)]
    layers = lambda rows: {r["id"]: tuple(r)[1:] for r in diff.tree_layers(spark.createDataFrame(rows, cols)).collect()}["t"]
    old = layers(base)
    differs = lambda rows: [x != y for x, y in zip(old, layers(rows), strict=True)]
    assert differs([base[0], base[2], base[1]]) == [False, False, False]
    assert differs([base[0], base[1], (*base[2][:5], "2", 1)]) == [False, False, True]
    assert differs([base[0], base[1], ("b", "t", "method", "c", "private", "1", 1)]) == [False, True, True]
    assert differs([base[0], ("a", "t", "method", "Z", "public", "1", 1), base[2]]) == [True, True, True]
    assert diff.tree_layers(spark.createDataFrame([], cols)).count() == 0
