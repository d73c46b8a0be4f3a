import random

import pytest
from pyspark.sql import functions as F

from factlens.operators import analysis, diff, history, nav, select, traverse
from factlens.plans import pathlang, sqlnav
from factlens.sources.facts import from_frames
from factlens.streaming import maintain


@pytest.fixture(scope="module")
def facts(spark):
    symbols = [
        ("Order", "m", "m/shop", "struct", None, "Order", "public", []),
        ("Total", "m", "m/shop", "field", "Order", "Total", "public", []),
        ("Repo", "m", "m/shop", "interface", None, "Repository", "public", []),
        ("RepoSave", "m", "m/shop", "method", "Repo", "Save", "public", ["Order"]),
        ("Store", "m", "m/db", "struct", None, "Store", "public", []),
        ("StoreSave", "m", "m/db", "method", "Store", "Save", "public", ["Order"]),
        ("Entry", "m", "m/app", "func", None, "Entry", "public", []),
        ("Run", "m", "m/app", "func", None, "Run", "private", []),
        ("Process", "m", "m/app", "func", None, "Process", "private", []),
    ]
    occ = [
        ("app/a.x", "m/app", "Run", "call", 3, "Entry", "Run"),
        ("app/a.x", "m/app", "StoreSave", "call", 5, "Run", "Save"),
        ("app/b.x", "m/app", "RepoSave", "call", 7, "Process", "Save"),
        ("app/b.x", "m/app", None, "call", 8, "Process", "Unknown"),
        ("app/b.x", "m/app", "Total", "write", 9, "Process", "Total"),
        ("app/b.x", "m/app", "Total", "reference", 10, None, "Total"),
    ]
    edges = [("Entry", "Run"), ("Run", "StoreSave"), ("Process", "RepoSave"), ("RepoSave", "StoreSave"), ("StoreSave", "Run")]
    rel = [("Entry", ["Run", "Store"], "route", "r", 1), ("Run", [], "route", "r", 2)]
    return from_frames(spark, symbols=symbols, occurrences=occ, edges=edges, relationships=rel, implements=[("Store", "Repo")], effects=[("StoreSave", "file.write"), ("RepoSave", "lock.read")])


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_dispatch_callers(facts):
    assert got(sqlnav.run(facts, "SELECT symbol.name AS n, dispatch AS d FROM callers('method:Store.Save')"), "n", "d") == [("Process", True), ("Run", False)]


def test_unresolved_stays(facts):
    rows = sqlnav.run(facts, "SELECT symbol.id AS id, target_name AS t FROM callees(func:Process)").collect()
    assert {(r["id"], r["t"]) for r in rows} == {("RepoSave", "Save"), (None, "Unknown")}


def test_not_in_is_unknown_for_null(facts):
    assert got(sqlnav.run(facts, "SELECT symbol.id AS id FROM callees('func:*') WHERE symbol NOT IN func:Run"), "id") == [("RepoSave",), ("StoreSave",)]


def test_null_order(facts):
    down = [r["o"] for r in sqlnav.run(facts, "SELECT symbol.owner_id AS o FROM 'all:*' ORDER BY symbol.owner_id DESC").collect()]
    assert down == [None] * 6 + ["Store", "Repo", "Order"]


@pytest.mark.parametrize("text", ["SELECT a FROM", "SELECT symbol.id FROM nope(func:a)", "SELECT symbol.id AS a, symbol.name AS a FROM func:a", "SELECT symbol.id FROM func:a LIMIT 0", "SELECT symbol.id FROM func:a LIMIT 1001", "SELECT symbol.id FROM callers(files())", "SELECT symbol.id FROM func:a WHERE symbol.id = NULL", "DELETE FROM x"])
def test_refused(facts, text):
    with pytest.raises(sqlnav.QueryError):
        sqlnav.run(facts, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("func:*", ["Entry", "Process", "Run"]),
        ("func:* & pkg:m/app", ["Entry", "Process", "Run"]),
        ("func:Entry | func:Run", ["Entry", "Run"]),
        ("func:* -func:Run", ["Entry", "Process"]),
        ("func:Entry >", ["Run"]),
        ("field:Total <", ["Process"]),
        ("field:Total ~w", ["Process"]),
        ("struct:Store :methods", ["StoreSave"]),
        ("interface:Repository :impl", ["Store"]),
        ("Order:Total", ["Total"]),
        ("func:Entry >> method:Store.Save", ["Entry", "Run", "StoreSave"]),
        ("(func:Entry | func:Process) > & func:*", ["Run"]),
    ],
)
def test_paths(facts, text, want):
    assert [r[0] for r in got(pathlang.run(facts, text), "id")] == want


def test_path_language_refuses():
    for text in ("", "a |", "(a", "a >>9 b", "a ] b"):
        with pytest.raises(sqlnav.QueryError):
            pathlang.parse(text)


def test_outgoing_keeps_empty(facts):
    assert len(nav.outgoing(facts, facts.symbols, "route").collect()) == 3


def test_effects(facts):
    rows = {r["symbol_id"]: (r["effects"], r["deterministic"]) for r in traverse.effect_lists(traverse.effects_closure(facts.edges, facts.effects)).collect()}
    assert rows["Entry"] == ("file.write", False) and rows["Process"] == ("file.write,lock.read", False)


def test_suggest(facts):
    assert [r["id"] for r in select.suggest(facts, "sa").collect()] == ["RepoSave", "StoreSave"]


@pytest.mark.parametrize("seed", range(2))
def test_reachable_by_brute_force(spark, seed):
    r = random.Random(seed)
    edges = {(str(r.randrange(14)), str(r.randrange(14))) for _ in range(24)}
    want, level = {}, {"0"}
    for d in range(1, 6):
        level = {b for a, b in edges if a in level} - set(want) - {"0"}
        want |= dict.fromkeys(level, d)
    df = spark.createDataFrame(sorted(edges), "source string, target string")
    assert dict(got(traverse.reachable(df, spark.createDataFrame([("0",)], "id string"), 5), "id", "depth")) == want


def test_absorb_and_cycle(spark):
    e = spark.createDataFrame([("a", "x"), ("x", "b"), ("x", "y"), ("y", "c")], "source string, target string")
    assert got(traverse.absorb(e, spark.createDataFrame([("x",), ("y",)], "id string")), "source", "target") == [("a", "b"), ("a", "c")]
    loop = spark.createDataFrame([("a", "x"), ("x", "x")], "source string, target string")
    with pytest.raises(ValueError):
        traverse.absorb(loop, spark.createDataFrame([("x",)], "id string"))


def test_generations_and_tombstones(spark):
    d = spark.createDataFrame([(1, "k", "delete", None), (2, "k", "set", 5), (3, "k", "set", 5), (4, "k", "delete", None), (5, "k", "set", 5), (6, "k", "set", 6)], "ordinal long, key string, op string, fp long")
    assert [r["generation"] for r in history.generations(d).orderBy("ordinal").collect()] == [1, 1, 1, 2, 3]
    s = spark.createDataFrame([(i, i - 1 if i > 1 else None, "indexed") for i in range(1, 7)], "ordinal long, base long, coverage string")
    assert history.effective(d, history.chain(s, 4), "key").count() == 0
    assert got(history.effective(d, history.chain(s, 6), "key"), "key", "fp") == [("k", 6)]


def test_classes(spark):
    cols = "key string, package string, public_fp string, private_fp string, content_fp string"
    a = spark.createDataFrame([("r", "p", "1", "1", "1"), ("s", "p", "1", "1", "1"), ("m", "p", "1", "1", "1"), ("same", "p", "1", None, "1")], cols)
    b = spark.createDataFrame([("n", "p", "1", "1", "1"), ("s", "p", "1", "2", "2"), ("m", "q", "1", "1", "1"), ("same", "p", "1", None, "1")], cols)
    assert got(diff.classify(a, b), "key", "change") == [("m", "moved"), ("n", "added"), ("r", "removed"), ("s", "structure")]


def test_flaky(spark):
    rows = [("t", 1, 0, "pass", "s", "c", "e"), ("t", 1, 1, "fail", "s", "c", "e"), ("t", 2, 0, "skip", "s", "c", "e"), ("u", 1, 0, "fail", "s", "c", "e")]
    r = analysis.flaky(spark.createDataFrame(rows, "test_id string, run_id long, attempt int, outcome string, closure_source string, closure string, environment string")).collect()
    assert [(x["test_id"], x["runs"], x["retry_flakes"], x["flake_rate"]) for x in r] == [("t", 2, 1, 0.5)]


def test_line_counts(spark):
    texts = [("",), (None,), ("a",), ("a\n",), ("a\r\nb",)]
    rows = spark.createDataFrame(texts, "t string").select(analysis.line_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [0, 0, 1, 1, 2]


def test_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, rows in enumerate(([(1, "a", "set", 1), (1, "b", "set", 1)], [(2, "a", "delete", None), (2, "b", "set", 2)])):
        spark.createDataFrame(rows, maintain.SCHEMA).coalesce(1).write.mode("append").parquet(src)
        maintain.maintain(spark.readStream.schema(maintain.SCHEMA).parquet(src), out, f"{tmp_path}/c").awaitTermination()
        if not k:
            assert maintain.state(spark, out).count() == 2
    assert got(maintain.state(spark, out), "key", "fp") == [("b", 2)]
    for _ in range(2):
        maintain.compact(spark, out)
        assert got(maintain.state(spark, out), "key", "fp") == [("b", 2)]
    spark.createDataFrame([(3, "a", "set", 7), (1, "b", "delete", None)], maintain.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    maintain.maintain(spark.readStream.schema(maintain.SCHEMA).parquet(src), out, f"{tmp_path}/c", compact_every=2).awaitTermination()
    assert got(maintain.state(spark, out), "key", "fp") == [("a", 7), ("b", 2)]
    assert maintain.state(spark, f"{tmp_path}/nothing").count() == 0
