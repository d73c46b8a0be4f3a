"""Registered queries and operators over all rows of their input."""

import time
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlens.operators import compare, diff, kernels, traverse
from factlens.plans import catalog, sqlnav
from factlens.sources import testruns
from factlens.sources.facts import from_frames


def rows(df):
    return sorted(map(tuple, df.collect()))


def joined_rows(df):
    """Rows that the joins of the frame made, as they ran."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_skip_plan_takes_all_tests(spark, monkeypatch):
    """Run 3 has a failure of t:9, so run 2 is the baseline, for tests of any id."""
    results = [("t:1", 1, "fail", "a"), ("t:1", 2, "pass", "a"), ("t:2", 2, "pass", "b"), ("t:9", 2, "skip", "c"), ("t:1", 3, "pass", "a"), ("t:2", 3, "pass", "b2"), ("t:9", 3, "fail", "c")]
    df = spark.createDataFrame(results, "test_id string, run_id int, outcome string, closure string")
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: SimpleNamespace(results=df))
    assert rows(catalog.QUERIES["skip_plan"](spark, "")) == [("t:1", True), ("t:2", False), ("t:2", True), ("t:9", False)]


def test_package_closure_and_own_root_take_all_modules(spark, monkeypatch):
    symbols = [("a", "ASIA", "ASIA/x"), ("b", "EUROPE", "EUROPE/y"), ("c", "EUROPE", "EUROPE/z"), ("d", "AFRICA", "AFRICA/w")]
    calls = [("ASIA/x", "a", "b", "call"), ("EUROPE/y", "b", "c", "call"), ("EUROPE/z", "d", None, "call"), ("AFRICA/w", "c", "a", "write")]
    facts = SimpleNamespace(symbols=spark.createDataFrame(symbols, "id string, module string, package string"), occurrences=spark.createDataFrame(calls, "package string, enclosing_id string, symbol_id string, role string"))
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: facts)
    assert rows(catalog.QUERIES["package_closure"](spark, "")) == [("AFRICA/w", 1), ("ASIA/x", 3), ("EUROPE/y", 2), ("EUROPE/z", 1)]
    assert rows(catalog.QUERIES["own_root"](spark, "")) == [("a",), ("b",)]


def test_strong_components_of_long_cycles(spark):
    """Cycles of 21 and 11 nodes, a chain between them, and a node that calls itself."""
    cycle = lambda p, n: [(f"{p}{i:02}", f"{p}{(i + 1) % n:02}") for i in range(n)]
    edges = cycle("x", 21) + cycle("y", 11) + [("x05", "m"), ("m", "y03"), ("s", "s")]
    want = [(f"x{i:02}", "x00") for i in range(21)] + [(f"y{i:02}", "y00") for i in range(11)] + [("m", "m"), ("s", "s")]
    assert rows(traverse.strong_components(spark.createDataFrame(edges, "source string, target string"))) == sorted(want)


def test_suggest_prefix_takes_any_number_of_candidates(spark, monkeypatch):
    """More than ten thousand names start with the prefix; the first of all by name and id come back."""
    n = F.col("id")
    symbols = spark.range(10_050).select(F.format_string("p:%05d", n).alias("id"), F.when(n == 10_049, "Small!").otherwise("small part").alias("name"))
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: SimpleNamespace(symbols=symbols))
    assert rows(catalog.QUERIES["suggest_prefix"](spark, "")) == [*((f"p:{i:05}", "small part") for i in range(19)), ("p:10049", "Small!")]


def test_walk_resolver_takes_any_number_of_symbols(spark, monkeypatch):
    """Two red functions lead to more than ten thousand suppliers."""
    many = F.transform(F.sequence(F.lit(1), F.lit(5_100)), lambda i: F.concat(F.lit("s:"), F.col("id").cast("string"), F.lit("-"), i.cast("string")))
    relationships = spark.range(3).select(F.concat(F.lit("p:"), F.col("id").cast("string")).alias("source_id"), many.alias("targets"), F.lit("tpch.supplied_by").alias("kind"), F.lit("parts").alias("path"), F.lit(1).alias("line"), F.lit("exact").alias("resolution"))
    symbols = spark.createDataFrame([("p:0", "func", "red a"), ("p:1", "func", "red b"), ("p:2", "func", "blue c")], "id string, kind string, name string")
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: SimpleNamespace(symbols=symbols, relationships=relationships))
    want = [(f"p:{k}",) for k in (0, 1)] + [(f"s:{k}-{i}",) for k in (0, 1) for i in range(1, 5_101)]
    assert rows(catalog.QUERIES["walk_resolver"](spark, "")) == sorted(want)


def test_traverse_nested_takes_any_number_of_symbols(spark, monkeypatch):
    """Two red functions call more than ten thousand others; in the dialect as such that is an error."""
    n, p = F.col("id"), lambda c: F.concat(F.lit("p:"), c.cast("string"))
    symbols = spark.range(10_203).select(p(n).alias("id"), F.lit("func").alias("kind"), F.when(n < 2, "red a").otherwise("blue b").alias("name"))
    facts = from_frames(spark, symbols=symbols, edges=spark.range(2, 10_203).select(p(n % 2).alias("source"), p(n).alias("target")))
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: facts)
    assert rows(catalog.QUERIES["traverse_nested"](spark, "")) == sorted((f"p:{i}",) for i in range(2, 10_203))
    with pytest.raises(Exception, match="more than 10000 symbols"):
        sqlnav.run(facts, "SELECT symbol.id AS id FROM traverse('func:red *', depth => 1)").collect()


def test_traverse_via_takes_any_number_of_symbols(spark, monkeypatch):
    """A red function is supplied by more than ten thousand suppliers."""
    symbols = spark.createDataFrame([("p:0", "func", "red a")], "id string, kind string, name string")
    relationships = spark.range(1).select(F.lit("p:0").alias("source_id"), F.transform(F.sequence(F.lit(1), F.lit(10_100)), lambda i: F.concat(F.lit("s:"), i.cast("string"))).alias("targets"), F.lit("tpch.supplied_by").alias("kind"))
    facts = from_frames(spark, symbols=symbols, relationships=relationships)
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: facts)
    assert rows(catalog.QUERIES["traverse_via"](spark, "")) == sorted((f"s:{i}", 1) for i in range(1, 10_101))


def test_traverse_via_takes_any_number_of_symbols_in_rounds(spark, monkeypatch):
    """The same with more edges than one task takes, as on 60 times sf0.1: red functions that share suppliers, one that is supplied itself, and a blue function."""
    monkeypatch.setattr(kernels, "MOST_EDGES", -1)
    symbols = spark.createDataFrame([("p:0", "func", "red a"), ("p:1", "func", "red b"), ("p:2", "func", "blue c")], "id string, kind string, name string")
    supplied = lambda source, first, last: (source, [f"s:{i}" for i in range(first, last + 1)], "tpch.supplied_by")
    relationships = spark.createDataFrame([supplied("p:0", 1, 5_200), supplied("p:1", 5_001, 10_100), supplied("p:2", 20_000, 20_010), ("s:1", ["s:2", "s:30000"], "tpch.supplied_by")], "source_id string, targets array<string>, kind string")
    facts = from_frames(spark, symbols=symbols, relationships=relationships)
    monkeypatch.setattr(catalog, "indexed", lambda spark, sf_dir: facts)
    assert rows(catalog.QUERIES["traverse_via"](spark, "")) == sorted([*((f"s:{i}", 1) for i in range(1, 10_101)), ("s:30000", 2)])


def test_linked_joins_no_case_with_each_namesake(spark):
    """Two thousand cases and functions of one name make no four million pairs; a case of two names has one function if both do, the same."""
    symbols = spark.range(2_000).select(F.format_string("p:%d", "id").alias("id"), F.lit("func").alias("kind"), F.lit("m").alias("package"), F.lit("same").alias("name"))
    symbols = symbols.union(spark.createDataFrame([("one", "func", "m", "own"), ("one", "func", "m", "alias"), ("two", "func", "m", "other"), ("var", "var", "m", "own"), (None, "func", "m", "own")], "id string, kind string, package string, name string"))
    cases = symbols.where("name = 'same'").select(F.col("id").alias("test_id"), "package", "name")
    more = [("t1", "m", "own"), ("t2", "m", "own"), ("t2", "m", "alias"), ("t3", "m", "own"), ("t3", "m", "other"), ("t4", "m", "own"), ("t4", "m", "same"), ("t5", "m", "absent"), ("t6", "m", None)]
    got = testruns.linked(cases.union(spark.createDataFrame(more, "test_id string, package string, name string")), symbols)
    assert rows(got) == [("t1", "one"), ("t2", "one")]
    got = testruns.linked(cases, symbols)
    got.collect()
    made = [int(m) for m in joined_rows(got)]
    assert made and max(made) <= 2_000


def test_reordered_takes_long_lists_in_time_of_their_length(spark):
    """Members in order, the last one brought to the front, one gone and one new: of 100,000 the moved one comes back within a minute."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.format_string("p:%06d", i))
    lists = spark.range(1).select(F.lit("t").alias("name"), ids.alias("old"))
    lists = lists.withColumn("new", F.concat(F.slice("old", -1, 1), F.array(F.lit("new")), F.slice("old", 2, 99_998)))
    began = time.monotonic()
    assert rows(diff.reordered(lists)) == [("t", "p:099999")]
    assert time.monotonic() - began < 60


def test_token_changes_hands_on_pages(spark):
    """A task that turns 400 texts of 500 tokens into 200,400 steps holds a page of them at a time."""
    held = []

    class Texts:
        """Stands for a frame: runs the task's own function here and keeps the sizes of what it hands on."""

        def select(self, *_):
            return self

        def mapInArrow(self, pages, schema):
            old = "a " * 500
            given = pa.record_batch({"key": [str(k) for k in range(400)], "old": [old] * 400, "new": [old + "b"] * 400})
            held.extend(b.num_rows for b in pages(iter([given])))

        mapInPandas = lambda self, pages, schema: held.extend(len(b) for b in pages(iter([pd.DataFrame({"key": range(400), "old": ["a " * 500] * 400, "new": ["a " * 500 + "b"] * 400})])))

    compare.token_changes(Texts())
    assert sum(held) == 400 * 501 and max(held) <= 50_000
    texts = spark.createDataFrame([("k", "f(a) z", "f(b) z"), ("l", None, "x"), ("m", "y", None), ("n", None, None)], "key string, old string, new string")
    assert rows(compare.token_changes(texts, same=False)) == [("k", 2, "-", "a"), ("k", 3, "+", "b"), ("l", 0, "+", "x"), ("m", 0, "-", "y")]
    assert [r for r in rows(compare.token_changes(texts)) if r[2] != " "] == rows(compare.token_changes(texts, same=False))
