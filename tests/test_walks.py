"""Walks in one task and in rounds of joins give the same rows, and no bound cuts them short."""

import random

import pytest

from factlens.operators import analysis, history, kernels, traverse
from factlens.sources import facts as store


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


@pytest.fixture(params=["one task", "rounds"])
def size(request, monkeypatch):
    """Both ways to walk a graph."""
    monkeypatch.setattr(kernels, "MOST_EDGES", 10**6 if request.param == "one task" else -1)
    if request.param == "rounds":
        monkeypatch.setattr(kernels, "fits", lambda *frames: False)
    return request.param


def graph(spark, edges):
    return spark.createDataFrame(sorted(edges), "source string, target string")


def idrows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def reach(edges, start):
    seen, todo = set(), list(start)
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [b for a, b in edges if a == at]
    return seen


def test_reachable(spark, size):
    r = random.Random(4)
    edges = {(f"n{r.randrange(20)}", f"n{r.randrange(20)}") for _ in range(34)}
    want, level = {}, {"n0", "n7"}
    for d in range(1, 5):
        level = {b for a, b in edges if a in level} - set(want) - {"n0", "n7"}
        want |= dict.fromkeys(level, d)
    start = idrows(spark, "n0", "n7", "n7")
    assert dict(rows(traverse.reachable(graph(spark, edges), start, 4))) == want
    assert dict(rows(traverse.reachable(graph(spark, edges), start, 4, True))) == want | {"n0": 0, "n7": 0}
    assert rows(traverse.reachable(graph(spark, edges), idrows(spark, "absent"), 2, True)) == [("absent", 0)]
    with pytest.raises(Exception, match="more than 2 symbols"):
        traverse.reachable(graph(spark, edges), start, 4, most=2).collect()


def test_signed_graph(spark, size):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("u", "a"), ("c", "d")])
    assert dict(rows(traverse.signed(edges, idrows(spark, "a"), 2))) == {"a": 0, "b": 1, "c": -1, "u": -1}
    assert dict(rows(traverse.signed(edges, idrows(spark, "a"), 2, "out"))) == {"a": 0, "b": 1, "c": 2}
    assert dict(rows(traverse.signed(edges, idrows(spark, "a"), 1, "in"))) == {"a": 0, "c": -1, "u": -1}


def test_paths(spark, size):
    edges = graph(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")])
    assert rows(traverse.shortest_path(edges, idrows(spark, "a"), idrows(spark, "e"))) == [(0, "a"), (1, "b"), (2, "d"), (3, "e")]
    assert rows(traverse.shortest_path(edges, idrows(spark, "a"), idrows(spark, "y"))) == []
    assert rows(traverse.shortest_path(edges, idrows(spark, "a", "c"), idrows(spark, "e", "d"))) == [(0, "c"), (1, "d")]
    assert rows(traverse.paths_to(edges, idrows(spark, "a"), idrows(spark, "d", "y", "a"), 4)) == [("a", 0, "a"), ("d", 0, "a"), ("d", 1, "b"), ("d", 2, "d")]


def test_closure_of_a_long_chain(spark, size):
    """An effect travels more hops than any former bound, through a cycle too."""
    n = 30 if size == "rounds" else 300
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(n)] + [("c010", "c002")]
    own = spark.createDataFrame([(f"c{n:03}", "net.read"), ("c005", "lock.read")], "symbol_id string, effect string")
    got = rows(traverse.effects_closure(graph(spark, edges), own))
    assert got == sorted([(f"c{i:03}", "net.read") for i in range(n + 1)] + [(f"c{i:03}", "lock.read") for i in range(11)])


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, size, seed):
    r = random.Random(seed)
    edges = {(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(22)} | {(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)}
    nodes = {x for e in edges for x in e}
    far = {n: reach(edges, [b for a, b in edges if a == n]) for n in nodes}
    want = sorted((n, min([n, *(m for m in far[n] if n in far[m])])) for n in nodes)
    assert rows(traverse.strong_components(graph(spark, edges))) == want


def test_absorb_long_and_cyclic(spark, size):
    n = 6 if size == "rounds" else 40
    edges = [("a", "x00"), *((f"x{i:02}", f"x{i + 1:02}") for i in range(n)), (f"x{n:02}", "z"), ("x03", "y")]
    gone = idrows(spark, *(f"x{i:02}" for i in range(n + 1)))
    assert rows(traverse.absorb(graph(spark, edges), gone)) == [("a", "y"), ("a", "z")]
    for loop in ([("a", "x"), ("x", "x")], [("a", "x"), ("x", "y"), ("y", "x")]):
        with pytest.raises(ValueError, match="cycle"):
            traverse.absorb(graph(spark, loop), idrows(spark, "x", "y"))


def test_chain_errors(spark):
    snap = lambda *r: spark.createDataFrame(list(r), "ordinal long, base long")
    assert [r["ordinal"] for r in history.chain(snap(*((i, i - 1 or None) for i in range(1, 301))), 300).orderBy("depth").collect()] == list(range(300, 0, -1))
    assert history.chain(snap((1, None)), 9).count() == 0
    for bad, why in ((snap((1, 2), (2, 1)), "cycle"), (snap((2, 1)), "isn't there"), (snap((1, None), (2, 1), (3, 2)), "more than")):
        with pytest.raises(Exception, match=why):
            history.chain(bad, 2 if why != "more than" else 3, 1 if why == "more than" else 100)


def test_effects_unproved_and_fields(spark):
    edges = graph(spark, [("f", "g"), ("f", "outside"), ("h", "known")])
    own = spark.createDataFrame([("known", "lock.read")], "symbol_id string, effect string")
    symbols = idrows(spark, "f", "g", "h")
    closure = traverse.effects_closure(edges, traverse.own_effects(symbols, edges, own))
    assert {r["symbol_id"]: (r["effects"], r["deterministic"]) for r in traverse.effect_lists(closure).collect()} == {"f": ("unknown", False), "outside": ("unknown", False), "h": ("lock.read", True), "known": ("lock.read", True)}


def test_closures_and_baseline(spark):
    edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    symbols = lambda d: spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", d)], "id string, fp long")
    tests = spark.createDataFrame([("t", "a")], "test_id string, symbol_id string")
    digest = lambda d, depth: analysis.closures(edges, symbols(d), tests, depth).first()["digest"]
    assert digest(1, 8) != digest(2, 8) and digest(1, 2) == digest(2, 2)
    results = spark.createDataFrame([("t", 1, "pass"), ("u", 1, "skip"), ("t", 2, "error"), ("t", 3, "pass")], "test_id string, run_id long, outcome string")
    runs = spark.createDataFrame([(1, 50), (2, 99), (3, 50)], "run_id long, started long")
    assert analysis.baseline(results, runs).collect()[0][0] == 1


def test_stored_facts_are_refused_when_they_do_not_fit(spark, tmp_path):
    f = store.from_frames(spark, symbols=[("a", "m", "m/p", "func", None, "A", "public", [])])
    store.write_parquet(f, f"{tmp_path}/f")
    assert rows(store.read_parquet(spark, f"{tmp_path}/f").symbols.select("id")) == [("a",)]
    f.symbols.drop("props").write.mode("overwrite").parquet(f"{tmp_path}/f/symbols")
    with pytest.raises(ValueError, match="symbols .* lacks props"):
        store.read_parquet(spark, f"{tmp_path}/f")
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").parquet(f"{tmp_path}/f/version")
    with pytest.raises(ValueError, match="version"):
        store.read_parquet(spark, f"{tmp_path}/f")
