"""Tool-call linking against brute force: levels, arguments, canonical lines, and the query over every turn of its table."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factlens.llm import chat_format
from factlens.llm.scratch import Scratch

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"


def canonical(arguments, call_id, errors, level, name, result):
    row = {"arguments": arguments, "call_id": call_id, "errors": errors, "level": level, "name": name, "result": result}
    return json.dumps(row, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def linked(spark, calls, results, schema, **more):
    return chat_format.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schema, chat_format.SCHEMA), **more)


def test_chat(spark):
    calls = [
        (1, 0, "a", "f", '{"z": 1, "y": {"b": 2, "a": "é"}}', []),
        (1, 2, "b", "f", '{"z": "no", "extra": 1}', ["a", "unknown"]),
        (1, 4, "c", "g", "not json", ["b", "a"]),
        (1, 5, "d", "f", "[1]", ["e"]),
        (1, 6, "e", "f", '{"y": {}}', ["d"]),
        (2, 0, None, "f", None, None),
    ]
    results = [(1, 1, "a", "first"), (1, 3, "a", "second"), (1, 3, "x", "alone"), (2, 1, None, "null")]
    got = linked(spark, calls, results, [("f", "z", "integer", True, None), ("f", "y", "object", False, None)]).collect()
    by = {(r["conv_id"], r["turn"], r["call_id"]): r for r in got}
    assert len(got) == 8
    a = by[1, 0, "a"]
    assert a["level"] == 0 and a["n_results"] == 2 and a["errors"] == []
    assert a["json"] == canonical({"y": {"a": "é", "b": 2}, "z": 1}, "a", [], 0, "f", "first")
    assert (by[1, 2, "b"]["level"], by[1, 2, "b"]["errors"]) == (1, ["type:z", "unexpected:extra"])
    assert (by[1, 4, "c"]["level"], by[1, 4, "c"]["errors"]) == (2, ["arguments"]) and json.loads(by[1, 4, "c"]["json"])["arguments"] == "not json"
    assert by[1, 5, "d"]["level"] is None and by[1, 6, "e"]["level"] is None and by[1, 6, "e"]["errors"] == ["missing:z"]
    assert by[1, 3, "x"]["errors"] == ["call"] and by[2, 0, None]["errors"] == ["arguments"]
    assert all(json.loads(r["json"]) for r in got)


SCHEMA = [
    ("f", "n", "number", True, None), ("f", "mode", "string", False, ["a", "b"]), ("f", "o", "object", True, None), ("f", "o.id", "integer", True, None),
    ("f", "o.tags", "array", False, None), ("f", "o.tags[]", "string", False, ["x", "y"]), ("f", "list", "array", False, None), ("f", "list[]", "object", False, None), ("f", "list[].k", "boolean", True, None), ("f", "open", "object", False, None),
]


@pytest.mark.parametrize(
    ("arguments", "want"),
    [
        ('{"n": 1, "o": {"id": 2}}', []),
        ('{"n": 1.5, "mode": "b", "o": {"id": 2, "tags": ["x", "y"]}, "list": [{"k": true}], "open": {"any": {"thing": 1}}}', []),
        ('{"n": 1e40, "o": {"id": 123456789012345678901}}', []),
        ('{"n": "1", "mode": "c", "o": {"id": 2.5}}', ["type:n", "type:o.id", "value:mode"]),
        ('{"o": {}}', ["missing:n", "missing:o.id"]),
        ('{"n": 1}', ["missing:o"]),
        ('{"n": 1, "o": []}', ["type:o"]),
        ('{"n": 1, "o": {"id": 1, "x": 1}, "y": null}', ["unexpected:o.x", "unexpected:y"]),
        ('{"n": null, "o": {"id": 1, "tags": ["x", 2, "z"]}}', ["type:n", "type:o.tags[]", "value:o.tags[]"]),
        ('{"n": 1, "o": {"id": 1}, "list": [{"k": true}, {}, {"k": 1, "z": 2}, 3]}', ["missing:list[].k", "type:list[]", "type:list[].k", "unexpected:list[].z"]),
        ('{"n": 1, "n": 2, "o": {"id": 1}}', ["arguments"]),
        ("", ["arguments"]),
        ("3", ["arguments"]),
        (None, ["arguments"]),
    ],
)
def test_argument_errors(spark, arguments, want):
    row = linked(spark, [(1, 0, "a", "f", arguments, None)], [], SCHEMA).first()
    assert row["errors"] == want


def brute_levels(after):
    level = {}
    for _ in after:
        for c, deps in after.items():
            deps = [d for d in deps if d in after]
            if c not in level and all(d in level for d in deps):
                level[c] = 1 + max((level[d] for d in deps), default=-1)
    return {c: level.get(c) for c in after}


@pytest.mark.parametrize("seed", range(3))
def test_levels_by_brute_force(spark, seed):
    """Random graphs of calls: chains, calls after several, cycles, unknown and repeated predecessors."""
    r = random.Random(seed)
    after = {f"c{i}": [f"c{r.randrange(i - 5 if r.random() < 0.9 else 0, i + (1 if r.random() < 0.04 else 0)) if i > 5 else 99}" for _ in range(r.choice((0, 1, 1, 1, 2, 3)))] for i in range(40)}
    calls = [(7, i, c, "f", None, deps) for i, (c, deps) in enumerate(after.items())] + [(7, 99, "c3", "f", None, [*after["c3"], None])]
    got = {x["call_id"]: x["level"] for x in chat_format.levels(spark.createDataFrame(calls, CALLS), Scratch(spark, "t")).collect()}
    assert got == brute_levels(after)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """1,000 calls of one conversation, one after the other, in ten rounds or so."""
    names, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    calls = [(1, i, f"c{i}", "f", None, [f"c{i - 1}"]) for i in range(1000)] + [(2, i, f"c{i}", "f", None, [f"c{(i + 1) % 3}"]) for i in range(3)]
    got = {(x["conv_id"], x["call_id"]): x["level"] for x in chat_format.levels(spark.createDataFrame(calls, CALLS), Scratch(spark, "t")).collect()}
    assert got == {(1, f"c{i}"): i for i in range(1000)} | {(2, f"c{i}"): None for i in range(3)}
    assert len(names) < 15


def test_chat_empty_repeats_and_clashing_columns(spark):
    assert linked(spark, [], [], []).count() == 0
    assert [x["errors"] for x in linked(spark, [(1, 0, "a", "f", "{}", [])], [], []).collect()] == [["schema"]]
    calls = spark.createDataFrame([(1, 0, "a", "f", "{}", [])] * 3, CALLS).withColumn("level", F.lit("clash")).withColumn("n_results", F.lit(9)).withColumn("dep", F.lit(1))
    results = spark.createDataFrame([(1, 1, "a", "r")] * 2 + [(None, 2, "a", "no conversation")], RESULTS).withColumn("name", F.lit("clash")).withColumn("errors", F.lit(0))
    got = chat_format.link(calls, results, spark.createDataFrame([("f", "x", "string", False, None)], chat_format.SCHEMA).withColumn("arguments", F.lit(1))).collect()
    assert sorted((str(x["call_id"]), x["level"], x["n_results"], x["errors"]) for x in got if x["conv_id"]) == [("a", 0, 2, [])] * 3
    assert [x["errors"] for x in got if x["conv_id"] is None] == [["call"]]


def test_chat_keeps_every_turn(spark, tmp_path):
    turns = [
        (1, 0, "system", 'be "brief"'), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "and"), (1, 4, "assistant", "so"), (1, 5, "user", "nine char"), (1, 7, "user", "x" * 410), (1, 9, "user", None),
        (2, 0, None, "no role"), (2, 1, "tool", None), (2, 2, "assistant", "alone"), (3, 0, "system", None), (3, 0, "system", None), (3, 1, "User", ""),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def line(*x):
        return hashlib.sha256(canonical(*x).encode()).hexdigest()

    def call(prompt, turn, length="short", tags=("a",)):
        return {"turn": turn, "options": {"tags": list(tags), "length": length}} | ({"prompt": prompt} if prompt is not None else {})

    want = [
        (1, 0, None, None, 0, 0, line(None, None, [], None, "system", 'be "brief"')),
        (1, 1, "1:1", 0, 1, 1, line(call("hi", 1, tags=("a", 1)), "1:1", ["type:options.tags[]"], 0, "reply", "hello")),
        (1, 3, "1:3", 1, 1, 0, line(call("and", 3), "1:3", [], 1, "reply", "so")),
        (1, 5, "1:5", 2, 0, 1, line(call("nine char", 5), "1:5", ["schema"], 2, "note", None)),
        (1, 7, "1:7", 3, 0, 2, line(call("x" * 410, 7, "huge", ("a", 1)), "1:7", ["type:options.tags[]", "value:options.length"], 3, "reply", None)),
        (1, 9, "1:9", 4, 0, 1, line(call(None, 9), "1:9", ["missing:prompt"], 4, "reply", None)),
        (2, 0, None, None, 0, 1, line(None, None, ["role"], None, None, "no role")),
        (2, 1, None, None, 0, 1, line(None, None, ["role"], None, "tool", None)),
        (2, 2, "2:1", None, 1, 1, line(None, "2:1", ["call"], None, None, "alone")),
        (3, 0, None, None, 0, 0, line(None, None, [], None, "system", None)),
        (3, 0, None, None, 0, 0, line(None, None, [], None, "system", None)),
        (3, 1, None, None, 0, 1, line(None, None, ["role"], None, "User", "")),
    ]
    got = chat_format.op3(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
