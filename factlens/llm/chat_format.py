"""Chat formatting: tool calls linked to their results, ordered, checked and serialised, with DataFrame functions only.

Calls and results meet in a hash join by conversation and identifier.  A call's level is
one more than the highest level of the calls it comes after, so that (level, turn,
call_id) is a topological order of its conversation.  Calls that come after one other
call are placed by doubling jumps along their chain, in as many rounds as the logarithm
of its length; calls that come after several are then placed by rounds over them alone.
Each round rewrites one table, so that plans stay as they are however long a chain is.

Arguments are held against the tool's schema, nested objects and arrays included.  Each
linked call is one line of canonical JSON: keys in code point order, no space.

No conversation is gathered into one row or task, so a conversation of any length works.

Defined results: a call without a result has result null, several results of one call
give the earliest by (turn, content) and their number; results without a call are lines
of their own with name null.  Arguments that aren't a JSON object, tools without a
schema, missing, unexpected or wrongly typed fields and values outside a field's list are
errors, listed in order.  A call that comes after an unknown call ignores it; calls in a
cycle, and those after them, have level null.  Null identifiers link with nothing and
have no level.  Repeated calls are lines each.  Turns that neither call nor answer are
lines of their own, with their role as name and their text as result.  Columns beside
the named ones are not read.  Empty tables give no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: name, field (`a`, `a.b` in an object, `a[]` for the items of an array), type (string, integer, number,
#: boolean, array, object), whether it must be there, and the texts of its values where they are a list.
SCHEMA = "name string, field string, type string, required boolean, values array<string>"
#: Schemas up to this number of fields are sent to all tasks; more are joined.
FEW_FIELDS = 10_000
KEY = ["conv_id", "call_id"]
_OPEN, _FIRST, _AFTER_MANY = 0, 1, 2


def _jumps(ids: DataFrame, waits: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(conv_id, call_id, at, dist, kind): each call's way back to the first call of its chain, or to one after several; and whether there are such.

    A call of kind _OPEN is in a cycle or comes after one.
    """
    before = waits.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    kind = F.when(F.col("n").isNull(), _FIRST).when(one, _OPEN).otherwise(_AFTER_MANY)
    first = ids.join(before, KEY, "left").select(*KEY, F.when(one, F.col("dep")).otherwise(F.col("call_id")).alias("at"), one.cast("long").alias("dist"), kind.alias("kind"))
    now, n = scratch.counted(first, "jump-0", open=f"kind = {_OPEN}", many=f"kind = {_AFTER_MANY}")
    left, span, turn = n["open"], 1, 0
    while left and span <= n["open"]:
        turn, span = turn + 1, 2 * span
        there = now.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("to"), F.col("dist").alias("more"), F.col("kind").alias("then"))
        far = now.where(F.col("kind") == _OPEN).join(there.hint("shuffle_hash"), ["conv_id", "at"]).select(*KEY, F.col("to").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.col("then").alias("kind"))
        now, seen = scratch.counted(now.where(F.col("kind") != _OPEN).unionByName(far), f"jump-{turn}", open=f"kind = {_OPEN}")
        left = seen["open"]
        scratch.drop(f"jump-{turn - 1}")
    return now, n["many"]


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) for distinct calls; `calls` has an array `after` of call ids."""
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    ids = known.select(*KEY).distinct()
    waits = known.select(*KEY, F.explode("after").alias("dep")).where("dep IS NOT NULL").distinct()
    waits = scratch.write(waits.join(ids.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"), "waits")
    jump, many = _jumps(ids, waits, scratch)
    alone = F.when(F.col("kind") == _FIRST, F.col("dist"))
    if not many:
        return jump.select(*KEY, alone.alias("level"))
    # what a call after several waits for: the far ends of its predecessors' chains, each by its longest way
    ends = jump.select("conv_id", F.col("call_id").alias("dep"), "at", (F.col("dist") + 1).alias("dist"), "kind")
    mine = jump.where((F.col("kind") == _AFTER_MANY) & (F.col("at") == F.col("call_id"))).select(*KEY)
    ways = scratch.write(waits.join(mine, KEY, "left_semi").join(ends, ["conv_id", "dep"]).groupBy(*KEY, "at", "kind").agg(F.max("dist").alias("dist")), "ways")
    best, waiting = F.max(F.when(F.col("kind") == _FIRST, F.col("dist"))), F.count(F.when(F.col("kind") != _FIRST, 1))
    state = ways.groupBy(*KEY).agg(best.alias("best"), waiting.alias("left")).withColumn("turn", F.when(F.col("left") == 0, 0))
    state, seen = scratch.counted(state, "state-0", new="turn = 0")
    ways, turn = ways.where(F.col("kind") == _AFTER_MANY), 0
    while seen["new"]:
        newest = state.where(F.col("turn") == turn).select("conv_id", F.col("call_id").alias("at"), F.col("best").alias("there"))
        hits = ways.join(newest, ["conv_id", "at"]).groupBy(*KEY).agg(F.max(F.col("dist") + F.col("there")).alias("way"), F.count("*").alias("met"))
        left = F.col("left") - F.coalesce("met", F.lit(0))
        turn += 1
        moved = state.join(hits, KEY, "left").select(*KEY, F.greatest("best", "way").alias("best"), left.alias("left"), F.when((F.col("left") > 0) & (left == 0), turn).otherwise(F.col("turn")).alias("turn"))
        state, seen = scratch.counted(moved, f"state-{turn}", new=f"turn = {turn}")
        scratch.drop(f"state-{turn - 1}")
    placed = state.where("left = 0").select("conv_id", F.col("call_id").alias("at"), F.col("best").alias("there"))
    return jump.join(placed, ["conv_id", "at"], "left").select(*KEY, F.coalesce(alone, F.when(F.col("kind") == _AFTER_MANY, F.col("dist") + F.col("there"))).alias("level"))


def _kind(v: Column) -> Column:
    """JSON type of a variant."""
    t = F.schema_of_variant(v)
    whole = (t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(t == "STRING", "string").when(whole, "integer").when(t.startswith("DECIMAL") | (t == "DOUBLE"), "number").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("null")
    )


def _parent(field: Column) -> Column:
    """`a` of `a.b` and of `a[]`, and the empty text of `a`."""
    return F.regexp_extract(field, r"^(.*?)(?:\.[^.\[\]]+|\[\])$", 1)


def _found(parsed: Column, depth: int) -> Column:
    """(path, kind, text) of the values in a variant, to that depth."""
    part = "array<struct<path:string,value:variant>>"
    level, out = F.array(F.struct(F.lit("").alias("path"), parsed.alias("value"))), []

    def inside(e: Column) -> Column:
        fields = F.transform(F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")), lambda x: F.struct(F.concat(e["path"], F.when(e["path"] == "", "").otherwise("."), x["key"]).alias("path"), x["value"].alias("value")))
        items = F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda x: F.struct(F.concat(e["path"], F.lit("[]")).alias("path"), x.alias("value")))
        return F.coalesce(fields, items, F.array().cast(part))

    for _ in range(depth):
        level = F.flatten(F.transform(level, inside))
        out.append(F.transform(level, lambda e: F.struct(e["path"].alias("path"), _kind(e["value"]).alias("kind"), F.try_variant_get(e["value"], "$", "string").alias("text"))))
    return F.concat(*out)


def argument_errors(arguments: Column, given: Column, fields: Column) -> Column:
    """Errors of a JSON text, with the values found in it, against fields (array of field, type, required, values); null fields mean no schema."""
    parsed = F.try_parse_json(arguments)
    at = lambda path: F.filter(given, lambda e: e["path"] == path)
    fits = lambda e, f: (e["kind"] == f["type"]) | ((f["type"] == "number") & (e["kind"] == "integer"))

    def lacks(f: Column) -> Column:
        up = _parent(f["field"])
        around = F.when(up == "", 1).otherwise(F.size(F.filter(given, lambda e: (e["path"] == up) & (e["kind"] == "object"))))
        return f["required"] & (F.size(at(f["field"])) < around)

    def marked(mark: str, test) -> Column:
        return F.transform(F.filter(fields, test), lambda f: F.concat(F.lit(f"{mark}:"), f["field"]))

    missing = marked("missing", lacks)
    wrong = marked("type", lambda f: F.exists(at(f["field"]), lambda e: ~fits(e, f)))
    other = marked("value", lambda f: f["values"].isNotNull() & F.exists(at(f["field"]), lambda e: fits(e, f) & ~F.coalesce(F.array_contains(f["values"], e["text"]), F.lit(False))))
    closed = lambda path: (path == "") | F.exists(fields, lambda f: _parent(f["field"]) == path)
    extra = F.filter(given, lambda e: ~e["path"].endswith("[]") & ~F.exists(fields, lambda f: f["field"] == e["path"]) & closed(_parent(e["path"])))
    extra = F.array_distinct(F.transform(extra, lambda e: F.concat(F.lit("unexpected:"), e["path"])))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("arguments"))).when(fields.isNull(), F.array(F.lit("schema"))).otherwise(F.array_sort(F.concat(missing, wrong, other, extra)))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, call_id, name, level, n_results, errors, json), a row for each call, each result without one and each other turn.

    calls (conv_id, turn, call_id, name, arguments, after); results (conv_id, turn,
    call_id, content); schemas as SCHEMA, one row a field; others (conv_id, turn, role,
    content), whose role is an error unless it is system.
    """
    scratch = Scratch(calls.sparkSession, "chat-format")
    null = lambda t: F.lit(None).cast(t)
    level = levels(calls, scratch)
    answer = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
    parts = F.size(F.split("field", r"\.|\[\]", -1))
    n, depth = schemas.agg(F.count("*"), F.max(parts)).first()
    fields = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required", "values"))).alias("fields"))
    linked = calls.select("conv_id", "turn", "call_id", "name", "arguments").join(answer.hint("shuffle_hash"), KEY, "left").join(level.hint("shuffle_hash"), KEY, "left").join(F.broadcast(fields) if n <= FEW_FIELDS else fields, "name", "left")
    # the values are found once and then asked by every check
    linked = linked.withColumn("given", F.when(F.col("fields").isNotNull(), _found(F.try_parse_json("arguments"), depth or 1)))
    linked = linked.select("conv_id", "turn", "call_id", "name", "arguments", "level", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("first.content").alias("result"), argument_errors(F.col("arguments"), F.col("given"), F.col("fields")).alias("errors"))
    named = calls.where("call_id IS NOT NULL").select(*KEY).distinct()
    alone = results.join(named, KEY, "left_anti").select("conv_id", "turn", "call_id", null("string").alias("name"), null("string").alias("arguments"), null("long").alias("level"), F.lit(1).cast("long").alias("n_results"), F.col("content").alias("result"), F.array(F.lit("call")).alias("errors"))
    rows = linked.union(alone)
    if others is not None:
        unknown = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array(F.lit("role")))
        rows = rows.union(others.select("conv_id", "turn", null("string").alias("call_id"), F.col("role").alias("name"), null("string").alias("arguments"), null("long").alias("level"), F.lit(0).cast("long").alias("n_results"), F.col("content").alias("result"), unknown.alias("errors")))
    # a variant keeps an object's keys sorted; text that isn't JSON stays text
    text = F.to_json(F.struct(F.col("arguments").alias("x")))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.expr("substring(to_json(struct(arguments AS x)), 6, length(to_json(struct(arguments AS x))) - 6)"), text)
    body = F.to_json(F.struct("call_id", "errors", "level", "name", "result"), {"ignoreNullFields": "false"})
    json = F.concat(F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), "null").otherwise(arguments), F.lit(","), F.substring(body, 2, (1 << 31) - 1))
    return rows.select("conv_id", "turn", "call_id", "name", "level", "n_results", "errors", json.alias("json"))


#: What the query's tool takes.
REPLY = [
    ("reply", "prompt", "string", True, None), ("reply", "turn", "integer", True, None), ("reply", "options", "object", True, None),
    ("reply", "options.length", "string", True, ["short", "long"]), ("reply", "options.tags", "array", False, None), ("reply", "options.tags[]", "string", False, None),
]


def op3(spark, sf_dir: str) -> DataFrame:
    """Conversations read as tool use: a user turn calls the assistant, whose next turn is the result.

    Each call comes after the one of the exchange before it.  The tool, its arguments and
    their faults go by the length of the turn's text: other tools have no schema, and
    arguments may be no JSON, of a wrong type, unknown, or outside a list.  Turns of any
    other role, or of none, are kept as lines without a call.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    n = F.coalesce(F.length("text"), F.lit(0))
    length = F.when(n < 40, "short").when(n < 400, "long").otherwise("huge")
    tags = F.when(n % 3 == 2, F.lit('["a",1]')).otherwise(F.lit('["a"]'))
    turn = F.when(n % 7 == 6, F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    prompt = F.when(F.col("text").isNull(), "").otherwise(F.concat(F.lit(","), F.expr("substring(to_json(struct(text AS prompt)), 2, length(to_json(struct(text AS prompt))) - 2)")))
    extra = F.when(n % 13 == 12, ',"extra":null').otherwise("")
    whole = F.concat(F.lit('{"turn":'), turn, F.lit(',"options":{"tags":'), tags, F.lit(',"length":"'), length, F.lit('"}'), prompt, extra, F.lit("}"))
    arguments = F.when(n % 11 == 10, F.concat(F.lit("{{"), F.coalesce("text", F.lit("")))).otherwise(whole)
    calls = turns.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(n % 5 == 4, "note").otherwise("reply").alias("name"), arguments.alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    others = turns.where("coalesce(role, '') NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    out = link(calls, results, spark.createDataFrame(REPLY, SCHEMA), others)
    return out.select("conv_id", "turn", "call_id", "level", "n_results", F.size("errors").cast("long").alias("n_errors"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


OP3_SQL = r"""
WITH RECURSIVE turns AS (SELECT *, coalesce(length(text), 0) AS n FROM conversations),
calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS dep, n % 5 = 4 AS other, n % 11 = 10 AS broken,
         CASE WHEN n % 11 = 10 THEN CAST(to_json('{{' || coalesce(text, '')) AS VARCHAR)
              ELSE '{' || CASE WHEN n % 13 = 12 THEN '"extra":null,' ELSE '' END || '"options":{"length":"' || CASE WHEN n < 40 THEN 'short' WHEN n < 400 THEN 'long' ELSE 'huge' END
                   || '","tags":' || CASE WHEN n % 3 = 2 THEN '["a",1]' ELSE '["a"]' END || '},' || coalesce('"prompt":' || to_json(text) || ',', '')
                   || '"turn":' || CASE WHEN n % 7 = 6 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '}' END AS arguments,
         list_filter([CASE WHEN text IS NULL THEN 'missing:prompt' END, CASE WHEN n % 3 = 2 THEN 'type:options.tags[]' END, CASE WHEN n % 7 = 6 THEN 'type:turn' END,
                      CASE WHEN n % 13 = 12 THEN 'unexpected:extra' END, CASE WHEN n >= 400 THEN 'value:options.length' END], lambda x: x IS NOT NULL) AS faults
  FROM turns WHERE role = 'user'),
results AS (
  SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
lev AS (
  SELECT conv_id, call_id, 0::BIGINT AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.call_id = c.dep)
  UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM calls c JOIN lev l ON c.conv_id = l.conv_id AND c.dep = l.call_id),
ans AS (
  SELECT conv_id, call_id, arg_min(content, turn) AS result, count(*) AS n_results FROM results GROUP BY conv_id, call_id),
rows_ AS (
  SELECT c.conv_id, c.turn, c.call_id, CASE WHEN other THEN 'note' ELSE 'reply' END AS name, c.arguments, l.level, coalesce(a.n_results, 0) AS n_results, a.result,
         CASE WHEN broken THEN ['arguments'] WHEN other THEN ['schema'] ELSE faults END AS errors
  FROM calls c LEFT JOIN lev l USING (conv_id, call_id) LEFT JOIN ans a USING (conv_id, call_id)
  UNION ALL
  SELECT r.conv_id, r.turn, r.call_id, NULL, 'null', NULL, 1, r.content, ['call']
  FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
  UNION ALL
  SELECT conv_id, turn, NULL, role, 'null', NULL, 0, text, CASE WHEN role = 'system' THEN [] ELSE ['role'] END
  FROM conversations WHERE coalesce(role, '') NOT IN ('user', 'assistant'))
SELECT conv_id, turn, call_id, level, CAST(n_results AS BIGINT) AS n_results, CAST(len(errors) AS BIGINT) AS n_errors,
       sha256('{"arguments":' || arguments || ',"call_id":' || coalesce('"' || call_id || '"', 'null') || ',"errors":' || CAST(to_json(errors) AS VARCHAR) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
              || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}') AS json_sha256
FROM rows_
"""
