"""Queries of the other operators: versions, trees, texts, tests, coverage, lineage and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators import analysis, bodies, compare, diff, history, lineage, nav, scopes, traverse
from factlens.plans import sqlnav
from factlens.sources import database, publication, shared, testruns
from factlens.sources.facts import SCHEMAS, TABLES, Facts, read_parquet, write_parquet

from .catalog import ORACLE, QUERIES, ids, query, text_query

_N = "CAST(substr(id, 3) AS BIGINT)"


def _number(c: str = "id"):
    return F.expr(f"cast(substring({c}, 3) as bigint)")


def _parts(f: Facts) -> DataFrame:
    """Functions with their number."""
    return f.symbols.where("kind = 'func'").withColumn("n", _number())


# --- walks without a bound -----------------------------------------------------------------
_RING = "SELECT 'p:' || p_partkey AS source, 'p:' || (p_partkey // 20 * 20 + (p_partkey + 1) % 20) AS target FROM part"


def _ring(f: Facts) -> DataFrame:
    """Rings of twenty functions."""
    n = F.col("n")
    to = F.floor(n / 20) * 20 + (n + 1) % 20
    return _parts(f).select(F.col("id").alias("source"), F.concat(F.lit("p:"), to.cast("string")).alias("target"))


query(f", r AS ({_RING}), n AS (SELECT source AS id FROM r UNION SELECT target FROM r), m AS (SELECT {_N} // 20 AS ring, min(id) AS component, count(*) AS k FROM n GROUP BY 1) SELECT id, CASE WHEN k = 20 AND {_N} // 20 NOT IN (SELECT {_N} // 20 FROM n WHERE id NOT IN (SELECT source FROM r)) THEN component ELSE id END AS component FROM n JOIN m ON ring = {_N} // 20", "strong_components")(lambda f: traverse.strong_components(_ring(f)))
_LINKS = 250


def _long(f: Facts) -> tuple[DataFrame, DataFrame]:
    """A chain of 250 snapshots, each setting or deleting some keys."""
    n = F.col("n")
    snapshots = f.spark.range(1, _LINKS + 1).select(F.col("id").alias("ordinal"), F.when(F.col("id") > 1, F.col("id") - 1).alias("base"))
    deltas = _parts(f).select((n % _LINKS + 1).alias("ordinal"), (n % 499).cast("string").alias("key"), F.when(n % 13 == 0, "delete").otherwise("set").alias("op"), n.alias("fp")).groupBy("ordinal", "key").agg(F.max_by(F.struct("op", "fp"), "fp").alias("x")).select("ordinal", "key", "x.*")
    return snapshots, deltas


query(f", d AS (SELECT p_partkey % {_LINKS} + 1 AS ordinal, CAST(p_partkey % 499 AS VARCHAR) AS key, CASE WHEN max(p_partkey) % 13 = 0 THEN 'delete' ELSE 'set' END AS op, max(p_partkey) AS fp FROM part GROUP BY 1, 2) SELECT key, arg_max(fp, ordinal) AS fp FROM d GROUP BY key HAVING arg_max(op, ordinal) = 'set'", "effective_long_chain")(
    lambda f: (lambda s, d: history.effective(d, history.chain(s, _LINKS), "key").select("key", "fp"))(*_long(f))
)
query(
    ", e AS (SELECT * FROM edges WHERE CAST(substr(source, 3) AS BIGINT) < CAST(substr(target, 3) AS BIGINT)), w(source, target) AS (SELECT source, target FROM e WHERE CAST(substr(source, 3) AS BIGINT) % 4 <> 0 UNION SELECT w.source, e.target FROM w JOIN e ON e.source = w.target WHERE CAST(substr(w.target, 3) AS BIGINT) % 4 = 0) SELECT source, target FROM w WHERE CAST(substr(target, 3) AS BIGINT) % 4 <> 0", "graph_absorb"
)(lambda f: traverse.absorb(f.edges.where(_number("source") < _number("target")), ids(_parts(f).where("n % 4 = 0"))))
query(", c AS (SELECT enclosing_id AS source, symbol_id AS target, 'call' AS kind, path, line FROM occurrences WHERE role = 'call' AND symbol_id IS NOT NULL), o AS (SELECT owner_id AS source, symbol_id AS target, 'call' AS kind, path, line FROM occurrences JOIN symbols s ON s.id = enclosing_id WHERE role = 'call' AND symbol_id IS NOT NULL AND line % 2 = 0) SELECT source, count(*) AS n FROM c GROUP BY source", "fold_covered_sites")(lambda f: _covered(f))


def _covered(f: Facts) -> DataFrame:
    """Calls of methods, and the even lines again as calls of their owners, which the methods cover."""
    calls = f.occurrences.where("role = 'call' AND symbol_id IS NOT NULL").select(F.col("enclosing_id").alias("source"), F.col("symbol_id").alias("target"), F.lit("call").alias("kind"), "path", "line")
    owners = f.symbols.where("owner_id IS NOT NULL").select("id", F.col("owner_id").alias("owner"))
    again = calls.where("line % 2 = 0").join(owners.withColumnRenamed("id", "source"), "source").select(F.col("owner").alias("source"), "target", "kind", "path", "line")
    return traverse.covered_sites(calls.union(again), owners).groupBy("source").agg(F.count("*").alias("n"))


# --- versions and maintenance ----------------------------------------------------------------
query("SELECT type_id, interface_id FROM implements WHERE CAST(substr(type_id, 3) AS BIGINT) % 3 <> 0", "implements_pairs")(lambda f: _pairs(f))


def _pairs(f: Facts) -> DataFrame:
    """Pairs set at the first snapshot, every third one deleted at a later one."""
    first = f.implements.select("type_id", "interface_id", F.lit(1).cast("long").alias("ordinal"), F.lit("set").alias("op"))
    later = f.implements.where(_number("type_id") % 3 == 0).select("type_id", "interface_id", F.lit(4).cast("long").alias("ordinal"), F.lit("delete").alias("op"))
    return history.effective(first.union(later), history.chain(f.snapshots, 6), "type_id", "interface_id").select("type_id", "interface_id")


query("SELECT (SELECT count(*) FROM files) AS files, (SELECT coalesce(sum(strlen(content)), 0) FROM files)::BIGINT AS bytes, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM occurrences) AS occurrences", "snapshot_sizes")(lambda f: history.sizes(f.files, f.symbols, f.occurrences))
query("SELECT package, CAST(count(*) + 1 AS BIGINT) AS stated, count(*) AS found FROM files WHERE package LIKE '%e%' GROUP BY package", "package_reconciled")(
    lambda f: history.reconciled(f.files.groupBy("package").agg((F.count("*") + F.when(F.col("package").contains("e"), 1).otherwise(0)).alias("documents")), f.files)
)
query(", d(ordinal, on_) AS (SELECT i, i // 2 FROM (SELECT unnest(range(2, 32)) AS i)), k(ordinal) AS (SELECT unnest([11, 29, 30, 31]) UNION SELECT on_ FROM k JOIN d USING (ordinal)) SELECT CAST(ordinal AS BIGINT) AS ordinal, CAST(lag(ordinal) OVER (ORDER BY ordinal) AS BIGINT) AS new_base FROM k", "prune_dependencies")(
    lambda f: history.kept_snapshots(f.snapshots, 3, f.snapshots.where("ordinal = 11"), f.snapshots.where("ordinal > 1").select("ordinal", F.floor(F.col("ordinal") / 2).alias("on")))
)
query("SELECT CAST(CASE WHEN ordinal <= 7 THEN 7 WHEN ordinal <= 19 THEN 19 ELSE 31 END AS BIGINT) AS ordinal, key, arg_max(op, ordinal) AS op, arg_max(coalesce(fp, -1), ordinal) AS fp FROM deltas GROUP BY 1, 2", "prune_rebased")(
    lambda f: history.rebased(f.deltas, f.snapshots.where("ordinal IN (7, 19, 31)")).withColumn("fp", F.coalesce("fp", F.lit(-1)))
)
query("SELECT id FROM symbols WHERE kind = 'interface' AND id NOT IN (SELECT interface_id FROM implements) AND id NOT IN (SELECT target_id FROM supplied)", "prune_orphans")(
    lambda f: ids(history.orphans(f.symbols.where("kind = 'interface'"), ids(f.implements, "interface_id"), f.relationships.select(F.explode("targets").alias("id"))))
)
query(f", x AS (SELECT id, package, {_N} AS n FROM symbols WHERE kind = 'func'), t AS (SELECT package, id, row_number() OVER (PARTITION BY package ORDER BY id) AS number FROM x WHERE n % 3 = 0) SELECT id, CAST(number AS INT) AS number FROM t UNION ALL SELECT id, CAST(coalesce((SELECT max(number) FROM t WHERE t.package = x.package), 0) + row_number() OVER (PARTITION BY package ORDER BY id) AS INT) FROM x WHERE n % 3 <> 0", "surrogate_numbers")(lambda f: _numbers(f))


def _numbers(f: Facts) -> DataFrame:
    """Every third function is numbered first, then the rest go on."""
    items = _parts(f).select("package", "id", "n")
    first = history.dense_numbers(items.where("n % 3 = 0").drop("n"), "package", order="id")
    return history.dense_numbers(items.drop("n"), "package", order="id", taken=first).select("id", "number")


query(f", x AS (SELECT id AS key, package, {_N} AS n FROM symbols WHERE kind = 'func') SELECT key, CASE WHEN n % 7 = 1 THEN 'delete' ELSE 'set' END AS op, CASE WHEN n % 7 = 1 THEN NULL WHEN n % 7 = 2 THEN 2 ELSE 1 END AS fp, CASE WHEN n % 7 = 1 OR n % 7 = 3 THEN 1 ELSE 2 END AS generation FROM x WHERE n % 7 IN (1, 2, 3) AND package <> 'PARTS/ECONOMY'", "snapshot_deltas")(lambda f: _deltas(f))


def _deltas(f: Facts) -> DataFrame:
    n = F.col("n")
    s = _parts(f).select(F.col("id").alias("key"), "package", "n", F.lit(1).alias("fp"), F.lit(1).alias("generation"))
    changed = s.select("package").distinct().where("package != 'PARTS/ECONOMY'")
    return history.symbol_deltas(s.where(n % 7 != 3), s.where(n % 7 != 1).withColumn("fp", F.when(n % 7 == 2, 2).otherwise(1)), changed).withColumn("fp", F.col("fp").cast("int")).withColumn("generation", F.col("generation").cast("int"))


query("SELECT path FROM files WHERE doc_id % 2 = 1", "document_reuse")(
    lambda f: (lambda d: history.unseen(d, d.where("n % 2 = 0")).select("path"))(analysis.file_rows(f.files, True).select(F.col("package").alias("root"), "path", "digest", F.substring_index("path", "/", -1).cast("long").alias("n")))
)
query("SELECT CAST(9 AS BIGINT) AS snapshot, key FROM deltas WHERE ordinal = 8", "carry_forward")(lambda f: history.carry_forward(f.deltas.select(F.col("ordinal").alias("snapshot"), "key"), 8, 9))
query("SELECT package, name, string_agg(id, ',' ORDER BY id) AS members FROM symbols WHERE kind = 'func' GROUP BY package, name", "tree_coalesce")(
    lambda f: history.coalesce_types(f.symbols.where("kind = 'func'").select("module", "package", "name", F.array("id").alias("members"), F.col("id").alias("source"))).select("package", "name", F.array_join("members", ",").alias("members"))
)
query("SELECT package, array_to_string(list_sort(list(DISTINCT name)), ',') AS members, count(DISTINCT name) AS n FROM symbols WHERE kind = 'func' GROUP BY package", "group_by_package")(lambda f: analysis.grouped_by_package(f.symbols.where("kind = 'func'")).withColumn("members", F.array_join("members", ",")))

# --- trees -----------------------------------------------------------------------------------
_TREE = ", tree AS (SELECT 'm:' || module AS id, NULL AS parent, 'module' AS kind, module AS name, 'public' AS visibility, '' AS body, 0 AS depth, module, NULL AS package FROM (SELECT DISTINCT module FROM symbols) UNION ALL SELECT id, 'm:' || module, kind, name, visibility, coalesce(param, ''), 1, module, package FROM symbols WHERE kind = 'record' UNION ALL SELECT s.id, s.owner_id, s.kind, s.name, s.visibility, coalesce(s.param, ''), 2, s.module, s.package FROM symbols s JOIN symbols o ON o.id = s.owner_id AND o.kind = 'record' WHERE s.kind = 'method')"


def _tree(f: Facts) -> DataFrame:
    """Modules, their records, and the records' methods, as one tree."""
    s = f.symbols.withColumn("body", F.coalesce(F.get("params", F.lit(0)), F.lit("")))
    cols = ("id", "parent", "kind", "name", "visibility", "body", "depth", "module", "package")
    top = s.select("module").distinct().select(F.concat(F.lit("m:"), "module").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("module").alias("kind"), F.col("module").alias("name"), F.lit("public").alias("visibility"), F.lit("").alias("body"), F.lit(0).alias("depth"), "module", F.lit(None).cast("string").alias("package"))
    records = s.where("kind = 'record'").withColumn("parent", F.concat(F.lit("m:"), "module")).withColumn("depth", F.lit(1))
    methods = s.where("kind = 'method'").withColumnRenamed("owner_id", "parent").join(ids(records).withColumnRenamed("id", "parent"), "parent", "left_semi").withColumn("depth", F.lit(2))
    return top.select(*cols).union(records.select(*cols)).union(methods.select(*cols))


query(f"{_TREE} SELECT id, depth FROM tree WHERE kind <> 'module' AND depth <= 1 AND (name ILIKE '%001' OR name ILIKE 'customer#00000002%') AND name NOT ILIKE '%7' ORDER BY depth, id LIMIT 40", "tree_find")(
    lambda f: diff.tree_find(_tree(f), not_kinds=["module"], name="*001, Customer#00000002*, !*7", depth=1, limit=40).select("id", "depth")
)
query(f"{_TREE} SELECT id, package, kind, CASE WHEN parent LIKE 'm:%' THEN NULL ELSE parent END AS owner_id FROM tree WHERE kind <> 'module'", "node_publication")(lambda f: diff.node_publication(_tree(f)).select("id", "package", "kind", "owner_id"))


def _digest_sql(*parts: str) -> str:
    return "sha256(" + " || ".join(f"strlen({p}) || ':' || {p} || ','" for p in parts) + ")"


_LAYERS = (
    f"{_TREE}, l2 AS (SELECT id, parent, CASE WHEN visibility = 'public' THEN {_digest_sql('kind', 'name', chr(39) * 2)} END AS pub, {_digest_sql('kind', 'name', 'visibility', chr(39) * 2)} AS priv, {_digest_sql('kind', 'name', 'body', chr(39) * 2)} AS cont FROM tree WHERE depth = 2), "
    f"s2 AS (SELECT parent, coalesce(string_agg(pub, ',' ORDER BY pub), '') AS pub, string_agg(priv, ',' ORDER BY priv) AS priv, string_agg(cont, ',' ORDER BY cont) AS cont FROM l2 GROUP BY parent), "
    f"j1 AS (SELECT t.*, coalesce(pub, '') AS a, coalesce(priv, '') AS b, coalesce(cont, '') AS c FROM tree t LEFT JOIN s2 ON s2.parent = t.id WHERE depth = 1) "
    f"SELECT id, CASE WHEN visibility = 'public' THEN {_digest_sql('kind', 'name', 'a')} END AS public, {_digest_sql('kind', 'name', 'visibility', 'b')} AS private, {_digest_sql('kind', 'name', 'body', 'c')} AS content FROM j1"
)
query(_LAYERS, "layered_hash")(lambda f: diff.tree_layers(_tree(f)).join(ids(f.symbols.where("kind = 'record'")), "id", "left_semi"))

# --- differences -------------------------------------------------------------------------------
query(f"SELECT id AS key, CASE WHEN {_N} % 6 = 0 THEN 'rename_move' WHEN {_N} % 2 = 0 THEN 'moved' ELSE 'renamed' END AS change FROM symbols WHERE kind = 'func' AND ({_N} % 2 = 0 OR {_N} % 3 = 0)", "relocation")(
    lambda f: _parts(f).select(F.col("id").alias("key"), compare.relocation(F.col("package"), F.concat("package", F.when(F.col("n") % 2 == 0, "/x").otherwise("")), F.col("name"), F.concat("name", F.when(F.col("n") % 3 == 0, "!").otherwise(""))).alias("change")).where("change IS NOT NULL")
)


def _layer(f: Facts) -> DataFrame:
    n = F.col("n")
    old = {k: F.lit(0) for k in ("public", "private", "content")}
    new = {"public": (n % 5 == 0).cast("int"), "private": (n % 3 == 0).cast("int"), "content": (n % 2 == 0).cast("int")}
    return _parts(f).select(F.col("id").alias("key"), compare.layer(old, new).alias("layer"))


query(f"SELECT id AS key, CASE WHEN {_N} % 5 = 0 THEN 'public' WHEN {_N} % 3 = 0 THEN 'private' WHEN {_N} % 2 = 0 THEN 'content' END AS layer FROM symbols WHERE kind = 'func'", "changed_layer")(_layer)
query(f"SELECT CASE WHEN {_N} % 5 = 0 THEN 'public' WHEN {_N} % 3 = 0 THEN 'private' ELSE 'content' END AS reason, count(*) AS n FROM symbols WHERE kind = 'func' AND ({_N} % 5 = 0 OR {_N} % 3 = 0 OR {_N} % 2 = 0) GROUP BY 1", "change_counts")(lambda f: analysis.change_counts(_layer(f).where("layer IS NOT NULL"), "layer"))
query(f"SELECT id AS key FROM symbols WHERE kind = 'func' AND {_N} % 2 = 0", "format_only")(
    lambda f: compare.format_only(_parts(f).select(F.col("id").alias("key"), F.lit("h").alias("old_hash"), F.lit("h").alias("new_hash"), F.col("name").alias("old_text"), F.when(F.col("n") % 2 == 0, F.concat("name", F.lit(" "))).otherwise(F.col("name")).alias("new_text")))
)
query("SELECT key, change FROM (SELECT id AS key, visibility, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 2 = 0 THEN 'structure' ELSE 'body' END AS change FROM symbols WHERE kind = 'record') WHERE visibility = 'public' AND change <> 'structure'", "visibility_filter")(
    lambda f: diff.shown(f.symbols.where("kind = 'record'").select(F.col("id").alias("key"), "visibility", F.when(_number() % 2 == 0, "structure").otherwise("body").alias("change")), "exported").select("key", "change")
)
query("SELECT id, 'Order(' || name || ')' AS shape FROM symbols WHERE kind = 'record'", "moved_shape")(
    lambda f: f.symbols.where("kind = 'record'").select("id", diff.plain_shape(F.concat(F.substring_index("package", "/", -1), F.lit(".Order("), F.lit("new."), "name", F.lit(")")), F.col("package"), F.lit("x/new")).alias("shape"))
)
query(f"SELECT package, nth, old, new FROM (SELECT package, nth, max(CASE WHEN side = 0 THEN name END) AS old, max(CASE WHEN side = 1 THEN name END) AS new FROM (SELECT package, name || ' ' || id AS name, {_N} % 2 AS side, CAST(row_number() OVER (PARTITION BY package, {_N} % 2 ORDER BY name || ' ' || id) AS INT) AS nth FROM symbols WHERE kind = 'func') GROUP BY 1, 2)", "paired_kth")(
    lambda f: (lambda d: diff.paired(d.where("n % 2 = 0").select("package", "name"), d.where("n % 2 = 1").select("package", "name"), "package", "name").select("package", "nth", F.col("name").alias("old"), F.col("new_name").alias("new")))(_parts(f).withColumn("name", F.concat_ws(" ", "name", "id")))
)
query("SELECT package AS name, max(id) AS member FROM symbols WHERE kind = 'func' GROUP BY package HAVING count(*) > 2", "column_reorder")(lambda f: _reordered(f))


def _reordered(f: Facts) -> DataFrame:
    """Members of a package in order, and again with the last one first."""
    m = F.array_sort(F.collect_list("id"))
    t = f.symbols.where("kind = 'func'").groupBy(F.col("package").alias("name")).agg(m.alias("old")).where("size(old) > 2")
    return diff.reordered(t.withColumn("new", F.concat(F.slice("old", -1, 1), F.expr("slice(old, 1, size(old) - 1)"))))


text_query("token_changes", lambda t: compare.token_changes(t.select("key", "old", "new"), same=False).groupBy("key", "op").agg(F.count("*").alias("n")).where("op = '+'").select("key", "n"), "SELECT key, CAST(5 AS BIGINT) AS n FROM l")
query("SELECT id AS key, 'moved' AS change FROM symbols WHERE kind = 'func'", "statement_moves")(
    lambda f: compare.statement_changes(_parts(f).select(F.col("id").alias("key"), F.array(*map(F.lit, "abcd")).alias("old"), F.array(*map(F.lit, "bcda")).alias("new"))).select("key", "change")
)
query("SELECT row_number() OVER (ORDER BY ordinal) * 0 + ordinal AS ordinal, 'warning' AS severity, 'snapshot ' || ordinal || ' has partial coverage' AS message FROM (SELECT unnest(range(5, 32, 5)) AS ordinal)", "gap_violations")(lambda f: analysis.gap_violations(f.snapshots.union(f.snapshots)).select(F.regexp_extract("message", r"\d+", 0).cast("long").alias("ordinal"), "severity", "message"))
_FOUND = ", v AS (SELECT DISTINCT enclosing_id || ' calls ' || symbol_id AS message, path, line, enclosing_id AS symbol FROM occurrences JOIN symbols c ON c.id = enclosing_id WHERE role = 'call' AND symbol_id IN (SELECT id FROM red) AND c.visibility = 'private')"
_RULE = {"name": "no-private-red", "severity": "error", "query": "SELECT symbol.id AS symbol, symbol_id AS callee, path, line FROM callers('func:red *') WHERE symbol.visibility = 'private'", "message": "{symbol} calls {callee}"}
for _key in ("path", "symbol"):
    query(f"{_FOUND} SELECT {_key}, count(*) AS n, 'error' AS worst, string_agg(message, ',' ORDER BY line, message) AS messages FROM v GROUP BY {_key}", f"lint_by_{_key}")(lambda f, k=_key: analysis.findings_by(analysis.lint(f, [_RULE]), k).withColumn("messages", F.array_join("messages", ",")))
query("SELECT 'no-private-red' AS rule, message, path, line FROM (" + _FOUND.removeprefix(", v AS (").removesuffix(")") + ") WHERE (path LIKE 'ASIA/%' OR path LIKE 'EUROPE/%') AND path NOT LIKE 'ASIA/NATION_2/%'", "lint_selection")(
    lambda f: analysis.lint(f, [{**_RULE, "include": ["ASIA/**", "EUROPE/**"], "exclude": ["ASIA/NATION_2/**"]}]).select("rule", "message", "path", "line")
)

# --- tests and coverage --------------------------------------------------------------------------
query(", s AS (SELECT * FROM results WHERE (run_id + 6) % 12 >= 4 AND run_id <= 12) SELECT test_id, arg_max(outcome, [run_id, attempt]) AS outcome FROM s GROUP BY test_id", "results_since")(lambda f: analysis.last_outcome(analysis.since_started(f.results, f.runs, 4)))


def _blocks(f: Facts) -> DataFrame:
    """A text profile: a block for each call, each twice, and a line that is none."""
    o = f.occurrences.where("role = 'call'").select("path", "line", "column").distinct()
    line = F.concat_ws("", F.col("path"), F.lit(":"), F.col("line"), F.lit("."), F.col("column"), F.lit(","), F.col("line") + 1, F.lit("."), F.col("column"), F.lit(" 2 "), F.col("line") % 2)
    text = o.select(line.alias("value"))
    return analysis.coverage_blocks(text.union(text).union(f.spark.createDataFrame([("mode: set",)], "value string")))


query("SELECT DISTINCT path, line, 2::BIGINT AS statements, (line % 2 * 2)::BIGINT AS count, column_ AS col FROM occurrences WHERE role = 'call'", "coverage_blocks")(lambda f: _blocks(f).select("path", "line", "statements", "count", "col"))
query(", b AS (SELECT DISTINCT path, line, column_, 2 AS statements, CASE WHEN line % 2 = 1 THEN 2 ELSE 0 END AS covered FROM occurrences WHERE role = 'call'), u AS (SELECT path, line, sum(statements) AS statements, sum(covered) AS covered FROM b GROUP BY 1, 2), e AS (SELECT 'c:' || c_custkey AS id, package || '/1995-01' AS path, c_custkey % 7 AS first, c_custkey % 7 + 4 AS last FROM customers WHERE c_custkey % 5 = 0), w AS (SELECT u.*, e.id, row_number() OVER (PARTITION BY u.path, u.line ORDER BY last - first, e.id) AS r FROM u JOIN e ON e.path = u.path AND u.line BETWEEN e.first AND e.last) SELECT path, id, CAST(sum(statements) AS BIGINT) AS statements, CAST(sum(covered) AS BIGINT) AS covered FROM w WHERE r = 1 GROUP BY path, id", "coverage_innermost")(
    lambda f: analysis.innermost(_blocks(f).groupBy("path", "line").agg(F.sum("statements").alias("statements"), F.sum(F.when(F.col("count") > 0, F.col("statements")).otherwise(0)).alias("covered")), f.extents.select("path", F.col("symbol_id").alias("id"), "first", "last"))
)
query(", t AS (SELECT id AS test_id, id AS symbol_id FROM symbols WHERE kind = 'func' AND name LIKE 'red %'), w(test_id, symbol_id, k) AS (SELECT test_id, symbol_id, 0 FROM t UNION SELECT w.test_id, e.target, k + 1 FROM w JOIN edges e ON e.source = w.symbol_id WHERE k < 2) SELECT test_id, sha256(string_agg(strlen(symbol_id || chr(10) || '1') || ':' || symbol_id || chr(10) || '1,', '' ORDER BY symbol_id)) AS digest FROM (SELECT DISTINCT test_id, symbol_id FROM w) GROUP BY test_id", "closure_walk")(
    lambda f: analysis.closures(f.edges, ids(f.symbols).withColumn("fp", F.lit(1)), _parts(f).where("name LIKE 'red %'").select(F.col("id").alias("test_id"), F.col("id").alias("symbol_id")), 2)
)
query("SELECT 't:' || n AS test_id, n % 3 = 0 AND n % 5 <> 0 AS skip FROM range(60) AS t(n)", "skip_plan_packages")(lambda f: _skips(f))


def _skips(f: Facts) -> DataFrame:
    """Sixty tests: the later run has a failure, so the earlier one is the baseline; some closures and packages changed since."""
    n = f.spark.range(60)
    test = F.concat(F.lit("t:"), F.col("id").cast("string")).alias("test_id")
    run = lambda k, fails: n.select(test, F.lit(k).cast("long").alias("run_id"), F.when(F.lit(fails) & (F.col("id") == 7), "error").otherwise("pass").alias("outcome"), F.lit("c").alias("closure"), F.lit("p").alias("package_fp"))
    now = n.select(test, F.when(F.col("id") % 3 == 0, "c").otherwise("other").alias("closure"), F.when(F.col("id") % 5 == 0, "other").otherwise("p").alias("package_fp"))
    runs = f.spark.createDataFrame([(1, 10), (2, 5), (3, 20)], "run_id long, started long")
    return analysis.skip_plan(run(1, False).union(run(3, True)), now, runs)


query("SELECT id AS test_id, id AS symbol_id FROM (SELECT id, count(*) OVER (PARTITION BY package, name) AS n FROM symbols WHERE kind = 'func') WHERE n = 1", "test_links")(lambda f: testruns.linked(_parts(f).select(F.col("id").alias("test_id"), "package", "name"), f.symbols))
query("SELECT mktsegment, sha256('3:key,' || strlen(mktsegment) || ':' || mktsegment || ',5:other,0:,') AS digest FROM (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer)", "environment_digest")(
    lambda f: f.spark.range(1).select(F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))).alias("mktsegment")).select("mktsegment", testruns.map_digest(F.create_map(F.lit("other"), F.lit(""), F.lit("key"), F.col("mktsegment"))).alias("digest"))
)

# --- scripts and scopes ----------------------------------------------------------------------------


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each part: a table expression with a column list, a join, an update by alias and a temporary table."""
    p = spark.read.schema(TABLES["part"]).parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    columns = ", ".join(f"c{i}" for i in range(30))
    text = F.concat(F.lit(f"WITH t ({columns}) AS (SELECT * FROM src_"), k, F.lit(") INSERT INTO dst SELECT * FROM t JOIN dim d ON d.k = t.c1; UPDATE x SET a = 1 FROM big_"), k, F.lit(" x; SELECT * INTO #tmp FROM base; EXEC run_it"))
    return p.select(F.col("p_partkey").cast("string").alias("path"), text.alias("content"))


QUERIES["sql_lineage"] = lambda spark, sf_dir: lineage.lineage(_scripts(spark, sf_dir))
ORACLE["sql_lineage"] = "SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(s AS INT) AS statement, a AS access, replace(n, '?', CAST(p_partkey AS VARCHAR)) AS name FROM part, (VALUES (0, 'read', 'src_?'), (0, 'write', 'dst'), (0, 'read', 'dim'), (1, 'write', 'big_?'), (1, 'read', 'big_?'), (2, 'read', 'base'), (3, 'call', 'run_it')) AS t(s, a, n)"
query("SELECT split_part(package, '/', 1) AS root, count(DISTINCT symbol_id) AS n FROM occurrences WHERE symbol_id IS NOT NULL GROUP BY 1", "distinct_by_root")(lambda f: f.occurrences.where("symbol_id IS NOT NULL").groupBy(F.split("package", "/")[0].alias("root")).agg(F.count_distinct("symbol_id").alias("n")))
query("SELECT DISTINCT CASE WHEN s.module <> split_part(o.package, '/', 1) THEN split_part(o.package, '/', 1) END AS root, s.module AS needs FROM occurrences o JOIN symbols s ON s.id = symbol_id WHERE s.module <> split_part(o.package, '/', 1)", "version_dependencies")(lambda f: scopes.dependencies(f.occurrences, f.symbols))
query("SELECT symbol_id AS id, enclosing_id, path, line FROM occurrences WHERE role = 'call' AND symbol_id LIKE 'p:%' AND path LIKE '%/1995-01'", "file_graph")(lambda f: nav.file_graph(f, F.col("path").endswith("/1995-01")).where("resolved AND id LIKE 'p:%'").select("id", "enclosing_id", "path", "line"))
query("SELECT 'coarse' AS kind, count(*) AS n FROM supplied", "custom_relationships")(lambda f: nav.coarse(nav.native(f), {"tpch.supplied_by": "reference"}).select(F.lit("coarse").alias("kind"), F.explode("targets")).groupBy("kind").agg(F.count("*").alias("n")))


def _procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure for each part: a branch with an ELSE in one usual form, and a loop in the other."""
    p = spark.read.schema(TABLES["part"]).parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("path"))
    text = F.concat(F.lit("IF @x > 1 BEGIN UPDATE a_"), F.col("path"), F.lit(" SET k = 1 END ELSE DELETE FROM b; WHILE n < 3 LOOP IF m = 2 THEN INSERT INTO c SELECT * FROM d; ELSIF m = 3 THEN PERFORM f(); END IF; END LOOP; SELECT * FROM e"))
    return p.select("path", text.alias("content"))


QUERIES["sql_guards"] = lambda spark, sf_dir: lineage.guarded_lineage(_procedures(spark, sf_dir)).select("path", F.array_join("guards", " & ").alias("guards"), "access", "name")
ORACLE["sql_guards"] = "SELECT CAST(p_partkey AS VARCHAR) AS path, g AS guards, a AS access, replace(n, '?', CAST(p_partkey AS VARCHAR)) AS name FROM part, (VALUES ('@x > 1', 'write', 'a_?'), ('NOT (@x > 1)', 'write', 'b'), ('n < 3 & m = 2', 'write', 'c'), ('n < 3 & m = 2', 'read', 'd'), ('n < 3 & NOT (m = 2) & m = 3', 'call', 'f'), ('', 'read', 'e')) AS t(g, a, n)"


def _statements(f: Facts) -> DataFrame:
    """Lines of an order as statements of its body: each even one stands within the one before it, which is a condition."""
    o = f.occurrences.where("enclosing_id LIKE 'o:1%' AND path NOT LIKE '%/faces'")
    odd = F.col("line") % 2 == 1
    return o.select(F.col("enclosing_id").alias("body"), F.col("line").alias("id"), F.when(~odd, F.col("line") - 1).alias("parent"), F.when(odd, "if").otherwise(F.when(F.col("role") == "write", "assign").otherwise(F.col("role"))).alias("kind"), F.col("symbol_id").alias("target"), F.concat(F.lit("on "), F.col("line").cast("string")).alias("text"), "line")


_LINES = ", s AS (SELECT * FROM occurrences WHERE enclosing_id LIKE 'o:1%' AND path NOT LIKE '%/faces')"
query(f"{_LINES} SELECT enclosing_id AS source, symbol_id AS target, CASE role WHEN 'write' THEN 'write' ELSE role END AS type, count(*) AS n, min(line) AS line FROM s WHERE line % 2 = 0 AND symbol_id IS NOT NULL GROUP BY 1, 2, 3", "body_relationships")(lambda f: bodies.relationships(_statements(f)))
query(f"{_LINES} SELECT DISTINCT enclosing_id AS body, line AS id, CASE WHEN line % 2 = 0 AND (enclosing_id, line - 1) IN (SELECT (enclosing_id, line) FROM s) THEN 'on ' || (line - 1) ELSE '' END AS guards FROM s", "body_guards")(lambda f: bodies.guards(_statements(f).dropDuplicates(["body", "id"])).withColumn("guards", F.array_join("guards", "; ")))


def _faulty(f: Facts) -> Facts:
    """Records, every seventh one of an unknown kind, every eleventh without a name, and a third of the occurrences with another role."""
    n = _number()
    s = f.symbols.where("kind = 'record'")
    s = s.withColumn("kind", F.when(n % 7 == 0, "mystery").otherwise(F.col("kind"))).withColumn("name", F.when(n % 11 != 0, F.col("name")))
    return f.replaced(symbols=s, occurrences=f.occurrences.where("line = 3 AND path NOT LIKE '%/faces'").withColumn("role", F.when(F.col("role") == "write", "scribble").otherwise(F.col("role"))))


query(f", s AS (SELECT id, {_N} AS n FROM symbols WHERE kind = 'record') SELECT 'symbols' AS frame, id AS key, 'unknown kind' AS problem FROM s WHERE n % 7 = 0 UNION ALL SELECT 'symbols', id, 'a part of its identity is missing' FROM s WHERE n % 11 = 0 UNION ALL SELECT 'occurrences', path || ':3', 'unknown role' FROM occurrences WHERE line = 3 AND role = 'write'", "publication_problems")(lambda f: publication.problems(_faulty(f)))
query("SELECT CASE WHEN package = 'ASIA/NATION_2' THEN id || '+' ELSE id END AS id FROM symbols WHERE kind = 'record'", "publication_delta")(lambda f: _replaced(f))


def _replaced(f: Facts) -> DataFrame:
    records = f.symbols.where("kind = 'record'")
    new = records.where("package = 'ASIA/NATION_2'").withColumn("id", F.concat("id", F.lit("+")))
    delta = f.replaced(symbols=new, occurrences=f.occurrences.limit(0), files=f.files.limit(0), **{n: getattr(f, n).limit(0) for n in ("relationships", "embeds", "implements", "extents", "metrics", "measures", "effects", "edges")})
    return ids(publication.with_delta(f.replaced(symbols=records), delta, ["ASIA/NATION_2"]).symbols)


query("SELECT DISTINCT id FROM (SELECT id FROM red UNION ALL SELECT target_id FROM supplied WHERE source_id IN (SELECT id FROM red))", "walk_resolver")(
    lambda f: ids(traverse.walk_source(lambda at: nav.outgoing(f, at).select(F.col("source_id").alias("source"), F.col("target_id").alias("target")), ids(f.symbols.where("kind = 'func' AND name LIKE 'red %'")), 3, most=None)[0])
)
query("SELECT id, CASE kind WHEN 'record' THEN 'box' WHEN 'method' THEN 'circle' END AS shape FROM symbols WHERE module = 'ASIA'", "themed_nodes")(
    lambda f: (lambda n: traverse.themed(n, lambda d: d.join(f.symbols.select("id", "kind"), "id").where("kind IN ('record', 'method')").select("id", F.when(F.col("kind") == "record", "box").otherwise("circle").alias("shape"))))(ids(f.symbols.where("module = 'ASIA'")))
)


# --- more of versions, texts and sources ----------------------------------------------------------
def _attributed(t: DataFrame) -> DataFrame:
    """Lines of each document's versions given to its first line or the rest of it."""
    last = lambda side: F.greatest(F.lit(2), F.size(F.split(side, "\n"))).alias("last")
    extents = lambda side: t.select("key", F.lit("rest").alias("id"), F.lit(1).alias("first"), last(side)).union(t.select("key", F.lit("head"), F.lit(1), F.lit(1)))
    got = compare.attributed(compare.changed_lines(t.select("key", "old", "new")), extents("old"), extents("new"))
    return got.where("id = 'head'").select("key", "added")


text_query("line_attribution", _attributed, "SELECT key, added FROM l")
query(f"SELECT id AS old, id || '+' AS new FROM symbols WHERE kind = 'method' AND id LIKE 'o:%' AND {_N} % 2 = 0 AND CAST(substr(owner_id, 3) AS BIGINT) % 3 = 0", "renamed_members")(lambda f: _members_of_renamed(f))


def _members_of_renamed(f: Facts) -> DataFrame:
    """Every third record is renamed; half of its methods stay."""
    m = f.symbols.where("kind = 'method' AND id LIKE 'o:%'").select(F.col("id").alias("key"), F.col("owner_id").alias("owner"), "kind", "name")
    pairs = ids(f.symbols.where("kind = 'record'")).where(_number() % 3 == 0).select(F.col("id").alias("old"), F.concat("id", F.lit("+")).alias("new"))
    after = m.where(_number("key") % 2 == 0).select(F.concat("key", F.lit("+")).alias("key"), F.concat("owner", F.lit("+")).alias("owner"), "kind", "name")
    return diff.renamed_children(pairs, m, after)


query("SELECT kind, count(*) AS n FROM symbols GROUP BY kind", "facts_round_trip")(lambda f: _stored(f))


def _stored(f: Facts) -> DataFrame:
    """Symbols written with all other facts, and read back by the version of their schemas."""
    at = shared.folder(f.spark, "round-trip")
    write_parquet(f.replaced(**{n: getattr(f, n).limit(0) for n in SCHEMAS if n != "symbols"}), at)
    return read_parquet(f.spark, at).symbols.groupBy("kind").agg(F.count("*").alias("n"))


query("SELECT run_id, outcome, count(*) AS n FROM results WHERE run_id <= 5 GROUP BY 1, 2", "testrun_import")(lambda f: _imported(f))


def _imported(f: Facts) -> DataFrame:
    """Five runs as a producer writes them, one JSON line each, and their attempts as they are read."""
    tries = F.struct("attempt", "outcome", F.lit(1).cast("long").alias("duration_ms"), F.when(F.col("outcome") == "fail", "boom").alias("failure"))
    case = f.results.where("run_id <= 5").groupBy("run_id", "test_id").agg(F.collect_list(tries).alias("attempts"))
    case = case.select("run_id", F.struct(F.col("test_id").alias("id"), F.lit("p").alias("package"), F.col("test_id").alias("name"), "attempts").alias("case"))
    runs = case.groupBy("run_id").agg(F.collect_list("case").alias("cases")).withColumn("environment", F.create_map(F.lit("os"), F.lit("linux")))
    at = shared.folder(f.spark, "test-runs")
    runs.write.mode("overwrite").json(at)
    return testruns.read(f.spark, at).attempts.groupBy("run_id", "outcome").agg(F.count("*").alias("n"))


def _custom(f: Facts) -> Facts:
    """Interfaces as a kind of a producer's own."""
    kinds = f.kinds.union(f.spark.createDataFrame([("acme.screen", "data")], "name string, category string"))
    return f.replaced(kinds=kinds, symbols=f.symbols.withColumn("kind", F.when(F.col("kind") == "interface", "acme.screen").otherwise(F.col("kind"))))


query("SELECT id FROM symbols WHERE kind = 'interface' AND name LIKE '%1'", "custom_kind")(lambda f: sqlnav.run(_custom(f), "SELECT symbol.id AS id FROM 'kind:acme.screen:*1'", None))
query("SELECT DISTINCT symbol_id, CAST(1 AS BIGINT) AS declared_at FROM occurrences WHERE role = 'write' AND symbol_id IS NOT NULL", "declaration_choice")(
    lambda f: scopes.preferred(f.occurrences.where("role = 'write' AND symbol_id IS NOT NULL").select("symbol_id", F.col("line").alias("snapshot")).distinct(), ids(_parts(f)).select(F.col("id").alias("symbol_id"), F.lit(1).alias("snapshot")), strict=True).select("symbol_id", "declared_at").distinct()
)
QUERIES["schema_diff_types"] = lambda spark, sf_dir: _types_only(spark, sf_dir)
ORACLE["schema_diff_types"] = "SELECT 'supplier' AS \"table\", 's_name' AS \"column\", 'changed' AS change"


def _types_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues that differ in one type, and in what may be null, which is not asked."""
    c = database.from_folder(spark, sf_dir, ["part", "supplier"])
    after = c.withColumn("type", F.when(F.col("column") == "s_name", "text").otherwise(F.col("type"))).withColumn("nullable", ~F.col("nullable"))
    return compare.columns_diff(c, after, ("type",))
