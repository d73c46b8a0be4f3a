"""All queries by name over the relational tables, with their SQL forms.

Each SQL form stands on its own; `FACTS_SQL` derives the facts that both read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.glob import canonical_id, iglob, match_list, search_name
from factlens.functions.schemas import pack_handle, properties, unpack_handle
from factlens.operators import analysis, compare, diff, history, nav, scopes, select, traverse
from factlens.plans import pathlang, sqlnav
from factlens.sources import database
from factlens.sources.facts import FACTS_SQL, TABLES, Facts, indexed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


BASE = f"WITH RECURSIVE {FACTS_SQL}, named AS (SELECT s.*, o.name AS owner_name, s.package || coalesce('.' || o.name, '') || '.' || s.name AS query_name FROM symbols s LEFT JOIN symbols o ON s.owner_id = o.id), red AS (SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red %')"


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable[[Facts], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(indexed(spark, sf_dir))
        if sql:
            ORACLE[name or f.__name__] = f"{BASE} {sql}"
        return f

    return add




def nav_query(name: str, text: str, sql: str) -> None:
    """A query in the SQL dialect, over all its rows, however many symbols a walk reaches."""
    query(sql, name)(lambda facts: sqlnav.run(facts, text, limit=None, most=None))


def ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.col(key).alias("id"))


# --- scans and selectors -----------------------------------------------------------------
nav_query("sel_func_glob", "SELECT symbol.id AS id, symbol.name AS name FROM 'func:red*'", "SELECT id, name FROM symbols WHERE kind = 'func' AND name LIKE 'red%'")
nav_query("sel_kind_category", "SELECT symbol.id AS id, symbol.kind AS kind FROM 'type:*'", "SELECT id, kind FROM symbols WHERE kind IN ('record', 'interface', 'type')")
nav_query("sel_pkg_relative", "SELECT symbol.id AS id FROM 'pkg:ASIA:NATION_1*'", "SELECT id FROM symbols WHERE module = 'ASIA' AND package LIKE 'ASIA/NATION_1%'")
nav_query("sel_entity_member", "SELECT symbol.id AS id, symbol.query_name AS query_name FROM 'Customer#00000000?:Order*'", "SELECT id, query_name FROM named WHERE owner_name LIKE 'Customer#00000000_' AND name LIKE 'Order%'")
nav_query("sel_path", "SELECT symbol.id AS id FROM 'path:EUROPE/**'", "SELECT id FROM named WHERE package = 'EUROPE' OR package LIKE 'EUROPE/%'")
nav_query("definitions", "SELECT symbol.id AS id, symbol.visibility AS visibility FROM definitions('func:blue*')", "SELECT id, visibility FROM symbols WHERE kind = 'func' AND name LIKE 'blue%'")
nav_query("files_metrics", "SELECT path, file.lines AS lines, file.digest AS digest FROM files()", "SELECT path, CASE WHEN coalesce(content, '') = '' THEN 0 ELSE len(content) - len(replace(content, chr(10), '')) + CASE WHEN suffix(content, chr(10)) THEN 0 ELSE 1 END END AS lines, sha256(coalesce(content, '')) AS digest FROM files WHERE NOT excluded")
nav_query("match_glob", "SELECT symbol.id AS id FROM 'all:*' WHERE symbol.package MATCH 'A*/NATION_?' AND symbol.kind != 'record'", "SELECT id FROM symbols WHERE regexp_full_match(package, 'A[^/]*/NATION_[^/]') AND kind <> 'record'")
nav_query("where_3vl", "SELECT symbol.id AS id FROM 'all:*' WHERE NOT (symbol.owner_id = 'c:1' OR symbol.kind = 'func') OR symbol.name = 'red ring'", "SELECT id FROM symbols WHERE NOT (owner_id = 'c:1' OR kind = 'func') OR name = 'red ring'")
nav_query("where_in_not_in", "SELECT symbol.id AS id FROM 'func:*' WHERE symbol IN callees('method:Order#1*') AND symbol NOT IN 'func:red*'", "SELECT id FROM symbols WHERE kind = 'func' AND id IN (SELECT symbol_id FROM occurrences JOIN symbols m ON m.id = enclosing_id WHERE role = 'call' AND symbol_id IS NOT NULL AND m.name LIKE 'Order#1%') AND name NOT LIKE 'red%'")


@query("SELECT id FROM symbols WHERE kind = 'record' AND name ILIKE 'customer#00000001%'")
def imatch_fold(f: Facts) -> DataFrame:
    return ids(f.symbols.where("kind = 'record'").where(iglob(F.col("name"), "CUSTOMER#00000001*")))


@query("SELECT id FROM symbols WHERE kind = 'func' AND (name ILIKE '%ring' OR name ILIKE 'red%') AND name NOT ILIKE '%blue%'")
def match_expressions(f: Facts) -> DataFrame:
    return ids(f.symbols.where("kind = 'func'").where(match_list(F.col("name"), "*ring, RED*, !*blue*")))


@query("SELECT id, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') AS search_name FROM symbols", "search_name")
def _search_name(f: Facts) -> DataFrame:
    return f.symbols.select("id", search_name(F.col("name")).alias("search_name"))


@query("SELECT id, sha256(strlen(package) || ':' || package || ',' || strlen(name) || ':' || name || ',') AS canonical FROM symbols", "canonical_id")
def _canonical_id(f: Facts) -> DataFrame:
    return f.symbols.select("id", canonical_id(F.col("package"), F.col("name")).alias("canonical"))


@query("SELECT id, name FROM symbols WHERE regexp_replace(lower(name), '[^0-9a-z]', '', 'g') LIKE 'small%' ORDER BY regexp_replace(lower(name), '[^0-9a-z]', '', 'g'), id LIMIT 20")
def suggest_prefix(f: Facts) -> DataFrame:
    return select.suggest(f, "Small", most=None).select("id", "name")


# --- navigation --------------------------------------------------------------------------
_SITE = "SELECT symbol.id AS id, enclosing_id, role, path, line FROM"


def _witness(name: str, fn: str, where: str, proj: str) -> None:
    nav_query(name, f"{_SITE} {fn}('func:red *')", f"SELECT {proj} AS id, enclosing_id, role, path, line FROM occurrences WHERE symbol_id IN (SELECT id FROM red) AND {where}")


_witness("callers", "callers", "role = 'call'", "enclosing_id")
_witness("references", "references", "role <> 'definition'", "symbol_id")
_witness("reads", "reads", "role = 'reference'", "symbol_id")
_witness("writes", "writes", "role = 'write'", "symbol_id")
nav_query("callees", f"{_SITE} callees('method:Order#1*')", "SELECT symbol_id AS id, enclosing_id, role, path, line FROM occurrences WHERE role = 'call' AND enclosing_id IN (SELECT id FROM symbols WHERE kind = 'method' AND name LIKE 'Order#1%')")
nav_query("methods", "SELECT symbol.id AS id, symbol.owner_name AS owner_name FROM methods('record:Customer#0000000?1')", "SELECT id, owner_name FROM named WHERE kind = 'method' AND owner_name LIKE 'Customer#0000000_1'")
nav_query("implementers", "SELECT symbol.id AS id FROM implementers('interface:Supplier#00000000*')", "SELECT DISTINCT type_id AS id FROM implements WHERE interface_id IN (SELECT id FROM symbols WHERE kind = 'interface' AND name LIKE 'Supplier#00000000%')")
nav_query("inheritors", "SELECT symbol.id AS id FROM inheritors('record:Customer#00000000*')", "SELECT DISTINCT id FROM embeds WHERE embedded IN (SELECT id FROM symbols WHERE kind = 'record' AND name LIKE 'Customer#00000000%')")
nav_query("uses_contained", "SELECT symbol.id AS id, enclosing_id, role, line FROM uses('method:Order#2*')", "SELECT symbol_id AS id, enclosing_id, role, line FROM occurrences WHERE symbol_id IS NOT NULL AND enclosing_id IN (SELECT id FROM symbols WHERE kind = 'method' AND name LIKE 'Order#2%')")
nav_query("incoming_via", "SELECT source_id, target_id FROM incoming('interface:Supplier#00000000*', via => 'tpch.supplied_by')", "SELECT source_id, target_id FROM supplied WHERE target_id IN (SELECT id FROM symbols WHERE kind = 'interface' AND name LIKE 'Supplier#00000000%')")
nav_query("outgoing_via", "SELECT source_id, target_id FROM outgoing('func:red *', via => 'tpch.supplied_by')", "SELECT source_id, target_id FROM supplied WHERE source_id IN (SELECT id FROM red)")
nav_query("nested_callers", "SELECT symbol.id AS id FROM methods(definitions('record:Customer#00000001*')) WHERE symbol.visibility = 'public'", "SELECT id FROM named WHERE kind = 'method' AND owner_name LIKE 'Customer#00000001%' AND visibility = 'public'")


@query("SELECT path, line, enclosing_id FROM (SELECT DISTINCT path, line, column_, enclosing_id FROM occurrences WHERE role = 'call' AND target_name = 'part-1')")
def call_candidates(f: Facts) -> DataFrame:
    return nav.call_candidates(f, "part-1").select("path", "line", "enclosing_id")


# --- ordering and sets -------------------------------------------------------------------
nav_query("order_nulls", "SELECT symbol.id AS id, symbol.owner_id AS owner_id FROM 'all:*' WHERE symbol.package MATCH 'ASIA/*' ORDER BY symbol.owner_id DESC LIMIT 200", "SELECT id, owner_id FROM symbols WHERE regexp_full_match(package, 'ASIA/[^/]*') ORDER BY owner_id DESC NULLS FIRST, id LIMIT 200")
nav_query("topk_limit", "SELECT symbol.id AS id, symbol.name AS name FROM 'func:*' ORDER BY symbol.name LIMIT 25", "SELECT id, name FROM symbols WHERE kind = 'func' ORDER BY name, id LIMIT 25")


def path_query(name: str, text: str, sql: str) -> None:
    query(sql, name)(lambda facts: pathlang.run(facts, text))


path_query("set_union", "func:red* | func:blue*", "SELECT id FROM symbols WHERE kind = 'func' AND (name LIKE 'red%' OR name LIKE 'blue%')")
path_query("set_intersect", "method:* & pkg:ASIA/*", "SELECT id FROM symbols WHERE kind = 'method' AND package LIKE 'ASIA/%'")
path_query("set_subtract", "func:red* -pkg:PARTS/ECONOMY", "SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%' AND package <> 'PARTS/ECONOMY'")
path_query("modifiers", "method:Order#1* +pkg:EUROPE/* -path:EUROPE/NATION_3", "SELECT id FROM symbols WHERE kind = 'method' AND name LIKE 'Order#1%' AND package LIKE 'EUROPE/%' AND package <> 'EUROPE/NATION_3'")
path_query("relation_operand", "func:red* < pkg:ASIA/*", "SELECT DISTINCT o.enclosing_id AS id FROM occurrences o JOIN symbols s ON s.id = o.enclosing_id WHERE o.role = 'call' AND s.package LIKE 'ASIA/%' AND o.symbol_id IN (SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%')")
path_query("compact_writes", "func:red* ~w", "SELECT DISTINCT enclosing_id AS id FROM occurrences WHERE role = 'write' AND symbol_id IN (SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%')")


# --- traversal ---------------------------------------------------------------------------
def _walk(start: str, forward: bool, depth: int) -> str:
    a, b = ("source", "target") if forward else ("target", "source")
    return f"w(id, depth) AS (SELECT id, 0 FROM ({start}) UNION SELECT e.{b}, w.depth + 1 FROM w JOIN edges e ON e.{a} = w.id WHERE w.depth < {depth}), least_ AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"


_ONE = "SELECT 'p:1' AS id"
query(f", {_walk(_ONE, True, 4)} SELECT id, depth FROM least_ WHERE depth > 0", "traverse_out")(lambda f: traverse.reachable(f.edges, ids(f.symbols.where("id = 'p:1'")), 4))
query(f", {_walk(_ONE, False, 4)} SELECT id, depth FROM least_ WHERE depth > 0", "traverse_in")(lambda f: traverse.reachable(traverse.reverse(f.edges), ids(f.symbols.where("id = 'p:1'")), 4))
query(f", {_walk(_ONE, True, 2)}, {_walk(_ONE, False, 2).replace('w(', 'u(').replace(' w ', ' u ').replace('w.', 'u.').replace('least_', 'most_')} SELECT id, CAST(arg_min(depth, [abs(depth), depth]) AS INT) AS depth FROM (SELECT id, depth FROM least_ UNION ALL SELECT id, -depth FROM most_ WHERE depth > 0) GROUP BY id", "graph_nodes")(
    lambda f: traverse.graph(f.edges, ids(f.symbols.where("id = 'p:1'")), 2, 1000)[0]
)
query(f", {_walk('SELECT id FROM red', True, 2)} SELECT c.id, l.depth, c.enclosing_id FROM (SELECT symbol_id AS id, enclosing_id FROM occurrences WHERE role = 'call') c JOIN least_ l ON l.id = c.id", "witnesses_by_depth")(
    lambda f: f.occurrences.where("role = 'call'").join(traverse.reachable(f.edges, ids(select.select(f, "func:red *")), 2, True).withColumnRenamed("id", "symbol_id"), "symbol_id").select(F.col("symbol_id").alias("id"), "depth", "enclosing_id")
)
query(f", {_walk(_ONE, True, 8)} SELECT depth AS hops FROM least_ WHERE id = 'p:7'", "path_shortest_len")(lambda f: traverse.shortest_path(f.edges, *(ids(f.symbols.where(F.col("id") == x)) for x in ("p:1", "p:7"))).where("id = 'p:7'").select(F.col("hop").alias("hops")))
query(
    "SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY id", "graph_degree"
)(lambda f: traverse.degrees(f.edges))
query(
    ", f AS (SELECT a.package AS from_id, b.package AS to_id, source, target FROM edges JOIN symbols a ON a.id = source JOIN symbols b ON b.id = target WHERE a.package <> b.package) SELECT from_id, to_id, count(*) AS n_edges, array_to_string(list_sort(list(DISTINCT source)), ',') AS members FROM f GROUP BY from_id, to_id",
    "graph_fold_members",
)(lambda f: traverse.fold_members(f.edges, f.symbols.select("id", F.col("package").alias("owner"))).withColumn("members", F.array_join("members", ",")))
query("SELECT symbol_id AS target, enclosing_id AS source, count(*) AS n_sites, min(path) AS first_path FROM occurrences WHERE role = 'call' AND symbol_id IS NOT NULL GROUP BY 1, 2", "graph_edges_merged")(
    lambda f: traverse.merge_edges(f.occurrences.where("role = 'call' AND symbol_id IS NOT NULL").select(F.col("enclosing_id").alias("source"), F.col("symbol_id").alias("target"), F.col("role").alias("kind"), "path", "line")).select("target", "source", "n_sites", F.col("sites")[0]["path"].alias("first_path"))
)
_CLOSURE = ", c(symbol_id, effect) AS (SELECT symbol_id, effect FROM effects UNION SELECT e.source, c.effect FROM c JOIN edges e ON e.target = c.symbol_id)"
query(f"{_CLOSURE} SELECT symbol_id, effect FROM c", "effects_closure")(lambda f: traverse.effects_closure(f.edges, f.effects))
query(f"{_CLOSURE} SELECT symbol_id, string_agg(effect, ',' ORDER BY effect) AS effects, bool_and(effect = 'lock.read') AS deterministic FROM c GROUP BY symbol_id", "deterministic_flag")(lambda f: traverse.effect_lists(traverse.effects_closure(f.edges, f.effects)))

# --- versions ----------------------------------------------------------------------------
_STATE = "SELECT key, fp FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) AS r FROM deltas WHERE ordinal <= {}) WHERE r = 1 AND op = 'set'"
_GEN = ", l AS (SELECT *, lag(op) OVER k AS was, lag(fp) OVER k AS was_fp FROM deltas WINDOW k AS (PARTITION BY key ORDER BY ordinal)), g AS (SELECT ordinal, key, op, fp, CAST(sum(CASE WHEN op = 'set' AND (was IS NULL OR was = 'delete' OR was_fp <> fp) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ordinal) AS BIGINT) AS generation FROM l)"


def state(f: Facts, at: int) -> DataFrame:
    return history.effective(f.deltas, history.chain(f.snapshots, at), "key").select("key", "fp")


query(_STATE.format(30), "effective_state")(lambda f: state(f, 30))
query(f"{_GEN} SELECT ordinal, key, op, fp, generation FROM g WHERE generation > 0", "generation")(lambda f: history.generations(f.deltas))
query(f"{_GEN}, h AS (SELECT *, max(generation) OVER (PARTITION BY key ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g WHERE generation > 0) SELECT ordinal, key, generation FROM h WHERE m IS NULL OR generation > m", "symbol_history")(
    lambda f: history.symbol_history(history.generations(f.deltas)).select("ordinal", "key", "generation")
)
query(
    ", l AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY ordinal) AS was FROM deltas) SELECT ordinal, count(*) FILTER (op = 'set' AND (was IS NULL OR was = 'delete')) AS added, count(*) FILTER (op = 'set' AND was = 'set') AS changed, count(*) FILTER (op = 'delete' AND was = 'set') AS deleted FROM l GROUP BY ordinal", "snapshot_stats"
)(lambda f: history.stats(f.deltas))
query(f", x AS ({_STATE.format(10)}), y AS ({_STATE.format(20)}) SELECT key, CASE WHEN y.fp IS NULL THEN 'delete' ELSE 'set' END AS op, y.fp AS fp FROM x FULL JOIN y USING (key) WHERE x.fp IS DISTINCT FROM y.fp", "snapshot_delta")(lambda f: history.changes(state(f, 10), state(f, 20)))
query("SELECT ordinal, lag(ordinal) OVER (ORDER BY ordinal) AS new_base FROM (SELECT unnest(range(1, 32)) AS ordinal) WHERE ordinal > 24 OR ordinal IN (3, 11)", "prune_kept")(lambda f: history.kept_snapshots(f.snapshots, 7, f.snapshots.where("ordinal IN (3, 11)")))
query("SELECT ordinal, CAST('partial' AS VARCHAR) AS coverage FROM (SELECT unnest(range(1, 32)) AS ordinal) WHERE ordinal % 5 = 0", "coverage_gaps")(lambda f: analysis.coverage_gaps(f.snapshots).select("ordinal", "coverage"))


# --- differences -------------------------------------------------------------------------
def _sides(f: Facts) -> tuple[DataFrame, DataFrame]:
    """Two versions of the functions: the second lacks some, has others, and changes layers and packages by number."""
    n = F.expr("cast(substring(id, 3) as bigint)")
    fp = lambda m, k: F.when(n % m == k, F.lit("x")).otherwise(F.lit("y"))
    base = f.symbols.where("kind = 'func'").withColumn("key", F.col("id"))
    a = base.where(n % 11 != 1).select("key", "package", "kind", "name", *(F.lit("y").alias(c) for c in ("public_fp", "private_fp", "content_fp")))
    b = base.where(n % 11 != 2).select("key", F.when(n % 13 == 4, F.concat("package", F.lit("/new"))).otherwise(F.col("package")).alias("package"), "kind", "name", fp(5, 0).alias("public_fp"), fp(5, 1).alias("private_fp"), fp(5, 2).alias("content_fp"))
    return a, b


query(
    ", f AS (SELECT id AS key, package, CAST(substr(id, 3) AS BIGINT) AS n FROM symbols WHERE kind = 'func'), c AS (SELECT key, CASE WHEN n % 11 = 1 THEN 'added' WHEN n % 11 = 2 THEN 'removed' WHEN n % 5 = 0 THEN 'signature' WHEN n % 5 = 1 THEN 'structure' WHEN n % 5 = 2 THEN 'body' WHEN n % 13 = 4 THEN 'moved' END AS change FROM f) SELECT key, change FROM c WHERE change IS NOT NULL",
    "symbol_diff_class",
)(lambda f: diff.classify(*_sides(f)))


def _shapes(f: Facts) -> tuple[DataFrame, DataFrame]:
    """Functions by size parity as two versions; the shape is the brand with the size."""
    n = F.expr("cast(substring(id, 3) as bigint)")
    s = f.symbols.where("kind = 'func'").withColumn("shape", F.concat(F.get("params", F.lit(0)), F.lit(":"), (F.floor(n / 2) % 997).cast("string"))).withColumn("key", F.col("id"))
    return s.where(n % 2 == 0), s.where(n % 2 == 1)


_SIDE = ", f AS (SELECT id AS key, package, kind, name, param || ':' || ((CAST(substr(id, 3) AS BIGINT) // 2) % 997) AS shape, CAST(substr(id, 3) AS BIGINT) % 2 AS side FROM symbols WHERE kind = 'func'), x AS (SELECT {0}, min(key) AS old FROM f WHERE side = 0 GROUP BY {0} HAVING count(*) = 1), y AS (SELECT {0}, min(key) AS new FROM f WHERE side = 1 GROUP BY {0} HAVING count(*) = 1) SELECT x.old, y.new FROM x JOIN y USING ({0}) JOIN f a ON a.key = x.old JOIN f b ON b.key = y.new WHERE a.{1} <> b.{1}"
query(_SIDE.format("kind, name, shape", "package"), "moved_unique")(lambda f: diff.moved(*_shapes(f)))
query(_SIDE.format("package, kind, shape", "name"), "renamed_unique")(lambda f: diff.renamed(*_shapes(f)))


def _trees(f: Facts) -> tuple[DataFrame, DataFrame]:
    a, b = _shapes(f)
    n = F.expr("cast(substring(id, 3) as bigint)")
    node = lambda d: d.select("key", F.when(n % 10 < 2, F.floor(n / 2).cast("string")).alias("uuid"), F.col("name").alias("symbol"), F.col("shape").alias("hash"))
    return node(a), node(b)


_NODE = ", f AS (SELECT id AS key, CASE WHEN n % 10 < 2 THEN CAST(n // 2 AS VARCHAR) END AS uuid, name AS symbol, param || ':' || ((n // 2) % 997) AS hash, n % 2 AS side FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS n FROM symbols WHERE kind = 'func'))"
_PASS = ", {2} AS (SELECT o.old, p.new, '{0}' AS by FROM (SELECT {0}, min(key) AS old FROM f WHERE side = 0 AND {0} IS NOT NULL {1} GROUP BY 1 HAVING count(*) = 1) o JOIN (SELECT {0}, min(key) AS new FROM f WHERE side = 1 AND {0} IS NOT NULL {1} GROUP BY 1 HAVING count(*) = 1) p USING ({0}))"
_LEFT = "AND key NOT IN (SELECT old FROM {0} UNION ALL SELECT new FROM {0})"
query(_NODE + _PASS.format("uuid", "", "m1") + _PASS.format("symbol", _LEFT.format("m1"), "m2") + _PASS.format("hash", _LEFT.format("m1") + " " + _LEFT.format("m2"), "m3") + " SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3", "tree_diff_match")(lambda f: diff.tree_match(*_trees(f)))
query(
    ", i AS (SELECT source_id AS path, target_id AS alias, CAST(substr(source_id, 3) AS BIGINT) AS n FROM supplied) SELECT path, alias, CASE WHEN n % 3 = 1 THEN 'added' WHEN n % 3 = 2 THEN 'removed' ELSE 'changed' END AS change FROM i WHERE n % 4 <> 0", "import_diff"
)(lambda f: _imports(f))


def _imports(f: Facts) -> DataFrame:
    i = f.relationships.select(F.col("source_id").alias("path"), F.explode("targets").alias("alias")).withColumn("n", F.expr("cast(substring(path, 3) as bigint)"))
    a = i.where("n % 4 = 0 OR n % 3 != 1").select("path", "alias", F.col("alias").alias("target"))
    b = i.where("n % 4 = 0 OR n % 3 != 2").select("path", "alias", F.when(F.expr("n % 4 != 0 AND n % 3 = 0"), F.lit("other")).otherwise(F.col("alias")).alias("target"))
    return diff.imports_diff(a, b)


# --- tests, coverage and files -----------------------------------------------------------
query(
    ", r AS (SELECT test_id, run_id, bool_or(outcome = 'pass') AS p, bool_or(outcome = 'fail') AS f FROM results GROUP BY 1, 2), n AS (SELECT test_id, count(*) AS runs, count(*) FILTER (p AND f) AS retry_flakes FROM r GROUP BY 1), g AS (SELECT test_id, count(*) FILTER (outcome = 'pass') AS passes, count(*) FILTER (outcome = 'fail') AS failures FROM results GROUP BY test_id, closure, environment HAVING passes > 0 AND failures > 0) SELECT test_id, runs, retry_flakes, CAST(sum(passes) AS BIGINT) AS passes, CAST(sum(failures) AS BIGINT) AS failures, sum(failures) / sum(passes + failures) AS flake_rate FROM n JOIN g USING (test_id) GROUP BY test_id, runs, retry_flakes",
    "flaky_tests",
)(lambda f: analysis.flaky(f.results))
query("SELECT test_id, arg_max(outcome, [run_id, attempt]) AS outcome FROM results GROUP BY test_id", "last_outcome")(lambda f: analysis.last_outcome(f.results))
query("SELECT symbol_id, CASE WHEN arg_max(statements, (run_id + 6) % 12) > 0 THEN arg_max(covered, (run_id + 6) % 12) / arg_max(statements, (run_id + 6) % 12) END AS ratio FROM coverage GROUP BY symbol_id", "coverage_ratio")(lambda f: analysis.coverage_ratio(f.coverage, f.runs))
query("SELECT enclosing_id, sha256(string_agg(strlen(symbol_id) || ':' || symbol_id || ',', '' ORDER BY symbol_id)) AS digest FROM (SELECT DISTINCT enclosing_id, symbol_id FROM occurrences WHERE symbol_id IS NOT NULL) GROUP BY enclosing_id", "closure_fingerprint")(
    lambda f: analysis.set_digest(f.occurrences.where("symbol_id IS NOT NULL"), "enclosing_id", "symbol_id")
)
query(
    ", k AS (SELECT DISTINCT test_id FROM results WHERE outcome = 'pass' AND run_id IN (SELECT max(run_id) FROM (SELECT DISTINCT run_id FROM results) WHERE run_id NOT IN (SELECT run_id FROM results WHERE outcome = 'fail'))) SELECT DISTINCT test_id, test_id IN (SELECT test_id FROM k) AS skip FROM results",
    "skip_plan",
)(lambda f: analysis.skip_plan(f.results, f.results.select("test_id", "closure").distinct()))
query("SELECT package, count(*) AS n FROM symbols GROUP BY package", "package_facet")(lambda f: analysis.package_facet(f.symbols))
query("SELECT package, kind, count(*) AS n, CAST(grouping(package, kind) AS BIGINT) AS level FROM symbols GROUP BY ROLLUP (package, kind)", "rollup_by_package")(lambda f: analysis.rollup_counts(f.symbols))
query(
    "SELECT symbol_id, max(CASE WHEN role = 'call' THEN line END) AS calls, max(CASE WHEN role = 'write' THEN line END) AS writes FROM occurrences WHERE symbol_id IS NOT NULL AND role IN ('call', 'write') GROUP BY 1", "measures_pivot"
)(lambda f: analysis.measures(f.occurrences.where("symbol_id IS NOT NULL AND role IN ('call', 'write')").select("symbol_id", F.when(F.col("role") == "call", "calls").otherwise("writes").alias("name"), F.col("line").alias("value")), ["calls", "writes"]))
query(
    "SELECT 'no-private-red' AS rule, 'error' AS severity, enclosing_id || ' calls ' || symbol_id AS message, path, line FROM (SELECT DISTINCT enclosing_id, symbol_id, path, line FROM occurrences JOIN symbols c ON c.id = enclosing_id WHERE role = 'call' AND symbol_id IN (SELECT id FROM red) AND c.visibility = 'private')",
    "lint_rules",
)(lambda f: analysis.lint(f, [{"name": "no-private-red", "severity": "error", "query": "SELECT symbol.id AS caller, symbol_id AS callee, path, line FROM callers('func:red *') WHERE symbol.visibility = 'private'", "message": "{caller} calls {callee}"}]))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k int", {"mode": "FAILFAST"})["k"].alias("k"))


QUERIES["props_json"] = props_json
ORACLE["props_json"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"


def props_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same properties, typed by a schema instead of by hand."""
    schema = {"type": "object", "properties": {"k": {"$ref": "#/$defs/count"}}, "$defs": {"count": {"type": ["integer", "null"]}}}
    e = spark.read.schema(TABLES["events"]).parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", *properties(F.col("props"), schema))


QUERIES["props_schema"] = props_schema
ORACLE["props_schema"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"


# --- scopes ------------------------------------------------------------------------------
def _registry(spark: SparkSession, sf_dir: str) -> scopes.Registry:
    """Regions as roots, nations as their locations; a nation with suppliers has a head, and the first such one is primary."""
    t = lambda n: spark.read.schema(TABLES[n]).parquet(f"{sf_dir}/{n}.parquet")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("root"), F.col("n_name").alias("location"))
    heads = t("supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_suppkey").alias("snapshot"))
    headed = places.join(heads, "n_nationkey")
    primary = headed.groupBy("root").agg(F.min_by("location", "n_nationkey").alias("location"))
    return scopes.Registry(places.select("root", "location"), headed.select("location", "snapshot"), primary)


_REGISTRY = "WITH places AS (SELECT n_nationkey, r_name AS root, n_name AS location FROM nation JOIN region ON n_regionkey = r_regionkey), heads AS (SELECT s_nationkey AS n_nationkey, max(s_suppkey) AS snapshot FROM supplier WHERE s_acctbal > 0 GROUP BY 1), headed AS (SELECT * FROM places JOIN heads USING (n_nationkey)), prim AS (SELECT root, arg_min(location, n_nationkey) AS location FROM headed GROUP BY root)"


def scope_query(name: str, f: Callable[[scopes.Registry], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(_registry(spark, sf_dir))
    ORACLE[name] = f"{_REGISTRY} {sql}"


scope_query("scope_primary", lambda r: r.select(), "SELECT root, location, snapshot FROM headed JOIN prim USING (root, location)")
scope_query("scope_locations", lambda r: r.select(locations=["NATION_3", "NATION_7"]), "SELECT root, location, snapshot FROM headed WHERE location IN ('NATION_3', 'NATION_7')")
scope_query("missing_heads", lambda r: r.missing_heads(), "SELECT root, location FROM places WHERE location NOT IN (SELECT location FROM headed)")
scope_query("scope_listing", lambda r: r.listing(), "SELECT p.root, p.location, h.snapshot, m.location IS NOT NULL AS is_primary FROM places p LEFT JOIN headed h ON h.location = p.location LEFT JOIN prim m ON m.root = p.root AND m.location = p.location")


def _versioned(f: Facts) -> DataFrame:
    """Occurrences by the root of their package, with the line as the snapshot."""
    return f.occurrences.where("symbol_id IS NOT NULL").select("symbol_id", F.split("package", "/")[0].alias("root"), F.col("line").alias("snapshot"), "role", "enclosing_id")


_VERSIONED = ", v AS (SELECT symbol_id, split_part(package, '/', 1) AS root, line AS snapshot, role, enclosing_id FROM occurrences WHERE symbol_id IS NOT NULL), c AS (SELECT DISTINCT symbol_id, root, snapshot FROM v WHERE role = 'call')"
query(f"{_VERSIONED} SELECT * FROM v WHERE (symbol_id, root, snapshot) IN (SELECT (symbol_id, root, snapshot) FROM c) OR (symbol_id, root) NOT IN (SELECT (symbol_id, root) FROM c)", "scope_align")(lambda f: scopes.align(_versioned(f), _versioned(f).where("role = 'call'")))
query(f"{_VERSIONED} SELECT symbol_id AS id, root, snapshot FROM c INTERSECT SELECT symbol_id, root, snapshot FROM v WHERE role = 'write'", "scope_intersect")(lambda f: scopes.intersect(*(_versioned(f).where(F.col("role") == r).withColumnRenamed("symbol_id", "id") for r in ("call", "write"))))
query(f"{_VERSIONED}, d AS (SELECT symbol_id, min(snapshot) AS first, list(DISTINCT snapshot) AS all_ FROM c GROUP BY 1) SELECT v.*, CASE WHEN list_contains(all_, v.snapshot) THEN v.snapshot ELSE first END AS declared_at FROM v LEFT JOIN d USING (symbol_id) WHERE v.role = 'write'", "used_declaration")(
    lambda f: scopes.preferred(_versioned(f).where("role = 'write'"), _versioned(f).where("role = 'call'"))
)
query("SELECT id, package FROM symbols WHERE module = 'PARTS' OR package = 'ASIA/NATION_2' OR package = 'EUROPE' OR package LIKE 'EUROPE/%'", "scope_predicate")(lambda f: scopes.in_scope(f.symbols, ["PARTS"], ["ASIA/NATION_2", "EUROPE"]).select("id", "package"))
query("SELECT id FROM symbols WHERE id IN (SELECT symbol_id FROM occurrences WHERE symbol_id IS NOT NULL UNION SELECT type_id FROM implements UNION SELECT interface_id FROM implements)", "active_symbols")(lambda f: ids(scopes.active(f.symbols, f.occurrences, f.implements)))
query("SELECT id FROM symbols WHERE (id, module) IN (SELECT (enclosing_id, split_part(package, '/', 1)) FROM occurrences)", "own_root")(
    lambda f: ids(scopes.own_root(f.symbols, f.occurrences.select(F.split("package", "/")[0].alias("root"), F.col("enclosing_id").alias("symbol_id"))))
)
query("SELECT path, line, max(enclosing_id) IS NOT NULL AS any_, count(DISTINCT symbol_id) > 0 AS known FROM occurrences WHERE symbol_id IN (SELECT id FROM red) GROUP BY path, line, column_", "find_references")(
    lambda f: nav.find_references(f, ids(select.select(f, "func:red *"))).select("path", "line", F.col("enclosing_id").isNotNull().alias("any_"), F.col("symbol_id").isNotNull().alias("known"))
)
query("SELECT count(*) FILTER (symbol_id IS NULL) AS omitted FROM occurrences WHERE role = 'call' AND enclosing_id IN (SELECT id FROM symbols WHERE kind = 'method')", "projection_omitted")(lambda f: nav.projected(nav.callees(f, ids(f.symbols.where("kind = 'method'"))))[1])

# --- bounded graphs and changes of graphs --------------------------------------------------
_PARTS_TREE = "PARTS/ECONOMY"


def _groups(f: Facts) -> DataFrame:
    return f.symbols.select("id", F.col("package").alias("grp"))


_BOUNDED = f", inner_ AS (SELECT e.* FROM edges e JOIN symbols a ON a.id = source JOIN symbols b ON b.id = target WHERE a.package NOT LIKE '{_PARTS_TREE}%' AND b.package NOT LIKE '{_PARTS_TREE}%'), {_walk('SELECT id FROM red', True, 2).replace('JOIN edges', 'JOIN inner_')}, kept AS (SELECT id, depth FROM least_ ORDER BY depth, id LIMIT 40)"
_bounded = lambda f: traverse.bounded_graph(f.edges, ids(select.select(f, "func:red *")), _groups(f), 2, 40, (f"{_PARTS_TREE}", f"{_PARTS_TREE}/..."))
query(f"{_BOUNDED} SELECT id, depth FROM kept", "graph_bounded_nodes")(lambda f: _bounded(f)[0])
query(f"{_BOUNDED} SELECT source, target FROM inner_ WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)", "graph_bounded_edges")(lambda f: _bounded(f)[1])
query(
    f"{_BOUNDED}, o AS (SELECT DISTINCT 'excluded' AS reason, target AS id FROM edges JOIN symbols ON id = target WHERE package LIKE '{_PARTS_TREE}%' AND source IN (SELECT id FROM kept) UNION ALL SELECT 'node_limit', id FROM least_ WHERE id NOT IN (SELECT id FROM kept) UNION ALL SELECT 'beyond_depth', target FROM inner_ WHERE source IN (SELECT id FROM kept WHERE depth = 2) AND target NOT IN (SELECT id FROM least_)) SELECT reason, package AS grp, count(*) AS n FROM o LEFT JOIN symbols USING (id) GROUP BY 1, 2",
    "graph_omitted",
)(lambda f: _bounded(f)[2])
query(f", {_walk('SELECT id FROM red', True, 3)} SELECT id AS target, depth AS hops FROM least_ WHERE id IN (SELECT symbol_id FROM effects)", "graph_paths_to")(
    lambda f: traverse.paths_to(f.edges, ids(select.select(f, "func:red *")), f.effects.select(F.col("symbol_id").alias("id")), 3).groupBy("target").agg(F.max("hop").alias("hops"))
)
query(", n(symbol_id, effect, hops) AS (SELECT symbol_id, effect, 0 FROM effects UNION SELECT e.source, n.effect, n.hops + 1 FROM n JOIN edges e ON e.target = n.symbol_id WHERE n.hops < 3) SELECT symbol_id, effect, min(hops) AS hops FROM n GROUP BY 1, 2", "effects_explained")(lambda f: traverse.nearest_effects(f.edges, f.effects, 3).select("symbol_id", "effect", "hops"))


def _number(c: str) -> str:
    return f"cast(substring({c}, 3) as bigint)"


def _since(f: Facts) -> tuple[DataFrame, DataFrame]:
    """Functions reached from the red ones before and after some calls went, some came and some bodies changed."""
    n = F.expr(_number("id"))
    nodes = [ids(f.symbols.where("kind = 'func'")).withColumn("fp", F.when((n % 9 == 0) & F.lit(k == 1), 1).otherwise(0)) for k in (0, 1)]
    edges = [f.edges.where(f"{_number('source')} % 7 != {k}") for k in (0, 1)]
    return compare.since((edges[0], nodes[0]), (edges[1], nodes[1]), ids(select.select(f, "func:red *")), 2)


def _both_walks() -> str:
    walks = []
    for k in (0, 1):
        w = _walk("SELECT id FROM red", True, 2).replace("JOIN edges", f"JOIN e{k}").replace("w(", f"w{k}(").replace(" w ", f" w{k} ").replace("w.", f"w{k}.").replace("least_", f"l{k}")
        walks.append(f"e{k} AS (SELECT * FROM edges WHERE CAST(substr(source, 3) AS BIGINT) % 7 <> {k}), {w}, d{k} AS (SELECT source, target FROM e{k} WHERE source IN (SELECT id FROM l{k} WHERE depth < 2))")
    return ", " + ", ".join(walks)


query(f"{_both_walks()} SELECT id, change, depth FROM (SELECT id, CASE WHEN l0.depth IS NULL THEN 'added' WHEN l1.depth IS NULL THEN 'removed' WHEN CAST(substr(id, 3) AS BIGINT) % 9 = 0 THEN 'changed' END AS change, least(l0.depth, l1.depth) AS depth FROM l0 FULL JOIN l1 USING (id)) WHERE change IS NOT NULL", "since_nodes")(lambda f: _since(f)[0])
query(f"{_both_walks()} SELECT source, target, 'removed' AS change FROM (FROM d0 EXCEPT FROM d1) UNION ALL SELECT source, target, 'added' FROM (FROM d1 EXCEPT FROM d0)", "since_edges")(lambda f: _since(f)[1])


# --- texts, files and catalogues ----------------------------------------------------------
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents before and after a line came at the top, and in every third one also one at the end went."""
    d = spark.read.schema(TABLES["documents"]).parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.concat(F.lit("== first of "), F.col("doc_id").cast("string"), F.lit("\n"))
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n== last"))).otherwise(F.col("text"))
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("key"), "source", tail.alias("old"), F.concat(mark, "text").alias("new"))


# an end of line before the end of a text is one line more when another follows it
_TEXTS = "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), c AS (SELECT *, doc_id % 3 = 0 AS tail, suffix(text, chr(10)) AS ended, text = '' AS bare FROM d), l AS (SELECT CAST(doc_id AS VARCHAR) AS key, source, source || '/' || doc_id AS path, CAST(1 AS BIGINT) AS added, CAST(CASE WHEN NOT tail THEN 0 WHEN ended OR bare THEN 2 ELSE 1 END AS BIGINT) AS removed FROM c)"


def text_query(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(_texts(spark, sf_dir))
    ORACLE[name] = f"{_TEXTS} {sql}"


text_query("line_changes", compare.line_changes, "SELECT key, added, removed FROM l")
text_query("patch_counts", lambda t: compare.hunks(compare.patches(t)).groupBy(F.col("new_path").alias("path")).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed")), "SELECT path, CAST(added AS BIGINT) AS added, removed FROM l")
text_query(
    "line_roll_up", lambda t: compare.roll_up(compare.line_changes(t).join(t.select("key", F.col("source").alias("package"), "path"), "key")), "SELECT source AS package, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(2 - (source IS NOT NULL)::INT - (path IS NOT NULL)::INT AS BIGINT) AS level FROM l GROUP BY ROLLUP (source, path)"
)


@query("SELECT path, CASE CAST(split_part(path, '/', -1) AS BIGINT) % 10 WHEN 1 THEN 'removed' WHEN 2 THEN 'added' ELSE 'changed' END AS change FROM files WHERE CAST(split_part(path, '/', -1) AS BIGINT) % 10 IN (1, 2, 3)", "changed_files")
def _changed_files(f: Facts) -> DataFrame:
    n = F.substring_index("path", "/", -1).cast("long") % 10
    rows = analysis.file_rows(f.files, True).select("path", "digest")
    return compare.changed_files(rows.where(n != 2), rows.where(n != 1).withColumn("digest", F.when(n == 3, F.reverse("digest")).otherwise(F.col("digest"))))


query("SELECT id AS old, id || '+' AS new FROM (SELECT *, count(*) OVER (PARTITION BY package, name) AS n FROM symbols WHERE kind = 'func') WHERE n = 1", "retyped")(
    lambda f: (lambda s: compare.retyped(s, s.withColumn("id", F.concat("id", F.lit("+")))))(f.symbols.where("kind = 'func'").select("id", "package", "kind", "owner_id", "name"))
)
query("SELECT package AS owner, name AS key, CAST(1 AS INT) AS nth, 'changed' AS change FROM symbols WHERE kind = 'record' AND visibility = 'private'", "member_diff")(
    lambda f: (lambda m: compare.members(m, m.withColumn("hash", F.when(F.col("visibility") == "private", "other").otherwise(F.col("hash")))))(f.symbols.where("kind = 'record'").select(F.col("package").alias("owner"), F.col("name").alias("key"), F.lit(1).alias("nth"), F.lit("h").alias("hash"), "visibility"))
)
query(
    ", t AS (SELECT DISTINCT symbol_id, run_id, statements, covered FROM coverage), h AS (SELECT symbol_id, count(*) AS n, min(statements) AS s, min(covered) AS c, sha256(unhex(string_agg(printf('%016x', statements), '' ORDER BY statements, covered))) AS hs, sha256(unhex(string_agg(printf('%016x', covered), '' ORDER BY statements, covered))) AS hc FROM (SELECT DISTINCT symbol_id, statements, covered FROM t) GROUP BY 1), g AS (SELECT *, ('0x' || hs[1:16])::UBIGINT::HUGEINT AS us, ('0x' || hc[1:16])::UBIGINT::HUGEINT AS uc FROM h) SELECT symbol_id, CASE WHEN n = 1 THEN s ELSE CAST(us - CASE WHEN us >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) END AS statements, CASE WHEN n = 1 THEN c ELSE CAST(uc - CASE WHEN uc >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) END AS covered FROM g",
    "fingerprint_fold",
)(lambda f: history.fold_fingerprints(f.coverage.where("test_id IS NULL"), "symbol_id", "statements", "covered"))


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.schema(TABLES["part"]).parquet(f"{sf_dir}/part.parquet")
    parts = {"module": F.col("p_size"), "package": F.col("p_partkey") % 65536, "visibility": F.col("p_partkey") % 2, "kind": F.col("p_size") % 64, "local": F.col("p_partkey")}
    packed = p.select("p_partkey", pack_handle(**parts).alias("handle"))
    back = unpack_handle(F.col("handle"))
    return packed.select("p_partkey", "handle", back["module"], back["local"])


QUERIES["symbol_handles"] = handles
ORACLE["symbol_handles"] = "SELECT p_partkey, ((((p_size::BIGINT << 16 | p_partkey % 65536) << 1 | p_partkey % 2) << 6 | p_size % 64) << 29) | p_partkey AS handle, p_size::BIGINT AS module, p_partkey AS local FROM part"


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues of the same tables: one lacks a column, the other has it with another type."""
    c = database.from_folder(spark, sf_dir, ["part", "supplier"])
    after = c.where("column != 'p_size'").withColumn("type", F.when(F.col("column") == "s_name", "text").otherwise(F.col("type"))).withColumn("schema", F.lit("other"))
    return compare.columns_diff(c, after)


QUERIES["schema_diff"] = schema_diff
ORACLE["schema_diff"] = "SELECT * FROM (VALUES ('part', 'p_size', 'removed'), ('supplier', 's_name', 'changed')) AS t(\"table\", \"column\", change)"
query(
    ", i AS (SELECT DISTINCT o.package AS source, s.package AS target FROM occurrences o JOIN symbols s ON s.id = o.symbol_id WHERE o.role = 'call'), r(id, needs) AS (SELECT DISTINCT package, package FROM symbols UNION SELECT r.id, i.target FROM r JOIN i ON i.source = r.needs) SELECT id AS package, count(*) AS n_packages FROM r GROUP BY id",
    "package_closure",
)(lambda f: _closure(f))


def _closure(f: Facts) -> DataFrame:
    s = f.symbols.select("id", "package")
    calls = f.occurrences.where("role = 'call' AND symbol_id IS NOT NULL").select(F.col("package").alias("source"), "symbol_id").distinct()
    imports = calls.join(s.select(F.col("id").alias("symbol_id"), F.col("package").alias("target")), "symbol_id").select("source", "target").distinct()
    return traverse.package_closure(imports, s.select("package").distinct()).groupBy("package").agg(F.count("*").alias("n_packages"))


# the other halves of the catalogue register their queries here
from . import catalog_fields, catalog_ops  # noqa: E402, F401
