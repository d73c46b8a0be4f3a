"""Queries of the two languages: selectors, dispatch, walks by relationships, and fields that are joined on demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.operators import analysis, nav, select, traverse
from factlens.plans import pathlang, sqlnav

from .catalog import _CLOSURE, ids, nav_query, path_query, query

# --- selectors ---------------------------------------------------------------------------
nav_query("sel_struct_form", "SELECT symbol.id AS id FROM 'struct:*'", "SELECT id FROM symbols WHERE kind = 'type' AND form = 'struct'")
nav_query("sel_module_rows", "SELECT symbol.id AS id, symbol.kind AS kind FROM 'module:A*'", "SELECT DISTINCT 'module:' || module AS id, 'module' AS kind FROM symbols WHERE module LIKE 'A%'")
nav_query("sel_package_rows", "SELECT symbol.id AS id FROM 'package:EUROPE/**'", "SELECT DISTINCT 'package:' || package AS id FROM symbols WHERE package = 'EUROPE' OR package LIKE 'EUROPE/%'")
nav_query("sel_quoted", "SELECT symbol.id AS id FROM 'func:\"red *\"'", "SELECT id FROM red")
nav_query("sel_bare_suffix", "SELECT symbol.id AS id FROM 'Customer#000000001.Order#*'", "SELECT id FROM named WHERE owner_name = 'Customer#000000001' AND name LIKE 'Order#%'")
nav_query("sel_bare_children", "SELECT symbol.id AS id FROM 'Customer#000000002.*'", "SELECT id FROM named WHERE owner_name = 'Customer#000000002'")
nav_query("sel_key_owner", "SELECT symbol.id AS id FROM 'method:Customer#00000000?.Order#1*'", "SELECT id FROM named WHERE kind = 'method' AND owner_name LIKE 'Customer#00000000_' AND name LIKE 'Order#1%'")
nav_query("sel_key_full", "SELECT symbol.id AS id FROM 'record:ASIA/NATION_?.Customer#*'", "SELECT id FROM symbols WHERE kind = 'record' AND package LIKE 'ASIA/NATION_%' AND length(package) = 13")
query("SELECT DISTINCT s.id FROM red s JOIN occurrences ON symbol_id = s.id AND role <> 'definition'", "referenced_identity")(lambda f: ids(select.referenced(f, "func:red *")))
query("SELECT id, CAST(0 AS INT) AS rank FROM named WHERE query_name = 'ASIA/NATION_2.Customer#000000002'", "resolve_ranks")(lambda f: select.resolve(f, "ASIA/NATION_2.Customer#000000002").select("id", "rank"))

# --- dispatch ----------------------------------------------------------------------------
_PAIRS = ", pairs AS (SELECT DISTINCT m.id AS method_id, i.id AS face_id FROM symbols m JOIN implements p ON p.type_id = m.owner_id JOIN symbols i ON i.kind = 'method' AND i.owner_id = p.interface_id AND i.name = m.name AND i.param = m.param WHERE m.kind = 'method')"
nav_query("dispatch_callers", "SELECT symbol.id AS id, dispatch, symbol_id FROM callers('method:Order#*') WHERE dispatch = TRUE", f"{_PAIRS} SELECT enclosing_id AS id, TRUE AS dispatch, symbol_id FROM occurrences WHERE role = 'call' AND symbol_id IN (SELECT face_id FROM pairs)")
query(f"{_PAIRS} SELECT method_id, face_id AS interface_method_id FROM pairs", "dispatch_pairs")(lambda f: nav.interface_methods(f))
query(f"{_PAIRS} SELECT DISTINCT method_id AS id FROM pairs JOIN symbols i ON i.id = face_id WHERE i.name LIKE 'Order#1%'", "dispatch_implementations")(lambda f: nav.implementations(f, ids(f.symbols.where("id LIKE 'i:%' AND name LIKE 'Order#1%'"))).select(F.col("proj").alias("id")))
query(f"{_PAIRS}, c AS (SELECT DISTINCT enclosing_id AS source, symbol_id AS target FROM occurrences WHERE role = 'call' AND symbol_id IS NOT NULL) SELECT source, target, FALSE AS dispatch FROM c UNION SELECT source, method_id, TRUE FROM c JOIN pairs ON face_id = target", "forward_edges")(
    lambda f: traverse.forward_edges(f.occurrences.where("role = 'call'").select(F.col("enclosing_id").alias("source"), F.col("symbol_id").alias("target")), nav.interface_methods(f))
)
nav_query("dispatch_types", "SELECT symbol.id AS id FROM methods('interface:*')", "SELECT id FROM symbols WHERE kind = 'method' AND owner_id IN (SELECT id FROM symbols WHERE kind = 'interface')")
nav_query("callers_depth", "SELECT symbol.id AS id, symbol_id, depth, line FROM callers('func:red *', depth => 2)", f"{_PAIRS}, one AS (SELECT enclosing_id, symbol_id, line FROM occurrences WHERE role = 'call' AND symbol_id IN (SELECT id FROM red)), new AS (SELECT DISTINCT enclosing_id AS id FROM one) SELECT enclosing_id AS id, symbol_id, 1 AS depth, line FROM one UNION ALL SELECT o.enclosing_id, o.symbol_id, 2, o.line FROM occurrences o WHERE o.role = 'call' AND (o.symbol_id IN (SELECT id FROM new) OR o.symbol_id IN (SELECT face_id FROM pairs WHERE method_id IN (SELECT id FROM new)))")
nav_query("uses_span", "SELECT symbol.id AS id, enclosing_id, line FROM uses('record:Customer#*')", "SELECT o.symbol_id AS id, enclosing_id, line FROM occurrences o JOIN extents e ON e.path = o.path AND o.start_ >= e.start_ AND o.stop_ <= e.stop_ WHERE o.symbol_id IS NOT NULL")
query("SELECT enclosing_id AS id, count(*) AS n FROM occurrences WHERE role IN ('reference', 'write') AND symbol_id IN (SELECT id FROM red) GROUP BY 1", "data_users")(
    lambda f: traverse.access_edges(f.occurrences.join(ids(select.select(f, "func:red *"), "id").withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi").select(F.col("enclosing_id").alias("source"), F.col("symbol_id").alias("target"), "role"), "read", "write").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
)
query("SELECT id FROM red", "relation_applies")(lambda f: ids(nav.applicable(f, "callees", f.symbols.where("name LIKE 'red %' AND kind = 'func' OR kind = 'interface'"))))

# --- walks by relationships, and bounded graphs --------------------------------------------
nav_query("relationship_fields", "SELECT symbol.id AS id, relationship.kind AS kind, relationship.resolution AS resolution, line FROM outgoing('func:red *')", "SELECT 's:' || l_suppkey AS id, 'tpch.supplied_by' AS kind, 'exact' AS resolution, min(min(l_linenumber)) OVER (PARTITION BY l_partkey) AS line FROM lineitem WHERE 'p:' || l_partkey IN (SELECT id FROM red) GROUP BY l_partkey, l_suppkey")
nav_query("traverse_via", "SELECT symbol.id AS id, depth FROM traverse('func:red *', via => 'tpch.supplied_by', depth => 2)", "SELECT DISTINCT target_id AS id, 1 AS depth FROM supplied WHERE source_id IN (SELECT id FROM red)")
nav_query("traverse_nested", "SELECT symbol.id AS id FROM definitions(traverse('func:red *', depth => 1))", "SELECT DISTINCT target AS id FROM edges WHERE source IN (SELECT id FROM red) AND target NOT IN (SELECT id FROM red)")
nav_query("path_via", "SELECT symbol.id AS id, depth FROM path('func:red *', 'interface:Supplier#000000001', via => 'tpch.supplied_by')", ", h AS (SELECT min(source_id) AS id FROM supplied WHERE target_id = 's:1' AND source_id IN (SELECT id FROM red)) SELECT id, 0 AS depth FROM h WHERE id IS NOT NULL UNION ALL SELECT 's:1', 1 FROM h WHERE id IS NOT NULL")
nav_query("graph_via", "SELECT symbol.id AS id, depth FROM graph('interface:Supplier#000000002', via => 'tpch.supplied_by', direction => 'in', depth => 1, nodes => 10000)", "SELECT 's:2' AS id, 0 AS depth UNION ALL SELECT DISTINCT source_id, -1 FROM supplied WHERE target_id = 's:2'")
nav_query("graph_access", "SELECT symbol.id AS id, depth FROM graph('method:Order#1', access => 'write', direction => 'out', depth => 1)", "SELECT 'o:1' AS id, 0 AS depth UNION ALL SELECT DISTINCT symbol_id, 1 FROM occurrences WHERE enclosing_id = 'o:1' AND role = 'write' AND symbol_id IS NOT NULL")
nav_query(
    "graph_exclude", "SELECT symbol.id AS id, depth FROM graph('method:Order#1', access => 'call, write', exclude => 'PARTS/ECONOMY, PARTS/PROMO/...', direction => 'out', depth => 1)",
    "SELECT 'o:1' AS id, 0 AS depth UNION ALL SELECT DISTINCT symbol_id, 1 FROM occurrences JOIN symbols s ON s.id = symbol_id WHERE enclosing_id = 'o:1' AND role IN ('call', 'write') AND s.package <> 'PARTS/ECONOMY' AND s.package <> 'PARTS/PROMO' AND s.package NOT LIKE 'PARTS/PROMO/%'",
)
query("SELECT id, package AS grp FROM symbols WHERE module NOT IN ('ASIA', 'PARTS')", "exclude_external")(lambda f: traverse.excluded_ids(f.symbols.select("id", F.col("package").alias("grp")), ("external",), ("ASIA", "PARTS")))
query("SELECT id FROM symbols WHERE kind NOT IN ('record', 'interface') AND package NOT ILIKE 'asia/%'", "exclude_kinds_groups")(lambda f: ids(traverse.without(f.symbols.select("id", "kind", F.col("package").alias("grp")), ("RECORD", "inter*"), ("asia/*",))))

# --- fields ------------------------------------------------------------------------------
nav_query("field_effects", "SELECT symbol.id AS id, symbol.effects AS effects, symbol.deterministic AS deterministic FROM 'all:*'", f"{_CLOSURE}, e AS (SELECT symbol_id, string_agg(effect, ',' ORDER BY effect) AS effects, bool_and(effect = 'lock.read') AS deterministic FROM c GROUP BY symbol_id) SELECT id, CASE WHEN kind IN ('func', 'method', 'var') THEN coalesce(effects, '') END AS effects, CASE WHEN kind IN ('func', 'method', 'var') THEN coalesce(deterministic, TRUE) END AS deterministic FROM symbols LEFT JOIN e ON symbol_id = id")
query(", known AS (SELECT id FROM symbols WHERE kind = 'func' AND CAST(substr(id, 3) AS BIGINT) % 10 <> 3) SELECT DISTINCT target AS symbol_id, 'unknown' AS effect FROM edges WHERE target NOT IN (SELECT id FROM known) AND target NOT IN (SELECT symbol_id FROM effects) UNION ALL SELECT symbol_id, effect FROM effects", "effects_unproved")(
    lambda f: traverse.own_effects(f.symbols.where("kind = 'func' AND cast(substring(id, 3) as bigint) % 10 != 3"), f.edges, f.effects)
)
query("SELECT symbol_id, effect FROM effects WHERE FALSE UNION ALL SELECT id, CASE WHEN query_name = 'PARTS/ECONOMY.red ring' THEN 'clock.read' WHEN query_name LIKE 'PARTS/ECONOMY.%' THEN 'net.read' ELSE 'file.write' END FROM named WHERE query_name LIKE 'PARTS/E%'", "effects_catalogue")(
    lambda f: traverse.catalog_effects(select.named(f), f.spark.createDataFrame([("PARTS/E*", "file.write"), ("PARTS/ECONOMY.*", "net.read"), ("PARTS/ECONOMY.red ring", "clock.read")], "pattern string, effect string"))
)
nav_query("field_metrics", "SELECT symbol.id AS id, symbol.metrics.param_count AS params, symbol.metrics.body_lines AS body FROM 'api:*'", "SELECT id, CASE WHEN kind IN ('func', 'method') THEN 1 END AS params, CASE WHEN id LIKE 'o:%' THEN 3 WHEN kind = 'func' AND size > 2 THEN size END AS body FROM symbols WHERE kind IN ('func', 'method', 'record', 'interface', 'type')")
nav_query("field_measures", "SELECT symbol.id AS id, symbol.metrics.size AS size FROM 'all:*' WHERE symbol.kind != 'method'", "SELECT id, CAST(CASE WHEN kind = 'func' THEN size END AS BIGINT) AS size FROM symbols WHERE kind <> 'method'")
nav_query("field_props_alias", "SELECT symbol.id AS id, r.of.brand AS brand FROM 'func:*' r WHERE r.size > 10 AND r.size <= 20", "SELECT id, param AS brand FROM symbols WHERE kind = 'func' AND size > 10 AND size <= 20")
nav_query("field_type", "SELECT symbol.id AS id, symbol.type AS type FROM 'all:*' WHERE symbol.module MATCH 'A*'", "SELECT id, type FROM symbols WHERE module LIKE 'A%'")
_SYMBOL_GEN = ", l AS (SELECT *, lag(op) OVER k AS was, lag(fp) OVER k AS was_fp FROM declarations WINDOW k AS (PARTITION BY key ORDER BY ordinal)), g AS (SELECT ordinal, key, op, fp, CAST(sum(CASE WHEN op = 'set' AND (was IS NULL OR was = 'delete' OR was_fp <> fp) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ordinal) AS BIGINT) AS generation FROM l), now_ AS (SELECT key, arg_max(generation, ordinal) AS generation, arg_max(fp, ordinal) AS fp FROM g WHERE generation > 0 GROUP BY key HAVING arg_max(op, ordinal) = 'set')"
nav_query("field_generation", "SELECT symbol.id AS id, symbol.generation AS generation FROM 'func:*'", f"{_SYMBOL_GEN} SELECT id, generation FROM symbols LEFT JOIN now_ ON key = id WHERE kind = 'func'")
nav_query("field_test_coverage", "SELECT symbol.id AS id, symbol.test_coverage AS covered, symbol.test_coverage_generation AS at FROM 'func:red*'", f"{_SYMBOL_GEN}, c AS (SELECT symbol_id, arg_max(statements, (run_id + 6) % 12) AS s, arg_max(covered, (run_id + 6) % 12) AS c FROM coverage GROUP BY 1) SELECT id, CASE WHEN s > 0 AND fp = 1 THEN c / s END AS covered, CASE WHEN s IS NOT NULL AND fp = 1 THEN 1::BIGINT END AS at FROM symbols LEFT JOIN now_ ON key = id LEFT JOIN c ON symbol_id = id WHERE kind = 'func' AND name LIKE 'red%'")
_FILE_COUNTS = ", k AS (SELECT doc_id, count(*) AS d, count(*) FILTER (kind = 'func') AS f, count(*) FILTER (form = 'struct') AS s FROM documents JOIN symbols ON id IN ('p:' || doc_id, 'c:' || doc_id, 't:' || doc_id) GROUP BY 1)"
nav_query("file_counts", "SELECT path, file.definitions AS definitions, file.functions AS functions, f.structs AS structs FROM files() f", f"{_FILE_COUNTS} SELECT path, coalesce(d, 0) AS definitions, coalesce(f, 0) AS functions, coalesce(s, 0) AS structs FROM files LEFT JOIN k USING (doc_id) WHERE NOT excluded")
nav_query("file_wildcard", "SELECT * FROM files() WHERE file.functions > 0", f"{_FILE_COUNTS} SELECT path, split_part(package, '/', 1) AS module, package, NULL::VARCHAR AS snapshot, CASE WHEN coalesce(content, '') = '' THEN 0 ELSE len(content) - len(replace(content, chr(10), '')) + CASE WHEN suffix(content, chr(10)) THEN 0 ELSE 1 END END AS file_lines, d AS file_definitions, f AS file_functions, s AS file_structs FROM files JOIN k USING (doc_id) WHERE NOT excluded AND f > 0")
nav_query("build_requires", "SELECT path, file.build_constraint AS build FROM files() WHERE file.build_constraint REQUIRES 'linux'", "SELECT path, build FROM files WHERE NOT excluded AND doc_id % 3 = 0")
nav_query("is_null", "SELECT symbol.id AS id FROM 'api:*' WHERE symbol.owner IS NULL AND symbol.type IS NULL", "SELECT id FROM symbols WHERE kind IN ('func', 'method', 'record', 'interface', 'type') AND owner_id IS NULL")
nav_query("in_under_or", "SELECT symbol.id AS id FROM 'func:*' WHERE symbol IN 'func:red*' OR symbol.package = 'PARTS/ECONOMY'", "SELECT id FROM symbols WHERE kind = 'func' AND (name LIKE 'red%' OR package = 'PARTS/ECONOMY')")
query("SELECT count(*) AS n FROM symbols WHERE kind = 'func' AND name LIKE 'red%'", "total_before_limit")(lambda f: f.spark.range(1).select(F.lit(sqlnav.total(f, "SELECT symbol.id FROM 'func:red*' ORDER BY symbol.name LIMIT 3")).cast("long").alias("n")))
query("SELECT id FROM symbols WHERE module IN ('ASIA', 'EUROPE') AND kind = 'record' AND name LIKE '%7'", "scoped_roots")(lambda f: sqlnav.run(f, "SELECT symbol.id AS id FROM 'record:*7'", None, roots=["ASIA", "EUROPE"]))
query("SELECT enclosing_id AS id, line FROM occurrences WHERE role = 'call' AND symbol_id IN (SELECT id FROM red) AND package LIKE 'ASIA/%'", "scoped_callers")(lambda f: sqlnav.run(f.replaced(occurrences=f.scoped(["ASIA"]).occurrences), "SELECT symbol.id AS id, line FROM callers('func:red *')", None))
query("SELECT count(*) AS n FROM symbols WHERE kind = 'func'", "syntax_rows")(lambda f: sqlnav.run_syntax(f.replaced(symbols=f.symbols.withColumn("id", F.when(F.col("kind") != "func", F.col("id")))), "SELECT symbol.name AS name, symbol.package AS package FROM 'func:*'", None).agg(F.count("*").alias("n")))
query("SELECT sort, count(*) AS n FROM (VALUES ('function'), ('kind')) AS t(sort) JOIN range(15) ON TRUE GROUP BY sort", "catalogue_sizes")(lambda f: sqlnav.catalog(f).where("sort != 'field' AND name != 'uses'").groupBy("sort").agg(F.count("*").alias("n")))

# --- the compact language ----------------------------------------------------------------
path_query("modifiers_alternatives", "method:Order#1* +pkg:EUROPE/* +pkg:ASIA/* -path:EUROPE/NATION_3", "SELECT id FROM symbols WHERE kind = 'method' AND name LIKE 'Order#1%' AND (package LIKE 'EUROPE/%' OR package LIKE 'ASIA/%') AND package <> 'EUROPE/NATION_3'")
path_query("row_filters", "func:red* < -f 1995-01 -pkg NATION_2", "SELECT DISTINCT enclosing_id AS id FROM occurrences WHERE role = 'call' AND symbol_id IN (SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%') AND suffix(path, '1995-01') AND package NOT LIKE '%/NATION_2'")
path_query("row_filter_tree", "func:red* ~w +pkg ASIA/...", "SELECT DISTINCT enclosing_id AS id FROM occurrences WHERE role = 'write' AND symbol_id IN (SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%') AND package LIKE 'ASIA/%'")
path_query("callers_within", "func:\"red ring\" <<2", ", u AS (SELECT DISTINCT symbol_id AS a, enclosing_id AS b FROM occurrences WHERE role = 'call' AND symbol_id IS NOT NULL UNION SELECT target, source FROM edges), r AS (SELECT id FROM symbols WHERE kind = 'func' AND name = 'red ring'), one AS (SELECT DISTINCT b FROM u WHERE a IN (SELECT id FROM r)) SELECT b AS id FROM (SELECT b FROM one UNION SELECT u.b FROM u JOIN one ON u.a = one.b) WHERE b NOT IN (SELECT id FROM r)")
query("SELECT enclosing_id AS proj, path, line FROM occurrences WHERE role = 'call' AND symbol_id IN (SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%') ORDER BY path, line, column_, enclosing_id LIMIT 50", "compact_listing")(lambda f: pathlang.listing(f, "func:red* <", 50).select("proj", "path", "line"))
query("SELECT id FROM symbols WHERE kind IN ('func', 'record') AND package NOT LIKE 'ASIA/%' AND package LIKE '%E%'", "structured_flags")(lambda f: pathlang.run(f, pathlang.structured(["func:*", "record:*"], ["**/*E*/**", "**/*E*"], ["ASIA/**"])))
query("SELECT path, split_part(package, '/', 1) AS root FROM files WHERE split_part(package, '/', 1) <> 'web'", "head_files")(lambda f: analysis.head_files(f.files, f.files.select(F.split("path", "/")[0].alias("root")).where("root != 'web'")).select("path", "root"))
query("SELECT id FROM symbols WHERE kind = 'func' AND name LIKE 'red%' AND (id IN (SELECT symbol_id FROM occurrences WHERE symbol_id IS NOT NULL) OR CAST(substr(id, 3) AS BIGINT) IN (SELECT doc_id FROM documents))", "active_selection")(lambda f: ids(select.select(select.active_facts(f), "func:red*")))
query("SELECT id FROM symbols WHERE kind = 'record' AND module = 'ASIA' AND CAST(substr(id, 3) AS BIGINT) IN (SELECT doc_id FROM documents)", "own_selection")(
    lambda f: sqlnav.run(f.replaced(declared_in=f.declared_in.withColumn("path", F.concat(F.lit("ASIA/"), "path"))), "SELECT symbol.id AS id FROM 'record:*'", None, own=True)
)
