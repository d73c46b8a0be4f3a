"""Analyses over facts: files and metrics, tests and coverage, and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPLETE = ("indexed", "excluded")


def line_count(text: Column) -> Column:
    """Physical lines: none in an empty text, none after the last line end, one for CRLF."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(text.isNull() | (text == ""), 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def file_rows(files: DataFrame, include_excluded: bool = False) -> DataFrame:
    f = files if include_excluded else files.where("NOT excluded")
    return f.select("path", "package", "language", line_count(F.col("content")).alias("lines"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("digest"), "build")


def declaration_counts(declared_in: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, definitions, functions, structs) of the symbols (path, symbol_id) that files declare.

    Functions are funcs and methods of types that aren't interfaces; structs are types of that form.
    """
    kinds = symbols.select(F.col("id").alias("symbol_id"), "kind", "form", "owner_id")
    faces = symbols.where("kind = 'interface'").select(F.col("id").alias("owner_id"), F.lit(True).alias("face"))
    rows = declared_in.distinct().join(kinds, "symbol_id").join(faces, "owner_id", "left")
    function = (F.col("kind") == "func") | ((F.col("kind") == "method") & F.col("face").isNull())
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("path").agg(F.count("*").alias("definitions"), n(function).alias("functions"), n((F.col("kind") == "struct") | (F.col("kind").eqNullSafe("type") & F.col("form").eqNullSafe("struct"))).alias("structs"))


def head_files(files: DataFrame, heads: DataFrame) -> DataFrame:
    """(root, path, language, excluded) of the files of roots that have a head (root)."""
    return files.withColumn("root", F.split("path", "/")[0]).join(heads.select("root").distinct(), "root", "left_semi").select("root", "path", "language", "excluded")


def grouped_by_package(rows: DataFrame, key: str = "name") -> DataFrame:
    """(package, members): the distinct names of nodes of each package in order, and how many there are."""
    return rows.select("package", key).distinct().groupBy("package").agg(F.array_sort(F.collect_list(key)).alias("members"), F.count("*").alias("n"))


def package_facet(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("package").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "package")


def rollup_counts(rows: DataFrame) -> DataFrame:
    """Rows (package, kind) counted by package and kind, by package, and in all."""
    return rows.rollup("package", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def since_started(results: DataFrame, runs: DataFrame, since: int) -> DataFrame:
    """Results of the runs (run_id, started) that started then or later."""
    return results.join(runs.where(F.col("started") >= since).select("run_id"), "run_id", "left_semi").select(*results.columns)


def flaky(results: DataFrame) -> DataFrame:
    """Per test: runs, retry flakes (runs with both outcomes), and the failure rate over the groups that flaked.

    A group has one closure and environment; it flaked if it passed and failed.
    Skipped attempts count in neither.
    """
    p, f = F.col("outcome") == "pass", F.col("outcome").isin("fail", "error")
    per_run = results.groupBy("test_id", "run_id").agg(F.max(p).alias("passed"), F.max(f).alias("failed"))
    runs = per_run.groupBy("test_id").agg(F.count("*").alias("runs"), F.count(F.when(F.col("passed") & F.col("failed"), 1)).alias("retry_flakes"))
    groups = results.groupBy("test_id", "closure_source", "closure", "environment").agg(F.count(F.when(p, 1)).alias("passes"), F.count(F.when(f, 1)).alias("failures")).where("passes > 0 AND failures > 0")
    rate = groups.groupBy("test_id").agg(F.sum("passes").alias("passes"), F.sum("failures").alias("failures"))
    return runs.join(rate, "test_id").withColumn("flake_rate", F.col("failures") / (F.col("passes") + F.col("failures")))


def last_outcome(results: DataFrame) -> DataFrame:
    return results.groupBy("test_id").agg(F.max_by("outcome", F.struct("run_id", "attempt")).alias("outcome"))


def newest_coverage(coverage: DataFrame, runs: DataFrame) -> DataFrame:
    """(symbol_id, fp, generation, ratio) of the run that started last, of equal ones the least id, without what single tests cover; no statements give null."""
    whole = coverage.where("test_id IS NULL").join(runs, "run_id")
    newest = whole.groupBy("symbol_id", "fp").agg(F.max_by(F.struct("statements", "covered", "generation"), F.struct("started", -F.col("run_id"))).alias("x"))
    return newest.select("symbol_id", "fp", F.col("x.generation").alias("generation"), F.when(F.col("x.statements") > 0, F.col("x.covered") / F.col("x.statements")).alias("ratio"))


def coverage_ratio(coverage: DataFrame, runs: DataFrame) -> DataFrame:
    return newest_coverage(coverage, runs).select("symbol_id", "ratio")


def innermost(blocks: DataFrame, extents: DataFrame) -> DataFrame:
    """Blocks (path, line, statements, covered) given to the shortest extent (path, id, first, last) around them."""
    hit = blocks.join(extents, (blocks["path"] == extents["path"]) & blocks["line"].between(F.col("first"), F.col("last"))).drop(extents["path"])
    near = Window.partitionBy("path", "line").orderBy(F.col("last") - F.col("first"), "id")
    return hit.withColumn("r", F.row_number().over(near)).where("r = 1").groupBy("path", "id").agg(F.sum("statements").alias("statements"), F.sum("covered").alias("covered"))


def coverage_blocks(text: DataFrame) -> DataFrame:
    """Blocks of a text profile `path:l.c,l.c statements count`, repeated ones summed; other lines are skipped."""
    form = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"
    part = lambda k: F.regexp_extract("value", form, k)
    rows = text.where(F.col("value").rlike(form)).select(part(1).alias("path"), *(part(k).cast("int").alias(n) for k, n in enumerate(("line", "col", "end_line", "end_col"), 2)), part(6).cast("long").alias("statements"), part(7).cast("long").alias("count"))
    return rows.groupBy("path", "line", "col", "end_line", "end_col", "statements").agg(F.sum("count").alias("count"))


def set_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 over the sorted distinct values of each key, each as `<bytes>:<value>,`."""
    item = F.transform(F.array_sort(F.collect_set(value)), lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x, F.lit(",")))
    return rows.groupBy(key).agg(F.sha2(F.array_join(item, "").cast("binary"), 256).alias("digest"))


def closures(edges: DataFrame, symbols: DataFrame, tests: DataFrame, depth: int = 8) -> DataFrame:
    """(test_id, digest) of what each test (test_id, symbol_id) reaches within `depth` calls, itself included, with its content (id, fp).

    The walk is one of pairs (test, symbol), so tests share rounds.
    """
    from .traverse import Rounds

    cut = Rounds(edges.sparkSession).cut
    seen = frontier = cut(tests.select("test_id", "symbol_id").distinct())
    for _ in range(depth):
        step = frontier.join(edges.select(F.col("source").alias("symbol_id"), "target"), "symbol_id").select("test_id", F.col("target").alias("symbol_id")).distinct()
        frontier = cut(step.join(seen, ["test_id", "symbol_id"], "left_anti").select("test_id", "symbol_id"))
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    item = seen.join(symbols.select(F.col("id").alias("symbol_id"), "fp"), "symbol_id").select("test_id", F.concat_ws("\n", "symbol_id", F.col("fp").cast("string")).alias("item"))
    return set_digest(item, "test_id", "item")


def baseline(results: DataFrame, runs: DataFrame) -> DataFrame:
    """The run that started last, of equal ones the least id, among those without a failed or broken test."""
    bad = results.where("outcome IN ('fail', 'error')").select("run_id").distinct()
    return runs.join(results.select("run_id").distinct(), "run_id", "left_semi").join(bad, "run_id", "left_anti").orderBy(F.col("started").desc(), "run_id").limit(1).select("run_id")


def skip_plan(results: DataFrame, current: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(test_id, skip): a test is skipped if it passed in the baseline run with the closure it has now.

    Where both sides have a package fingerprint (package_fp), that must be the same too.
    Without runs (run_id, started) the greatest run id is the newest.
    """
    runs = results.select("run_id", F.col("run_id").alias("started")).distinct() if runs is None else runs
    same = ["closure", *(["package_fp"] if "package_fp" in results.columns and "package_fp" in current.columns else [])]
    ok = results.where("outcome = 'pass'").join(baseline(results, runs), "run_id", "left_semi").select("test_id", *(F.col(c).alias(f"was_{c}") for c in same)).distinct()
    hit = F.lit(True)
    for c in same:
        hit = hit & F.col(c).eqNullSafe(F.col(f"was_{c}")) & F.col(c).isNotNull()
    tried = current.join(ok, "test_id", "left").select("test_id", *same, hit.alias("skip"))
    return tried.groupBy("test_id", *same).agg(F.max("skip").alias("skip")).select("test_id", "skip")


def coverage_gaps(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(~F.col("coverage").isin(*COMPLETE)).orderBy("ordinal")


def measures(long: DataFrame, names: list[str]) -> DataFrame:
    """Rows (symbol_id, name, value) as one row a symbol with a column for each name."""
    return long.groupBy("symbol_id").pivot("name", names).agg(F.max("value"))


def gap_violations(snapshots: DataFrame, rule: str = "coverage-gap") -> DataFrame:
    """One violation for each snapshot and coverage that a rule can't see through."""
    gaps = coverage_gaps(snapshots).dropDuplicates(["ordinal", "coverage"])
    message = F.concat(F.lit("snapshot "), F.col("ordinal").cast("string"), F.lit(" has "), F.coalesce("coverage", F.lit("no")), F.lit(" coverage"))
    return gaps.select(F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), message.alias("message"))


def findings_by(findings: DataFrame, key: str) -> DataFrame:
    """Violations gathered by `path` or `symbol`: how many, the worst severity, and messages in order."""
    if key not in ("path", "symbol"):
        raise ValueError("findings are grouped by path or symbol")
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    item = F.struct(F.coalesce("line", F.lit(0)).alias("line"), "rule", "message")
    grouped = findings.groupBy(key).agg(F.count("*").alias("n"), F.max_by("severity", rank).alias("worst"), F.array_sort(F.collect_set(item)).alias("items"))
    return grouped.select(key, "n", "worst", F.transform("items", lambda x: x["message"]).alias("messages"))


def change_counts(rows: DataFrame, reason: str = "change") -> DataFrame:
    return rows.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def lint(facts, rules: list[dict]) -> DataFrame:
    """Violations of SQL rules: each row of a rule's query gives its message, in rule and row order.

    A rule has name, severity, query, message with {field} places, and lists `include`
    and `exclude` of path patterns.  A query with a limit, a path or a graph is refused.  A
    column `symbol` of the rows stays beside the message.
    """
    from functools import reduce

    from factlens.functions.glob import glob
    from factlens.plans.sqlnav import row_query, run

    out = []
    for rule in rules:
        row_query(rule["query"])
        rows = run(facts, rule["query"], limit=None)
        if "path" in rows.columns:
            if rule.get("include"):
                rows = rows.where(reduce(Column.__or__, (glob(F.col("path"), p) for p in rule["include"])))
            for p in rule.get("exclude", []):
                rows = rows.where(~F.coalesce(glob(F.col("path"), p), F.lit(False)))
        message = F.lit(rule["message"])
        for c in rows.columns:
            message = F.replace(message, F.lit("{" + c + "}"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
        site = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("line", "int"), ("symbol", "string"))]
        out.append(rows.select(F.lit(rule["name"]).alias("rule"), F.lit(rule.get("severity", "warning")).alias("severity"), message.alias("message"), *site))
    found = reduce(DataFrame.unionByName, out).distinct()
    return found if any("symbol" in {a for _, a in row_query(r["query"]).columns or []} for r in rules) else found.drop("symbol")
