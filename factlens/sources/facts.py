"""Program facts as DataFrames.

`Facts` names the frames that all operators take.  `from_tables` derives them from the
relational tables of a Parquet folder; `from_frames` takes facts that were extracted
elsewhere.  Frames are lazy: a query reads the columns and rows that it needs.

`indexed` keeps derived frames as Parquet in the folder that the cluster shares, each
written when it is first asked for, so that the derivation costs once a session and not
once a query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import folder

SCHEMAS = {
    "kinds": "name string, category string",
    "symbols": "id string, module string, package string, kind string, owner_id string, name string, visibility string, params array<string>, form string, type string, props string",
    "occurrences": "path string, package string, symbol_id string, role string, line int, enclosing_id string, target_name string, column int, start long, stop long",
    "extents": "symbol_id string, path string, start long, stop long, first int, last int",
    "metrics": "symbol_id string, param_count int, body_lines int",
    "measures": "symbol_id string, name string, value long",
    "declared_measures": "kind string, name string",
    "declarations": "ordinal long, key string, op string, fp long",
    "relationships": "source_id string, targets array<string>, kind string, path string, line int, resolution string",
    "embeds": "id string, embedded string",
    "implements": "type_id string, interface_id string",
    "edges": "source string, target string",
    "effects": "symbol_id string, effect string",
    "files": "path string, package string, language string, content string, excluded boolean, build string",
    "declared_in": "path string, symbol_id string",
    "snapshots": "ordinal long, base long, coverage string",
    "deltas": "ordinal long, key string, op string, fp long",
    "results": "test_id string, run_id long, attempt int, outcome string, closure_source string, closure string, environment string",
    "coverage": "run_id long, symbol_id string, statements long, covered long, fp long, test_id string, generation long",
    "runs": "run_id long, started long",
}

#: Schemas of the relational tables; with them a read starts no job of its own.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}

# The kinds that exist everywhere, with their categories.
KINDS = [
    ("func", "callable"), ("method", "callable"), ("type", "type"), ("struct", "type"), ("interface", "type"), ("record", "type"), ("enum", "type"),
    ("field", "data"), ("var", "data"), ("const", "data"), ("table", "data"), ("column", "data"), ("package", "container"), ("module", "container"), ("file", "container"),
]


class Facts:
    """Frames by name; one that is given as a function is made when it is first read."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame | Callable[[], DataFrame]]) -> None:
        self.spark, self._frames = spark, frames
        self._kinds: dict[str, str] | None = None

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name not in frames:
            raise AttributeError(name)
        if callable(frames[name]) and not isinstance(frames[name], DataFrame):
            frames[name] = frames[name]()
        return frames[name]

    def replaced(self, **frames: DataFrame) -> Facts:
        return Facts(self.spark, {**self._frames, **frames})

    def categories(self) -> dict[str, str]:
        """Category of each kind; the registry of kinds is kept by hand and has MOST_KINDS rows at most."""
        if self._kinds is None:
            rows = self.kinds.limit(MOST_KINDS + 1).collect()
            if len(rows) > MOST_KINDS:
                raise ValueError(f"more than {MOST_KINDS} kinds")
            self._kinds = {r["name"]: r["category"] for r in rows}
        return self._kinds

    def kinds_in(self, *categories: str) -> list[str]:
        return sorted(k for k, c in self.categories().items() if c in categories)

    def scoped(self, roots: list[str]) -> Facts:
        """The facts of these roots alone: what they declare, and what occurs in them."""
        at = lambda d: d.where(F.split("package", "/")[0].isin(roots))
        return self.replaced(occurrences=at(self.occurrences), files=at(self.files), symbols=self.symbols.where(F.col("module").isin(roots)))


MOST_KINDS = 10_000


def from_frames(spark: SparkSession, **frames) -> Facts:
    """Facts from frames or row lists; what is missing is empty, and rows may lack their last columns."""
    out = {}
    for name, schema in SCHEMAS.items():
        given = frames.get(name, KINDS if name == "kinds" else [])
        if not isinstance(given, DataFrame):
            width = len(T._parse_datatype_string(schema).fields)
            given = spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in given], schema)
        out[name] = given
    return Facts(spark, out)


def from_json(spark: SparkSession, path: str) -> Facts:
    """A publication: one folder of JSON lines for each frame; unknown or ill-typed values fail."""
    frames = {n: spark.read.schema(s).option("mode", "FAILFAST").json(f"{path}/{n}") for n, s in SCHEMAS.items() if n in ("symbols", "occurrences", "relationships")}
    return from_frames(spark, **frames)


#: Version of the frames' schemas, written beside them.
VERSION = 2


def write_parquet(facts: Facts, path: str) -> None:
    for name in SCHEMAS:
        getattr(facts, name).write.mode("overwrite").parquet(f"{path}/{name}")
    facts.spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version")


def read_parquet(spark: SparkSession, path: str) -> Facts:
    """Stored facts, to read only; facts of another schema version, or without a frame's columns, are refused."""
    found = [r[0] for r in spark.read.schema("version int").parquet(f"{path}/version").collect()]
    if found != [VERSION]:
        raise ValueError(f"the facts at {path} have schema version {found}, and not {VERSION}; publish them anew")
    frames = {}
    for name, schema in SCHEMAS.items():
        stored = spark.read.parquet(f"{path}/{name}").schema
        lacking = [f.name for f in T._parse_datatype_string(schema).fields if f.name not in stored.names or stored[f.name].dataType != f.dataType]
        if lacking:
            raise ValueError(f"{name} at {path} lacks {', '.join(lacking)}")
        frames[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
    return Facts(spark, frames)


#: What a stored frame is sorted by within its files, so that a scan for it skips row groups.
ORDERED = {"symbols": ("kind", "name"), "occurrences": ("role", "symbol_id"), "edges": ("source",), "deltas": ("key",), "coverage": ("symbol_id",)}
_stores: dict[tuple[str, str], Facts] = {}


def indexed(spark: SparkSession, sf_dir: str) -> Facts:
    """`from_tables`, each frame kept once it was read; tables that changed since are derived anew."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = "".join(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()};" for x in fs.listStatus(jvm))
    key = (spark.sparkContext.applicationId, hashlib.sha256(f"{sf_dir}\n{state}".encode()).hexdigest()[:16])
    if key not in _stores:
        derived, root = from_tables(spark, sf_dir), folder(spark, f"facts-{key[1]}")

        def kept(name: str) -> Callable[[], DataFrame]:
            def make() -> DataFrame:
                frame = getattr(derived, name)
                if name in ORDERED:
                    frame = frame.sortWithinPartitions(*ORDERED[name])
                frame.write.mode("overwrite").parquet(f"{root}/{name}")
                return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")

            return make

        small = ("kinds", "declared_measures", "snapshots")
        _stores[key] = Facts(spark, {name: getattr(derived, name) if name in small else kept(name) for name in SCHEMAS})
    return _stores[key]


def prepare(facts: Facts, *names: str) -> None:
    """Writes the named frames of indexed facts, or all, ahead of queries."""
    for name in names or SCHEMAS:
        getattr(facts, name)


def from_tables(spark: SparkSession, sf_dir: str) -> Facts:
    t = lambda n: spark.read.schema(TABLES[n]).parquet(f"{sf_dir}/{n}.parquet")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("module"), F.concat("r_name", F.lit("/"), "n_name").alias("package"))
    none, no_params = F.lit(None).cast("string"), F.array().cast("array<string>")
    whole = lambda d: d.select(*(F.col(c).cast(f.dataType).alias(c) if (c := f.name) in d.columns else F.lit(None).cast(f.dataType).alias(c) for f in T._parse_datatype_string(SCHEMAS["symbols"]).fields))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "module", "package")
    records = customer.select(text("c:", "c_custkey").alias("id"), "module", "package", F.lit("record").alias("kind"), none.alias("owner_id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, "public").otherwise("private").alias("visibility"), no_params.alias("params"))
    types = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(text("s:", "s_suppkey").alias("id"), "module", "package", F.lit("interface").alias("kind"), none.alias("owner_id"), F.col("s_name").alias("name"), F.lit("public").alias("visibility"), no_params.alias("params"))
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    methods = orders.select(text("o:", "o_orderkey").alias("id"), "module", "package", F.lit("method").alias("kind"), text("c:", "o_custkey").alias("owner_id"), text("Order#", "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "private").otherwise("public").alias("visibility"), F.array("o_orderpriority").alias("params"))
    # every fiftieth order of a customer that implements an interface is a method of that interface too
    shared = orders.where("c_mktsegment = 'BUILDING' AND o_orderkey % 50 = 0").withColumn("face", F.expr("concat('s:', cast(c_custkey % 10 + 1 as string))"))
    faces = shared.select(text("i:", "o_orderkey").alias("id"), "module", "package", F.lit("method").alias("kind"), F.col("face").alias("owner_id"), text("Order#", "o_orderkey").alias("name"), F.lit("public").alias("visibility"), F.array("o_orderpriority").alias("params"))
    forms = nation.select(text("t:", "n_nationkey").alias("id"), "module", "package", F.lit("type").alias("kind"), none.alias("owner_id"), text("Nation", "n_nationkey").alias("name"), F.lit("public").alias("visibility"), no_params.alias("params"), F.when(F.col("n_nationkey") % 2 == 0, "struct").otherwise("alias").alias("form"))
    variables = t("region").select(text("v:", "r_regionkey").alias("id"), F.col("r_name").alias("module"), F.col("r_name").alias("package"), F.lit("var").alias("kind"), none.alias("owner_id"), text("Region", "r_regionkey").alias("name"), F.lit("private").alias("visibility"), no_params.alias("params"), F.concat(F.lit("*"), "r_name").alias("type"))
    part = t("part")
    funcs = part.select(text("p:", "p_partkey").alias("id"), F.lit("PARTS").alias("module"), F.concat(F.lit("PARTS/"), "p_type").alias("package"), F.lit("func").alias("kind"), none.alias("owner_id"), F.col("p_name").alias("name"), F.lit("public").alias("visibility"), F.array("p_brand").alias("params"), F.to_json(F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("of"))).alias("props"))
    line = t("lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    role = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "reference").otherwise("write")
    open_call = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")
    home = orders.select("o_orderkey", "package")
    occurrences = line.join(home, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat("package", F.lit("/"), month).alias("path"), "package", F.when(~open_call, text("p:", "l_partkey")).alias("symbol_id"), role.alias("role"), F.col("l_linenumber").alias("line"), text("o:", "l_orderkey").alias("enclosing_id"), text("part-", "l_partkey").alias("target_name"), F.col("l_quantity").cast("int").alias("column"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("start"), (F.col("l_partkey") * 10 + F.col("l_linenumber") + 5).alias("stop"))
    through = shared.select(F.concat("package", F.lit("/faces")).alias("path"), "package", text("i:", "o_orderkey").alias("symbol_id"), F.lit("call").alias("role"), F.lit(1).alias("line"), text("o:", "o_orderkey").alias("enclosing_id"), text("face-", "o_orderkey").alias("target_name"), F.lit(1).alias("column"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("stop"))
    occurrences = occurrences.union(through)
    extents = customer.where("c_custkey % 5 = 0").select(text("c:", "c_custkey").alias("symbol_id"), F.concat("package", F.lit("/1995-01")).alias("path"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 2000).alias("stop"), (F.col("c_custkey") % 7).cast("int").alias("first"), (F.col("c_custkey") % 7 + 4).cast("int").alias("last"))
    metrics = part.select(text("p:", "p_partkey").alias("symbol_id"), F.lit(1).alias("param_count"), F.when(F.col("p_size") > 2, F.col("p_size")).alias("body_lines")).union(orders.select(text("o:", "o_orderkey"), F.lit(1), F.lit(3))).union(shared.select(text("i:", "o_orderkey"), F.lit(1), F.lit(None).cast("int")))
    measures = part.select(text("p:", "p_partkey").alias("symbol_id"), F.lit("size").alias("name"), F.col("p_size").cast("long").alias("value"))
    declarations = line.where("l_linenumber = 1").groupBy(F.month("l_shipdate").cast("long").alias("ordinal"), text("p:", "l_partkey").alias("key")).agg((F.count("*") % 3).alias("fp"), F.min("l_orderkey").alias("k")).select("ordinal", "key", F.when(F.col("k") % 11 == 0, "delete").otherwise("set").alias("op"), "fp")
    relationships = line.groupBy("l_partkey").agg(F.array_sort(F.collect_set(text("s:", "l_suppkey"))).alias("targets"), F.min("l_linenumber").alias("line")).select(text("p:", "l_partkey").alias("source_id"), "targets", F.lit("tpch.supplied_by").alias("kind"), F.lit("parts").alias("path"), "line", F.lit("exact").alias("resolution"))
    embeds = customer.where("c_custkey % 3 = 0").select(text("c:", "c_custkey").alias("id"), F.concat(F.lit("c:"), F.expr("cast(c_custkey div 3 as string)")).alias("embedded"))
    implements = customer.where("c_mktsegment = 'BUILDING'").select(text("c:", "c_custkey").alias("type_id"), F.concat(F.lit("s:"), F.expr("cast(c_custkey % 10 + 1 as string)")).alias("interface_id"))
    pair = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    nxt = pair.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_part"))
    edges = pair.where("l_quantity <= 10").join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey != to_part").select(text("p:", "l_partkey").alias("source"), text("p:", "to_part").alias("target")).distinct()
    effects = part.where("p_size <= 4").select(text("p:", "p_partkey").alias("symbol_id"), F.element_at(F.array(F.lit("net.read"), F.lit("file.write"), F.lit("lock.read"), F.lit("clock.read")), F.col("p_size").cast("int")).alias("effect"))
    docs = t("documents")
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("package"), F.col("lang").alias("language"), F.col("text").alias("content"), (F.col("doc_id") % 7 == 0).alias("excluded"), F.when(F.col("doc_id") % 3 == 0, F.lit("linux && !cgo")).when(F.col("doc_id") % 3 == 1, F.lit("linux || darwin")).alias("build"))
    declared_in = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.explode(F.array(text("p:", "doc_id"), text("c:", "doc_id"), text("t:", "doc_id"))).alias("symbol_id"))
    events = t("events").select("*", F.dayofmonth("ts").cast("long").alias("day"))
    snapshots = spark.range(1, 32).select(F.col("id").alias("ordinal"), F.when(F.col("id") > 1, F.col("id") - 1).alias("base"), F.when(F.col("id") % 5 == 0, "partial").otherwise("indexed").alias("coverage"))
    last = events.groupBy("user_id", "day").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x"))
    deltas = last.select(F.col("day").alias("ordinal"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("x.event_type") == "error", "delete").otherwise("set").alias("op"), F.floor("x.value").cast("long").alias("fp"))
    results = events.select(F.concat(F.lit("t:"), F.col("user_id").cast("string")).alias("test_id"), F.col("day").alias("run_id"), F.col("event_id").cast("int").alias("attempt"), F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("pass").alias("outcome"), F.lit("static").alias("closure_source"), F.expr("cast(user_id % 5 as string)").alias("closure"), F.expr("cast(event_id % 3 as string)").alias("environment"))
    coverage = line.groupBy(F.month("l_shipdate").cast("long").alias("run_id"), text("p:", "l_partkey").alias("symbol_id")).agg(F.sum("l_quantity").cast("long").alias("statements"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).cast("long").alias("covered")).select("run_id", "symbol_id", "statements", "covered", F.lit(1).cast("long").alias("fp"), none.alias("test_id"), F.lit(1).cast("long").alias("generation"))
    # what single tests cover is no answer to how well a symbol is covered
    single = coverage.where("run_id = 12").select("run_id", "symbol_id", F.lit(1).cast("long").alias("statements"), F.lit(1).cast("long").alias("covered"), "fp", F.lit("t:1").alias("test_id"), "generation")
    coverage = coverage.union(single)
    # the later half of the year was run first
    runs = spark.range(1, 13).select(F.col("id").alias("run_id"), ((F.col("id") + 6) % 12).alias("started"))
    return from_frames(
        spark, symbols=reduce(DataFrame.unionByName, map(whole, (records, types, methods, faces, forms, variables, funcs))), occurrences=occurrences, relationships=relationships, embeds=embeds, implements=implements, edges=edges, effects=effects, files=files, snapshots=snapshots, deltas=deltas, results=results, coverage=coverage, extents=extents, metrics=metrics, measures=measures, declared_measures=[("func", "size")], declarations=declarations, declared_in=declared_in, runs=runs
    )


#: The same facts as common table expressions over the relational tables.
FACTS_SQL = r"""
nations AS (SELECT n_nationkey, r_name AS module, r_name || '/' || n_name AS package FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (SELECT c.*, module, package FROM customer c JOIN nations ON c_nationkey = n_nationkey),
shared AS (SELECT o.*, c.module, c.package, 's:' || (c_custkey % 10 + 1) AS face FROM orders o JOIN customers c ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderkey % 50 = 0),
symbols AS (
  SELECT 'c:' || c_custkey AS id, module, package, 'record' AS kind, NULL AS owner_id, c_name AS name, CASE WHEN c_acctbal >= 0 THEN 'public' ELSE 'private' END AS visibility, NULL AS param, NULL AS form, NULL AS type, NULL::INTEGER AS size FROM customers
  UNION ALL SELECT 's:' || s_suppkey, module, package, 'interface', NULL, s_name, 'public', NULL, NULL, NULL, NULL FROM supplier JOIN nations ON s_nationkey = n_nationkey
  UNION ALL SELECT 'o:' || o_orderkey, module, package, 'method', 'c:' || o_custkey, 'Order#' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'private' ELSE 'public' END, o_orderpriority, NULL, NULL, NULL FROM orders JOIN customers ON o_custkey = c_custkey
  UNION ALL SELECT 'i:' || o_orderkey, module, package, 'method', face, 'Order#' || o_orderkey, 'public', o_orderpriority, NULL, NULL, NULL FROM shared
  UNION ALL SELECT 't:' || n_nationkey, module, package, 'type', NULL, 'Nation' || n_nationkey, 'public', NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'struct' ELSE 'alias' END, NULL, NULL FROM nations
  UNION ALL SELECT 'v:' || r_regionkey, r_name, r_name, 'var', NULL, 'Region' || r_regionkey, 'private', NULL, NULL, '*' || r_name, NULL FROM region
  UNION ALL SELECT 'p:' || p_partkey, 'PARTS', 'PARTS/' || p_type, 'func', NULL, p_name, 'public', p_brand, NULL, NULL, p_size FROM part),
occurrences AS (
  SELECT package || '/' || strftime(l_shipdate, '%Y-%m') AS path, package, CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'O') THEN 'p:' || l_partkey END AS symbol_id,
         CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'reference' ELSE 'write' END AS role, l_linenumber AS line, 'o:' || l_orderkey AS enclosing_id, 'part-' || l_partkey AS target_name,
         CAST(trunc(l_quantity) AS INT) AS column_, l_partkey * 10 + l_linenumber AS start_, l_partkey * 10 + l_linenumber + 5 AS stop_
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customers ON o_custkey = c_custkey
  UNION ALL SELECT package || '/faces', package, 'i:' || o_orderkey, 'call', 1, 'o:' || o_orderkey, 'face-' || o_orderkey, 1, 0, 5 FROM shared),
extents AS (SELECT 'c:' || c_custkey AS symbol_id, package || '/1995-01' AS path, c_custkey * 10 AS start_, c_custkey * 10 + 2000 AS stop_ FROM customers WHERE c_custkey % 5 = 0),
declarations AS (SELECT CAST(month(l_shipdate) AS BIGINT) AS ordinal, 'p:' || l_partkey AS key, CASE WHEN min(l_orderkey) % 11 = 0 THEN 'delete' ELSE 'set' END AS op, count(*) % 3 AS fp FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
supplied AS (SELECT DISTINCT 'p:' || l_partkey AS source_id, 's:' || l_suppkey AS target_id FROM lineitem),
embeds AS (SELECT 'c:' || c_custkey AS id, 'c:' || (c_custkey // 3) AS embedded FROM customers WHERE c_custkey % 3 = 0),
implements AS (SELECT 'c:' || c_custkey AS type_id, 's:' || (c_custkey % 10 + 1) AS interface_id FROM customers WHERE c_mktsegment = 'BUILDING'),
edges AS (
  SELECT DISTINCT 'p:' || a.l_partkey AS source, 'p:' || b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity <= 10 AND a.l_partkey <> b.l_partkey),
effects AS (SELECT 'p:' || p_partkey AS symbol_id, ['net.read', 'file.write', 'lock.read', 'clock.read'][p_size] AS effect FROM part WHERE p_size <= 4),
files AS (SELECT source || '/' || doc_id AS path, source AS package, lang AS language, text AS content, doc_id % 7 = 0 AS excluded, CASE doc_id % 3 WHEN 0 THEN 'linux && !cgo' WHEN 1 THEN 'linux || darwin' END AS build, doc_id FROM documents),
day_events AS (SELECT *, CAST(day(ts) AS BIGINT) AS day FROM events),
deltas AS (
  SELECT day AS ordinal, 'u:' || user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, CAST(floor(value) AS BIGINT) AS fp
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS r FROM day_events) WHERE r = 1),
results AS (
  SELECT 't:' || user_id AS test_id, day AS run_id, CAST(event_id AS INT) AS attempt, CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'pass' END AS outcome,
         CAST(user_id % 5 AS VARCHAR) AS closure, CAST(event_id % 3 AS VARCHAR) AS environment FROM day_events),
coverage AS (
  SELECT CAST(month(l_shipdate) AS BIGINT) AS run_id, 'p:' || l_partkey AS symbol_id, CAST(sum(l_quantity) AS BIGINT) AS statements,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS covered FROM lineitem GROUP BY 1, 2)
"""
