"""Publications: facts that were extracted elsewhere, checked before they are taken in, as a whole or package by package.

A publication is a folder with a manifest and one folder of JSON lines for each frame.  The
manifest is one JSON object: `version`, the number of rows of each frame under `counts`,
and for a delta the `packages` that it replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .facts import SCHEMAS, Facts, from_frames

VERSIONS = range(1, 13)
#: Frames that a publication may hold.
FRAMES = ("kinds", "symbols", "occurrences", "relationships", "embeds", "implements", "extents", "metrics", "measures", "declared_measures", "files", "declared_in", "effects", "edges")
# The roles of an occurrence, and the visibilities of a symbol.
ROLES = ("definition", "reference", "call", "read", "write", "import")
VISIBILITIES = ("public", "private")
MANIFEST = "version int, counts map<string,long>, packages array<string>"


def problems(facts: Facts) -> DataFrame:
    """(frame, key, problem) of rows that facts can't have; none of good ones."""
    s, o, r = facts.symbols, facts.occurrences, facts.relationships
    kinds = sorted(facts.categories())

    def row(frame: str, df: DataFrame, key: str, problem: str) -> DataFrame:
        return df.select(F.lit(frame).alias("frame"), F.col(key).cast("string").alias("key"), F.lit(problem).alias("problem"))

    site = o.withColumn("site", F.concat_ws(":", "path", "line"))
    owner = s.where("owner_id IS NOT NULL").join(s.select(F.col("id").alias("owner_id")), "owner_id", "left_anti")
    found = [
        row("symbols", s.where("id IS NOT NULL").groupBy("id").count().where("count > 1"), "id", "repeated id"),
        row("symbols", s.where("id IS NULL OR coalesce(name, '') = '' OR package IS NULL OR module IS NULL"), "id", "a part of its identity is missing"),
        row("symbols", s.where(~F.coalesce(F.col("kind").isin(kinds), F.lit(False))), "id", "unknown kind"),
        row("symbols", s.where(~F.coalesce(F.col("visibility").isin(*VISIBILITIES), F.lit(False))), "id", "unknown visibility"),
        row("symbols", owner, "id", "unknown owner"),
        row("occurrences", site.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))), "site", "unknown role"),
        row("occurrences", site.where("path IS NULL OR coalesce(line, 0) < 1 OR start > stop"), "site", "no place in a file"),
        row("relationships", r.where("source_id IS NULL OR targets IS NULL OR coalesce(kind, '') = ''"), "source_id", "a part is missing"),
    ]
    return reduce(DataFrame.union, found)


def read(spark: SparkSession, path: str) -> tuple[Facts, list[str]]:
    """(facts, packages): a publication's frames, and the packages of a delta; a fault is an error that names the first of its kind."""
    manifest = spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("multiLine", True).json(f"{path}/manifest.json").first()
    if manifest is None or manifest["version"] not in VERSIONS:
        raise ValueError(f"a publication has a version from {VERSIONS.start} to {VERSIONS.stop - 1}")
    frames: dict[str, DataFrame] = {}
    for name, rows in (manifest["counts"] or {}).items():
        if name not in FRAMES:
            raise ValueError(f"a publication has no frame {name}")
        schema = T._parse_datatype_string(SCHEMAS[name])
        if rows:
            unknown = sorted(set(spark.read.json(f"{path}/{name}").columns) - set(schema.names))
            if unknown:
                raise ValueError(f"{name} has unknown fields: {', '.join(unknown)}")
            frames[name] = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
        if (got := frames[name].count() if rows else 0) != rows:
            raise ValueError(f"{name} has {got} rows, and its manifest says {rows}")
    facts = from_frames(spark, **frames)
    if bad := problems(facts).first():
        raise ValueError(f"{bad['frame']} {bad['key']}: {bad['problem']}")
    return facts, list(manifest["packages"] or [])


def with_delta(base: Facts, delta: Facts, packages: list[str]) -> Facts:
    """The base with what these packages hold replaced by the delta; rows of other packages in it are an error."""
    if not packages:
        raise ValueError("a delta names its packages")
    inside = F.col("package").isin(packages)
    for name in ("symbols", "occurrences", "files"):
        if stray := getattr(delta, name).where(~F.coalesce(inside, F.lit(False))).first():
            raise ValueError(f"the delta has {name} of package {stray['package']}, which it doesn't name")
    out = {name: getattr(base, name).where(~F.coalesce(inside, F.lit(False))).unionByName(getattr(delta, name)) for name in ("symbols", "occurrences", "files")}
    gone = base.symbols.where(inside).select("id")
    for name, key in (("relationships", "source_id"), ("embeds", "id"), ("implements", "type_id"), ("extents", "symbol_id"), ("metrics", "symbol_id"), ("measures", "symbol_id"), ("effects", "symbol_id"), ("edges", "source")):
        out[name] = getattr(base, name).join(gone.withColumnRenamed("id", key), key, "left_anti").select(*getattr(base, name).columns).unionByName(getattr(delta, name))
    return base.replaced(**out)
