"""Property schemas as Spark types, and how schemas and measures may evolve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_DEPTH = 32
SIMPLE = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def _flat(schema: dict, root: dict, depth: int) -> dict:
    """The schema with references followed and all parts of `allOf` merged."""
    if depth > MOST_DEPTH:
        raise ValueError(f"a property schema deeper than {MOST_DEPTH}")
    if "$ref" in schema:
        at = root
        for step in filter(None, schema["$ref"].removeprefix("#").split("/")):
            at = at[step.replace("~1", "/").replace("~0", "~")]
        return _flat(at, root, depth + 1)
    out = {k: v for k, v in schema.items() if k != "allOf"}
    for part in schema.get("allOf", []):
        more = _flat(part, root, depth + 1)
        out = {**more, **out, "properties": {**more.get("properties", {}), **out.get("properties", {})}}
    return out


def spark_type(schema: dict, root: dict | None = None, depth: int = 0) -> T.DataType | None:
    """The type of a schema; null is left out of its types, and None says that the rest is mixed."""
    root = schema if root is None else root
    s = _flat(schema, root, depth)
    named = s.get("type", "object" if s.get("properties") else [])
    kinds = [k for k in ([named] if isinstance(named, str) else named) if k != "null"]
    if len(kinds) != 1:
        return None
    if kinds[0] == "object":
        inner = {k: spark_type(v, root, depth + 1) for k, v in sorted(s.get("properties", {}).items())}
        return T.StructType([T.StructField(k, t) for k, t in inner.items() if t is not None])
    if kinds[0] == "array":
        item = spark_type(s.get("items", {}), root, depth + 1)
        return T.ArrayType(item) if item is not None else None
    return SIMPLE.get(kinds[0])


def leaves(kind: T.DataType, at: str = "") -> list[str]:
    """Dotted names of the scalar and array fields of a type."""
    if not isinstance(kind, T.StructType):
        return [at]
    return [x for f in kind.fields for x in leaves(f.dataType, f"{at}.{f.name}".lstrip("."))]


def properties(text: Column, schema: dict) -> list[Column]:
    """Columns of the leaves of JSON text under a schema; ill-typed text is an error."""
    kind = spark_type(schema)
    if not isinstance(kind, T.StructType):
        raise ValueError("a property schema must describe an object")
    parsed = F.from_json(text, kind, {"mode": "FAILFAST"})
    return [parsed.getField(n).alias(n) if "." not in n else _deep(parsed, n).alias(n) for n in leaves(kind)]


def _deep(parsed: Column, name: str) -> Column:
    for step in name.split("."):
        parsed = parsed.getField(step)
    return parsed


def additive(before: dict[str, str], after: dict[str, str]) -> None:
    """Measures (name to kind) may be added; taking one away or changing its kind is an error."""
    wrong = sorted(n for n, k in before.items() if after.get(n) != k)
    if wrong:
        raise ValueError(f"measures changed or taken away: {', '.join(wrong)}")


# Fields of a packed handle from the highest bits down, with their widths.
HANDLE = {"module": 11, "package": 16, "visibility": 1, "kind": 6, "local": 29}


def pack_handle(**part: Column) -> Column:
    """One long of the five parts; a part that does not fit its bits is an error."""
    out = F.lit(0).cast("long")
    for name, width in HANDLE.items():
        value = part[name].cast("long")
        fits = F.when((value >= 0) & (value < (1 << width)), value).otherwise(F.raise_error(F.lit(f"{name} takes more than {width} bits")).cast("long"))
        out = F.shiftleft(out, width).bitwiseOR(fits)
    return out


def unpack_handle(handle: Column) -> dict[str, Column]:
    out, shift = {}, sum(HANDLE.values())
    for name, width in HANDLE.items():
        shift -= width
        out[name] = F.shiftright(handle, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias(name)
    return out


def handle_range(**part: int) -> tuple[int, int]:
    """The least and the largest handle with the given leading parts."""
    low, high, given = 0, 0, True
    for name, width in HANDLE.items():
        given = given and name in part
        low = low << width | (part[name] if given else 0)
        high = high << width | (part[name] if given else (1 << width) - 1)
    return low, high
