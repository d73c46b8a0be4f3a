"""Line dedup by a sharded minimal perfect hash.

Each distinct line key of at least `least` code points is a 128-bit identity.  Shards by
its first half hold a minimal perfect hash of their identities, and arrays that its
slots index: a 32-bit fingerprint, the number of documents (to 255) and the smallest
doc_id.  Documents probe with packed identities, one row for each task batch and shard,
and learn which of their keys go; lines are never joined with lines.

The hash has levels: a key takes a bit of the level that no other key took, and else
tries the next one; its slot is the number of bits set before it.

Defined results: null or empty text is one empty line; a key found in one document only,
or shorter than `least`, keeps its lines; the smallest doc_id that holds a key keeps all
its lines, and rows of one doc_id count as one document.  A null doc_id counts as the
largest.  Other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .text import mix, plain, slices

LEAST = 10
SHARD_KEYS = 200_000
NO_ID = (1 << 63) - 1
SPACE = " \t\n\x0b\x0c\r"


def _level(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a * np.uint64(2 * level + 3) + mix(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit identities: bit levels and their ranks."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes = sizes
        self.taken = np.unpackbits(bits, count=sum(sizes)).astype(bool) if sizes else np.zeros(0, bool)
        self.before = np.concatenate(([0], np.cumsum(self.taken)))

    @staticmethod
    def build(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray]:
        sizes, taken, level = [], [], 0
        while len(a):
            size = max(8, int(len(a) * 1.5))
            at = _level(a, b, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            taken.append(alone)
            a, b = a[~alone[at]], b[~alone[at]]
            level += 1
        return sizes, np.packbits(np.concatenate(taken)) if taken else np.zeros(0, np.uint8)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each identity; -1 where no level has its bit."""
        out, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + _level(a[open_], b[open_], level, size)
            hit = self.taken[at]
            out[open_[hit]] = self.before[at[hit]]
            open_, base = open_[~hit], base + size
        return out


def _identities(text: str, least: int) -> list[tuple[int, bytes | None]]:
    out = []
    for line in text.split("\n"):
        k = line.strip(SPACE)
        # lower() of bytes is that of A-Z alone
        out.append(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass").lower()) if len(k) >= least else None)
    return out


def _batch_keys(ids: list, texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc_id, identity) of a batch: doc ids and both halves."""
    docs, keys = [], []
    for i, t in zip(ids, texts, strict=True):
        own = {k for k in _identities(t, least) if k is not None}
        docs += [NO_ID if i is None else i] * len(own)
        keys += own
    halves = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2) if keys else np.zeros((0, 2), np.uint64)
    return np.array(docs, np.int64), halves[:, 0], halves[:, 1]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for b in batches:
        for first, part in slices(plain(b.column(1)), 4 << 20):
            yield b.column(0).slice(first, len(part)).to_pylist(), part.to_pylist()


def line_index(rows: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """A row for each shard: levels, bits, and the arrays of fingerprints, counts and smallest ids.

    rows: (doc_id, text).  Keys are combined in each batch and again before the shuffle,
    so that a line found everywhere costs a row a task.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _each(batches):
            d, a, b = _batch_keys(ids, texts, least)
            order = np.lexsort((d, b, a))
            d, a, b = d[order], a[order], b[order]
            if not len(d):
                continue
            first = np.ones(len(d), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(first)
            end = np.append(at[1:], len(d))
            yield pa.record_batch([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array(d[at]), pa.array(d[end - 1]), pa.array(end - at)], ["a", "b", "least_id", "most_id", "n"])

    found = rows.mapInArrow(keys, "a long, b long, least_id long, most_id long, n long").groupBy("a", "b").agg(F.min("least_id").alias("least_id"), F.max("most_id").alias("most_id"), F.sum("n").alias("n"))
    # n can count a document twice when its rows meet in different batches; one document is told by its ids
    found = found.withColumn("n", F.when(F.col("least_id") == F.col("most_id"), 1).otherwise(F.least(F.greatest(F.col("n"), F.lit(2)), F.lit(255))))

    def build(table: pa.Table) -> pa.Table:
        a, b, least_ids = (table.column(c).to_numpy() for c in ("a", "b", "least_id"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        sizes, bits = PerfectHash.build(a, b)
        slot = PerfectHash(sizes, bits).slots(a, b)
        fp, count, least_id = np.zeros(len(a), np.uint32), np.zeros(len(a), np.uint8), np.zeros(len(a), np.int64)
        fp[slot], count[slot], least_id[slot] = (b & np.uint64(0xFFFFFFFF)).astype(np.uint32), table.column("n").to_numpy().astype(np.uint8), least_ids
        cols = [pa.array([x.tobytes()], pa.binary()) for x in (bits, fp, count, least_id)]
        return pa.table([table.column("shard").slice(0, 1), pa.array([sizes], pa.list_(pa.int64())), *cols], ["shard", "sizes", "bits", "fp", "count", "least_id"])

    return found.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, sizes array<long>, bits binary, fp binary, count binary, least_id binary")


def dropped_keys(rows: DataFrame, index: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """(doc_id, gone): first halves of the identities whose lines the document loses."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _each(batches):
            d, a, b = _batch_keys(ids, texts, least)
            shard = (a.view(np.int64) % shards).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            d, a, b, shard = d[order], a[order], b[order], shard[order]
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
            cut = list(zip(at, np.append(at[1:], len(shard)), strict=True)) if len(at) else []
            yield pa.record_batch([pa.array(shard[at]), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (d, a, b))], ["shard", "doc", "a", "b"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, gone_keys = [], []
        if left.num_rows and right.num_rows:
            one = {c: left.column(c)[0].as_py() for c in left.column_names}
            table = PerfectHash(one["sizes"], np.frombuffer(one["bits"], np.uint8))
            fp, count, least_id = (np.frombuffer(one[c], t) for c, t in (("fp", np.uint32), ("count", np.uint8), ("least_id", np.int64)))
            for packed in zip(*(right.column(c) for c in ("doc", "a", "b")), strict=True):
                d, a, b = (np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.int64, np.uint64, np.uint64), strict=True))
                slot = table.slots(a, b)
                if (slot < 0).any() or (fp[slot] != (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)).any():
                    raise RuntimeError("a probed line key is not in the index it was built from")
                gone = (count[slot] >= 2) & (least_id[slot] != d)
                d, a = d[gone], a[gone].view(np.int64)
                order = np.argsort(d, kind="stable")
                d, a = d[order], a[order]
                at = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
                ids += d[at].tolist()
                gone_keys += np.split(a, at[1:]) if len(at) else []
        return pa.table([pa.array(ids, pa.int64()), pa.array(gone_keys, pa.list_(pa.int64()))], ["doc_id", "gone"])

    asked = rows.mapInArrow(probes, "shard long, doc binary, a binary, b binary")
    hits = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(probe, "doc_id long, gone array<long>")
    return hits.groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(docs: DataFrame, least: int = LEAST, shard_keys: int = SHARD_KEYS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """`docs` with text rejoined from the lines that stay, and the numbers of all lines and of dropped ones in two columns, which replace any of their names."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    shards = max(1, -(-lines // shard_keys))
    index = scratch.write(line_index(rows, shards, least), "index")
    gone = scratch.write(dropped_keys(rows, index, shards, least), "gone")
    scratch.release()
    docs = docs.drop(*counts)
    text = docs.columns.index("text")
    joined = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(gone.withColumnsRenamed({"doc_id": "__id", "gone": "__gone"}), "__id", "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__gone")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [*b.columns[:-1]]
            kept, n, drop = [], [], []
            for t, g in zip(plain(b.column(text)).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                lines_ = t.split("\n")
                n.append(len(lines_))
                if g:
                    g = set(g)
                    lines_ = [x for x, k in zip(lines_, _identities(t, least), strict=True) if k is None or int.from_bytes(k[:8], "big", signed=True) not in g]
                kept.append("\n".join(lines_))
                drop.append(n[-1] - len(lines_))
            own[text] = pa.array(kept, b.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(drop, pa.int64())], [*b.schema.names[:-1], *counts])

    return joined.mapInArrow(apply, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS least_id FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE least_id IS NOT NULL AND least_id <> doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE least_id IS NULL OR least_id = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (k) GROUP BY doc_id
"""
