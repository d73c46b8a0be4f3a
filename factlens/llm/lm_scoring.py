"""LM scoring by deleted interpolation of word bigrams.

    p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)

b is the bucket of the context's count c(v), a power of two.  The mixture weights of each
bucket are learned by expectation-maximisation on a deleted tenth of the training rows:
their tokens are predicted from the counts of the other nine.  Scores then use all
training counts.  A text is its words and one end; its first word follows a start.

Rows are hashed into batches of bounded size, and n-grams into shards.  A batch asks each
shard once for its distinct n-grams and brings its own training counts with the question;
the shard adds up all batches' counts and answers each of them in its order.  So counts
cover the whole corpus, no table of n-grams is sent to all tasks or the driver, and an
n-gram that occurs everywhere costs one entry a batch.  Questions are sorted 64-bit
identities, packed as differences.  A batch writes to a shard only if it has n-grams of
it, so there are never more messages than distinct n-grams of batches, a number in
proportion to the corpus; as it grows, messages get shorter, and no shard or batch larger.

Defined results: a null or empty text is one end; with no training rows N = V = 0 and
every score is 0.  A row with a null id is in the fold of the empty text.  Repeated rows
count and are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import fold
from .scratch import Scratch
from .text import mix, plain, segment_sum, slices, words

BATCH_BYTES = 16 << 20
SHARD_KEYS = 1_500_000
#: Batches whose number is 0 modulo this are the deleted part.
DELETE = 10
BUCKETS = 24
ROUNDS = 25
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_K = np.uint64(0x9E3779B97F4A7C15)


def pack(x: np.ndarray) -> bytes:
    """Integers, byte planes apart, compressed; a few are left as they are."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return b"\0" + planes if len(planes) < 128 else b"\1" + zstandard.compress(planes, 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(b[1:]) if b[0] else b[1:], np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


class Tokens:
    """Tokens of a batch: identities, contexts and offsets, and the distinct n-grams they ask for."""

    def __init__(self, texts: pa.Array) -> None:
        parts, counts = [], []
        for _, part in slices(texts):
            h, off = words(part)
            n = np.diff(off)
            # one end after the words of each text
            parts.append(np.insert(h, off[1:], _END))
            counts.append(n + 1)
        self.token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.off = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64) if counts else np.zeros(1, np.int64)
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[self.off[:-1]] = _START
        self.words, self.word = np.unique(self.token, return_inverse=True)
        self.pairs, self.pair = np.unique(mix(context * _K + self.token), return_inverse=True)
        # a context's count is its count as a token; the start's is that of the end
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.off[:-1]] = np.searchsorted(self.words, _END)
        self.before = before


def _shard_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    inner = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


def _batches(docs: DataFrame, n: int) -> DataFrame:
    return docs.select("doc_id", "text", (fold("doc_id") != 1).alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"))


def _ask(rows: DataFrame, bits: int) -> DataFrame:
    """(kind, shard, batch, keys, counts): distinct n-grams of each batch with its training counts; kind 0 words, 1 pairs."""

    def ask(table: pa.Table) -> pa.Table:
        t = Tokens(plain(table.column("text")))
        own = np.repeat(plain_bool(table.column("train")), np.diff(t.off))
        batch = table.column("batch")[0].as_py()
        out: dict[str, list] = {"kind": [], "shard": [], "batch": [], "keys": [], "counts": []}
        for kind, keys, at in ((0, t.words, t.word), (1, t.pairs, t.pair)):
            counts = np.bincount(at[own], minlength=len(keys)).astype(np.uint32)
            edge = _shard_edges(keys, bits)
            for s in range(1 << bits):
                i, j = edge[s], edge[s + 1]
                if i < j:
                    for name, x in zip(out, (kind, s, batch, pack_sorted(keys[i:j]), pack(counts[i:j])), strict=True):
                        out[name].append(x)
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "shard": pa.array(out["shard"], pa.int32()), "batch": pa.array(out["batch"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return rows.groupBy("batch").applyInArrow(ask, "kind int, shard int, batch int, keys binary, counts binary")


def plain_bool(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _answer(asked: DataFrame) -> DataFrame:
    """(kind, shard, batch, total, deleted) for each question, and a row with batch -1 that sums the shard's words."""

    def answer(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        batch = table.column("batch").to_pylist()
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
        known = np.unique(np.concatenate(keys))
        at = [np.searchsorted(known, k) for k in keys]
        total, deleted = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for b, i, c in zip(batch, at, counts, strict=True):
            total[i] += c
            if b % DELETE == 0:
                deleted[i] += c
        rest = total - deleted
        sums = [int((total > 0).sum()), int(total.sum()), int((rest > 0).sum()), int(rest.sum())]
        n = len(batch)
        return pa.table(
            {
                "kind": pa.array([kind] * (n + 1), pa.int32()),
                "shard": pa.array([shard] * (n + 1), pa.int32()),
                "batch": pa.array([*batch, -1], pa.int32()),
                "total": pa.array([*(pack(total[i]) for i in at), None], pa.binary()),
                "deleted": pa.array([*(pack(deleted[i]) if b % DELETE == 0 else None for b, i in zip(batch, at, strict=True)), None], pa.binary()),
                "sums": pa.array([*([None] * n), sums], pa.list_(pa.int64())),
            }
        )

    return asked.groupBy("kind", "shard").applyInArrow(answer, "kind int, shard int, batch int, total binary, deleted binary, sums array<long>")


def _counts(answers: pa.Table, field: str, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the batch's words and pairs, put together from the shards' answers in key order."""
    rows = sorted(zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column(field).to_pylist(), strict=True), key=lambda r: r[:2])
    by = [[unpack(x, np.int64) for k, _, x in rows if k == kind] for kind in (0, 1)]
    word, pair = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in by)
    if len(word) != len(t.words) or len(pair) != len(t.pairs):
        raise RuntimeError("the answers don't fit the batch's n-grams")
    return word, pair


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two below the count."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def learn(cases: DataFrame, n: int, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bucket, [l2, l1, l0]) from held-out cases (bucket, pair, context, word, times), by EM.

    Each round sums over the cluster; the driver gets three numbers a bucket.
    """
    weight = np.tile(np.array([0.5, 0.4, 0.1]), (BUCKETS, 1))
    weight[0] = [0.0, 0.8, 0.2]
    parts = [F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0), F.col("word") / F.lit(float(max(n, 1))), F.lit(1.0 / (v + 1))]
    for _ in range(rounds):
        mine = [F.array(*(F.lit(float(weight[b, k])) for b in range(BUCKETS)))[F.col("bucket")] * p for k, p in enumerate(parts)]
        whole = mine[0] + mine[1] + mine[2]
        got = cases.groupBy("bucket").agg(*(F.sum(F.col("times") * m / whole).alias(f"m{k}") for k, m in enumerate(mine))).collect()
        new = weight.copy()
        for r in got:
            x = np.maximum([r["m0"], r["m1"], r["m2"]], 1e-6 * (r["m0"] + r["m1"] + r["m2"]))
            new[r["bucket"]] = x / x.sum()
        new[0] = [0.0, *(new[0, 1:] / new[0, 1:].sum())]
        moved = np.abs(new - weight).max()
        weight = new
        if moved < 1e-3:
            break
    return weight


def score(docs: DataFrame, batch_bytes: int = BATCH_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = DELETE * max(1, -(-size // (batch_bytes * DELETE)))
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / 4 / shard_keys)))))
    rows = _batches(docs, n_batches)
    answers = scratch.write(_answer(_ask(rows, bits)), "answers")
    scratch.release()
    sums = answers.where("batch = -1 and kind = 0").agg(*(F.sum(F.col("sums")[k]) for k in range(4))).first()
    v, n, v_rest, n_rest = (int(x or 0) for x in sums)

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "pair", "context", "word", "times"]
        if not left.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        t = Tokens(plain(left.column("text")))
        own = np.repeat(plain_bool(left.column("train")), np.diff(t.off))
        (word, pair), (word_, pair_) = _counts(right, "total", t), _counts(right, "deleted", t)
        word, pair = word - word_, pair - pair_
        case = np.stack((pair[t.pair[own]], word[t.before[own]], word[t.word[own]]))
        order = np.lexsort(case)
        case = case[:, order]
        first = np.ones(case.shape[1], bool)
        first[1:] = (np.diff(case, axis=1) != 0).any(0)
        at = np.flatnonzero(first)
        case = case[:, at]
        return pa.table(dict(zip(names, map(pa.array, (bucket(case[1]), *case, np.diff(np.append(at, len(order))))), strict=True)))

    part = rows.where(F.col("batch") % DELETE == 0)
    cases = part.groupBy("batch").cogroup(answers.where((F.col("batch") >= 0) & (F.col("batch") % DELETE == 0)).groupBy("batch")).applyInArrow(held, "bucket long, pair long, context long, word long, times long")
    cases = scratch.write(cases, "cases")
    weight = learn(cases, n_rest, v_rest)
    scratch.release()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        t = Tokens(plain(left.column("text")))
        word, pair = _counts(right, "total", t)
        c, context = word[t.word], word[t.before]
        lam = weight[bucket(context)]
        p = lam[:, 0] * pair[t.pair] / np.maximum(context, 1) + lam[:, 1] * c / max(n, 1) + lam[:, 2] / (v + 1)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        logp = np.log10(p) if n else np.zeros(len(p))
        sums = [np.add.reduceat(x, t.off[:-1]) for x in (base, logp)]
        cols = [left.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(plain_bool(left.column("train"))), pa.array(np.diff(t.off)), pa.array(segment_sum((c > 0).astype(np.int64), t.off)), *map(pa.array, sums)]
        return pa.table(cols, names)

    out = rows.groupBy("batch").cogroup(answers.where("batch >= 0").groupBy("batch")).applyInArrow(work, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
