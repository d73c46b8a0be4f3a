"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the `top` most frequent 1- to 3-grams, most frequent first.
A document's distance to a language is the sum, over its own profile, of how far out of
place each n-gram stands in the language's profile; an absent n-gram counts `top`.

Fitting takes about `fit_rows` labelled rows of each language, chosen by a hash of the
row; prediction reads every row and the whole text.

Defined results: a null text, an empty one and one without letters give `und` with score
0; so does every row if no labelled row exists.  Ties between languages go to the
smaller name.  Null labels are not learned from.  Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import plain, slices

TOP = 300
FIT_ROWS = 3000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams packed 21 bits a code point, counts); words are padded by one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[c]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate(([0], np.where(letter, c, 0), [0])).astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate((c[c != 0], two, three)), return_counts=True)


def ranked(g: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams first; equal counts by code."""
    return g[np.lexsort((g, -n))[:top]]


class Profiles:
    """Languages, the sorted n-grams of all profiles, and each one's rank by language."""

    def __init__(self, ranks: dict[str, list[int]], top: int) -> None:
        self.top = top
        self.languages = sorted(ranks)
        self.known = np.array(sorted({g for r in ranks.values() for g in r}), np.int64)
        self.rank = np.full((len(self.known) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.rank[np.searchsorted(self.known, np.array(ranks[name], np.int64)), k] = np.arange(len(ranks[name]))

    def predict(self, text: str) -> tuple[str, float]:
        g = ranked(*grams(text), self.top)
        if not len(g) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, g)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == g[found]
        rank = self.rank[np.where(found, at, len(self.known))]
        away = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(g))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.top * len(g)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, fit_rows: int = FIT_ROWS) -> Profiles:
    """Profiles from about `fit_rows` texts of each language with a label, `fit_rows` at most if all differ and fewer if they repeat.

    The choice of texts, a bounded sample as a classifier may take, is by their hash and so
    the same in every run; a repeated text counts once; n-gram counts are summed over the cluster.  What comes to the
    driver is `top` rows a language.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << 60)).alias("draw"))
    size = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not size:
        return Profiles({}, top)
    # the draw goes by the text alone; the least one is always in, so that no language is without a row
    share = F.create_map(*(F.lit(x) for r in size for x in (r["lang"], max(r["least"] + 1, int(min(1.0, fit_rows / r["n"]) * (1 << 60))))))
    rows = rows.where(F.col("draw") < share[F.col("lang")]).groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for name, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(name, {})
                for g, n in zip(*(x.tolist() for x in grams(text_ or "")), strict=True):
                    own[g] = own.get(g, 0) + n
        for name, own in sums.items():
            yield pa.record_batch([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    total = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, top).alias("best"))
    return Profiles({r["lang"]: [x["gram"] for x in r["best"]] for r in best.collect()}, top)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of `df`, with the predicted language and a score from 0 to 1.

    A column of `df` that has one of the two output names is replaced.  The profiles go
    to the tasks with the code; they are `top` n-grams a language.
    """
    df = df.drop(pred, score)
    schema = T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    at = df.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column(at))
            for first, part in slices(texts, 4 << 20):
                got = [profiles.predict(x) for x in part.to_pylist()]
                own = b.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*own.schema.names, pred, score])

    return df.mapInArrow(work, schema)


def fold(doc_id: Column | str, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit(docs.where(fold("doc_id") != 0))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """Rows whose text has letters and stands near some profile; the columns are kept."""
    profiles = fit(docs)
    names = ("__lang_pred", "__lang_score")
    return predict(docs, profiles, pred=names[0], score=names[1]).where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)
