"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change is a signed row: an insert adds a document and its tokens, a delete takes both
away, a revised count adds the difference.  A batch of changes is committed as its sums,
a small table in a folder of its own; committing a name again writes a newer folder, which
takes the place of the older one once it is complete.  So a batch that is retried after a
failure counts once, and a failure at any time leaves what was committed.  `compact` puts
all batches into one table that still tells them apart, so that totals stay one scan.

Defined results: null and empty texts have no tokens; a null source or language is a group
of its own; groups whose documents are all gone leave the totals; repeated rows count
each.  No changes commit an empty batch.  Columns beside the named ones are not read, and a
column that has the name of the count is replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .text import plain, slices

GROUP = ("source", "lang", "tokenizer_version")
SUMS = "source string, lang string, tokenizer_version string, docs long, tokens long"

#: The vocabulary that the query counts by, a file of a public tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The patterns whose matches the two built-in tokenizers count.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def pattern_tokens(version: str, text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


#: Where white space follows a word or a sign no tokenizer of /opt/tokenizers joins what stands before and after.
_CUT = re.compile(r"(?<=[\w!-~])(?=[ \n\t\r])")
#: Pieces whose counts a task remembers; it forgets all when there are more.
MOST_KNOWN = 1 << 20


def bpe_tokens(df: DataFrame, path: str, out: str = "tokens", cut: bool = True) -> DataFrame:
    """`df` with the number of tokens of its column `text` by the vocabulary file at `path`.

    The path must be readable where tasks run; a task loads the file once.  With `cut`
    texts are counted in pieces that start at white space, each distinct piece once.
    """
    df = df.drop(out)
    at = df.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        # a task has one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        known: dict[str, int] = {}
        for b in batches:
            for first, part in slices(plain(b.column(at))):
                texts = [_CUT.split(t) if cut else [t] for t in part.to_pylist()]
                new = list(set().union(*texts) - known.keys())
                known.update(zip(new, (len(x.ids) for x in model.encode_batch(new, add_special_tokens=False)), strict=True))
                n = [sum(map(known.__getitem__, t)) for t in texts]
                if len(known) > MOST_KNOWN:
                    known.clear()
                yield pa.RecordBatch.from_arrays([*b.slice(first, len(part)).columns, pa.array(n, pa.int64())], [*b.schema.names, out])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def inserted(counted: DataFrame) -> DataFrame:
    """Changes that add documents with their counts (source, lang, tokenizer_version, tokens)."""
    return counted.select(*GROUP, F.lit(1).alias("docs"), "tokens")


def deleted(counted: DataFrame) -> DataFrame:
    return counted.select(*GROUP, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(counted: DataFrame, old: str = "old_tokens") -> DataFrame:
    return counted.select(*GROUP, F.lit(0).alias("docs"), (F.col("tokens") - F.col(old)).alias("tokens"))


class Rollup:
    """Totals in a folder that the cluster shares; `commit` is idempotent by batch name.

    Folders are numbered in the order of their writing: `b-<number>-<name>` holds a batch,
    and `c-<number>` all that stood before it.  Only folders that are complete count.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def _folders(self) -> list[tuple[int, str, str, bool]]:
        """(number, batch or the empty text, folder, complete) of all folders."""
        fs, root, path = self._fs()
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()]
        found = [(m, n) for n in names if (m := re.fullmatch(r"(?:b-(\d+)-(.+)|c-(\d+))", n))]
        return sorted((int(m[1] or m[3]), m[2] or "", n, fs.exists(path(f"{self.path}/{n}/_SUCCESS"))) for m, n in found)

    def _current(self) -> tuple[str | None, dict[str, str]]:
        """The newest compacted folder, and by batch the newest folder written after it."""
        done = [x for x in self._folders() if x[3]]
        base = max((x for x in done if not x[1]), default=None)
        return base and base[2], {batch: name for number, batch, name, _ in done if batch and (base is None or number > base[0])}

    def _rows(self) -> DataFrame:
        """(batch, ...) sums of all batches."""
        base, newer = self._current()
        read = self.spark.read.schema(f"batch string, {SUMS}")
        rows = read.parquet(*(f"{self.path}/{n}" for n in newer.values())) if newer else self.spark.createDataFrame([], f"batch string, {SUMS}")
        if base is None:
            return rows
        old = read.parquet(f"{self.path}/{base}")
        return rows.union(old.where(~F.col("batch").isin(list(newer))) if newer else old)

    def _drop(self, names: list[str]) -> None:
        fs, _, path = self._fs()
        for n in names:
            fs.delete(path(f"{self.path}/{n}"), True)

    def batches(self) -> list[str]:
        """Names of the batches whose commit was completed and that have rows or a folder of their own."""
        base, newer = self._current()
        old = [] if base is None else [r[0] for r in self.spark.read.schema(f"batch string, {SUMS}").parquet(f"{self.path}/{base}").select("batch").distinct().collect()]
        return sorted({*old, *newer})

    def commit(self, batch: str, changes: DataFrame) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.=+-]+", batch):
            raise ValueError("a batch name has letters, digits and _ . = + -")
        number = max((x[0] for x in self._folders()), default=0) + 1
        sums = changes.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        sums.select(F.lit(batch).alias("batch"), *GROUP, "docs", "tokens").write.parquet(f"{self.path}/b-{number:012}-{batch}")
        self._drop([n for k, b, n, _ in self._folders() if b == batch and k < number])

    def compact(self) -> None:
        """One table of all batches in place of their folders; a failure leaves these as they are."""
        known = self._folders()
        number = max((x[0] for x in known), default=0) + 1
        self._rows().coalesce(1 + len(known) // 1000).write.parquet(f"{self.path}/c-{number:012}")
        self._drop([x[2] for x in known])

    def totals(self) -> DataFrame:
        whole = self._rows().groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return whole.where("docs != 0 or tokens != 0")


def rollup(spark, sf_dir: str, versions: tuple[str, ...] = tuple(PATTERNS), vocabulary: str | None = None) -> DataFrame:
    """Every document is inserted; those of one fold are then deleted, those of another get one token more.

    The last batch is committed twice, as a retried job would, and once more after the
    batches were compacted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text", F.coalesce(F.pmod("doc_id", F.lit(10)), F.lit(0)).alias("day"))
    scratch = Scratch(spark, "token-counts")
    totals = Rollup(spark, f"{scratch.root}/rollup")
    counts = [(v, pattern_tokens(v)) for v in versions]
    if vocabulary:
        docs = bpe_tokens(docs, vocabulary, "__bpe")
        counts.append((os.path.basename(vocabulary).split(".")[0], F.col("__bpe")))
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("tokenizer_version"), n.alias("tokens")) for v, n in counts))).alias("x")
    counted = scratch.write(docs.select("source", "lang", "day", pairs).select("source", "lang", "day", "x.*"), "counted")
    more: Callable[[DataFrame], DataFrame] = lambda d: d.withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.col("tokens") + 1)
    totals.commit("0-insert", inserted(counted))
    changes = deleted(counted.where("day = 3")).union(revised(more(counted.where("day = 7"))))
    for _ in range(2):
        totals.commit("1-change", changes)
    totals.compact()
    totals.commit("1-change", changes)
    return totals.totals().select(*GROUP, "docs", "tokens")


def op2(spark, sf_dir: str) -> DataFrame:
    """The rollup of tokens of a public vocabulary, and of the two built-in patterns."""
    return rollup(spark, sf_dir, vocabulary=VOCABULARY)


#: The rollup of the two patterns; the tokens of a vocabulary have no SQL form.
ROLLUP_SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(doc_id % 10, 0) AS day,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS pieces
  FROM documents),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, day, words AS tokens FROM d
  UNION ALL SELECT source, lang, 'pieces-1', day, pieces FROM d)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS docs,
       CAST(sum(tokens + CASE WHEN day = 7 THEN 1 ELSE 0 END) AS BIGINT) AS tokens
FROM c WHERE day <> 3 GROUP BY source, lang, tokenizer_version
"""
