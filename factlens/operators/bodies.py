"""Relationships that statements of lowered bodies make, and the conditions that guard them.

Statements are rows (body, id, parent, kind, target, text, line): parent is the statement
around one, text is a condition's own.  Nesting is bounded by MOST_NESTING, beyond which a
body is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import Rounds

MOST_NESTING = 64
# What a kind of statement relates its body to.
RELATES = {"call": "call", "assign": "write", "read": "read", "reference": "reference", "import": "import", "dispatch": "dispatch"}
CONDITIONS = ("if", "while", "case", "for")


def relationships(statements: DataFrame) -> DataFrame:
    """(source, target, type, n, line): one row for each body, target and type, with the number of statements and their first line."""
    kind = F.lit(None).cast("string")
    for k, t in RELATES.items():
        kind = F.when(F.col("kind") == k, t).otherwise(kind)
    rows = statements.where("target IS NOT NULL").withColumn("type", kind).where("type IS NOT NULL")
    return rows.groupBy(F.col("body").alias("source"), "target", "type").agg(F.count("*").alias("n"), F.min("line").alias("line"))


def guards(statements: DataFrame) -> DataFrame:
    """(body, id, guards): the conditions around each statement, the outermost first; a statement deeper than the bound, or around itself, is an error."""
    cut = Rounds(statements.sparkSession).cut
    s = cut(statements.select("body", "id", "parent", "kind", "text"))
    up = s.select("body", F.col("id").alias("at"), F.col("parent").alias("next"), F.when(F.col("kind").isin(*CONDITIONS), F.col("text")).alias("cond"))
    now = s.select("body", "id", F.col("parent").alias("at"), F.array().cast("array<string>").alias("guards"))
    for _ in range(MOST_NESTING):
        now = cut(now.join(up, ["body", "at"], "left").select("body", "id", F.col("next").alias("at"), F.when(F.col("cond").isNotNull(), F.concat(F.array("cond"), F.col("guards"))).otherwise(F.col("guards")).alias("guards")))
        if not now.where("at IS NOT NULL").limit(1).count():
            return now.select("body", "id", "guards")
    raise ValueError(f"statements are nested more than {MOST_NESTING} deep")
