"""Content hashes, and what must change in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import collapse


def hashed(rows: DataFrame) -> DataFrame:
    """rows with the SHA-256 of what the index holds of them."""
    return rows.withColumn("content", F.sha2(F.concat_ws("|", "ticker", "report_type", F.col("year").cast("string"), collapse(F.col("index_text"))), 256))


def reconciled(before: DataFrame, now: DataFrame) -> DataFrame:
    """(table_id, action) for rows to insert, update or delete; equal content is left alone."""
    both = before.select("table_id", F.col("content").alias("old")).join(now.select("table_id", F.col("content").alias("new")), "table_id", "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return both.select("table_id", action.alias("action")).where("action is not null")
