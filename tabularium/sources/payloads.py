"""Payloads: a row for each table of a report, checked on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.text import collapse

TABLE_TYPES = ("balance_sheet", "income_statement", "cash_flow", "note_table")
FIRST_YEAR, LAST_YEAR = 2015, 2025


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads: source as ticker, language as report type, year and table type by id."""
    kind = F.element_at(F.array(*map(F.lit, TABLE_TYPES)), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("table_id"),
        F.col("source").alias("ticker"),
        F.col("lang").alias("report_type"),
        (2015 + F.col("doc_id") % 11).cast("int").alias("year"),
        kind.alias("table_type"),
        (F.col("doc_id") + 1).alias("start_line"),
        F.col("text").alias("index_text"),
    )


def checked(rows: DataFrame) -> DataFrame:
    """rows with upper-case tickers, collapsed text and the first reason to reject them, if there is one."""
    text = collapse(F.col("index_text"))
    reason = (
        F.when(~F.coalesce(F.col("table_id").cast("string").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "table_id")
        .when(F.coalesce(F.trim("ticker"), F.lit("")) == "", "ticker")
        .when(~F.coalesce(F.col("year").between(FIRST_YEAR, LAST_YEAR), F.lit(False)), "year")
        .when(~F.coalesce(F.col("start_line") >= 1, F.lit(False)), "start_line")
        .when(~F.coalesce(F.col("table_type").isin(*TABLE_TYPES), F.lit(False)), "table_type")
        .when(F.coalesce(F.char_length(text), F.lit(0)) < 40, "index_text")
    )
    return rows.select("*", F.upper("ticker").alias("ticker_code"), text.alias("clean_text"), reason.alias("reject_reason"))


def of_tables(rows: DataFrame, tables: DataFrame | None, key: str = "table_id") -> DataFrame:
    """rows of these tables alone (table_id), taken before anything is made of their texts; all without them."""
    return rows if tables is None else rows.join(tables.select(F.col("table_id").alias(key)).distinct(), key, "left_semi")


def lines(spark: SparkSession, sf_dir: str, tables: DataFrame | None = None) -> DataFrame:
    """Rows of tables: the lines of each document (of each of these tables) with words, numbered from 0 by all its lines."""
    docs = of_tables(read(spark, sf_dir, "documents").select("doc_id", "text"), tables, "doc_id")
    rows = docs.select(F.col("doc_id").alias("table_id"), F.posexplode(F.split("text", "\n", -1)).alias("row_position", "label"))
    return rows.where(F.trim("label") != "")
