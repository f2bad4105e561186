"""Checks on what comes in, and upkeep of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.text import collapse
from tabularium.operators import upkeep
from tabularium.queries.search import PAYLOADS
from tabularium.sources.payloads import checked, payloads, read


def payload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(payloads(spark, sf_dir)).select("table_id", "ticker_code", F.md5("clean_text").alias("text_md5"), "reject_reason")


def question_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as they might be typed, in other case or with other white space, or changed, against a list that holds some twice."""
    key = lambda c: F.replace(F.lower(collapse(c)), F.lit("ß"), F.lit("ss"))
    items, k, text = read(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text")
    typed = F.when(k % 4 == 0, F.upper(text)).when(k % 4 == 1, F.concat(F.lit(" \t"), F.replace(text, F.lit(" "), F.lit("  ")), F.lit("\n"))).when(k % 4 == 2, F.concat(text, F.lit("x"))).otherwise(text)
    listed = items.select(key(text).alias("key")).unionAll(items.where(k % 10 == 0).select(key(text).alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = items.select("item_id", key(typed).alias("key")).join(listed, "key", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("item_id", n.cast("long").alias("n_found"), F.when(n == 1, "unique").when(n == 0, "none").otherwise("several").alias("status"))


def docid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker, year and report type from report names; without a last part the type is "other"."""
    names = payloads(spark, sf_dir).select("table_id", F.concat_ws("_", F.upper("ticker"), F.lit("financial_statements"), F.col("year").cast("string"), F.when(F.col("report_type") != "en", F.col("report_type"))).alias("doc"))
    part = lambda k: F.regexp_extract("doc", r"^([A-Za-z0-9]+)_financial_statements_(\d{4})(?:_([a-z]+))?$", k)
    return names.select("table_id", "doc", part(1).alias("ticker"), part(2).cast("int").alias("year"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("other")).alias("report_type"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.hashed(payloads(spark, sf_dir)).select("table_id", "content")


def index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of the documents before a change needs: every 7th was not there, every 11th had another text, every 13th is gone."""
    now = upkeep.hashed(payloads(spark, sf_dir)).select("table_id", "content")
    before = now.where("table_id % 7 <> 0").withColumn("content", F.when(F.col("table_id") % 11 == 0, F.sha2(F.concat("content", F.lit("?")), 256)).otherwise(F.col("content")))
    return upkeep.reconciled(before, now.where("table_id % 13 <> 0"))


QUERIES = {"payload_validate": payload_validate, "question_match": question_match, "docid_parse": docid_parse, "content_hash": content_hash, "index_reconcile": index_reconcile}

_CLEAN = r"trim(regexp_replace({}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_HASH = r"sha256(ticker || '|' || report_type || '|' || CAST(year AS VARCHAR) || '|' || trim(regexp_replace(index_text, '[ \t\n\r\f\x0b]+', ' ', 'g')))"
ORACLES = {
    "payload_validate": f"""SELECT table_id, upper(ticker) AS ticker_code, md5({_CLEAN.format('index_text')}) AS text_md5, CASE WHEN NOT regexp_full_match(CAST(table_id AS VARCHAR), '[A-Za-z0-9_-]+') THEN 'table_id'
 WHEN coalesce(trim(ticker), '') = '' THEN 'ticker' WHEN NOT year BETWEEN 2015 AND 2025 THEN 'year' WHEN start_line < 1 THEN 'start_line' WHEN length({_CLEAN.format('index_text')}) < 40 THEN 'index_text' END AS reject_reason FROM {PAYLOADS} p""",
    "question_match": f"""WITH l AS (SELECT replace(lower({_CLEAN.format('text')}), 'ß', 'ss') AS k, CASE WHEN item_id % 10 = 0 THEN 2 ELSE 1 END AS n FROM benchmark),
 q AS (SELECT item_id, replace(lower({_CLEAN.format('text')}), 'ß', 'ss') || CASE WHEN item_id % 4 = 2 THEN 'x' ELSE '' END AS k FROM benchmark)
 SELECT item_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_found, CASE coalesce(sum(n), 0) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'several' END AS status FROM q LEFT JOIN l USING (k) GROUP BY item_id""",
    "docid_parse": f"""SELECT table_id, upper(ticker) || '_financial_statements_' || year || CASE WHEN report_type <> 'en' THEN '_' || report_type ELSE '' END AS doc, upper(ticker) AS ticker, year, CASE WHEN report_type <> 'en' THEN report_type ELSE 'other' END AS report_type FROM {PAYLOADS} p""",
    "content_hash": f"SELECT table_id, {_HASH} AS content FROM {PAYLOADS} p",
    "index_reconcile": """SELECT doc_id AS table_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 13 <> 0 THEN 'insert' WHEN doc_id % 13 = 0 THEN 'delete' WHEN doc_id % 11 = 0 THEN 'update' END AS action FROM documents
 WHERE NOT (doc_id % 7 = 0 AND doc_id % 13 = 0) AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0)""",
}
