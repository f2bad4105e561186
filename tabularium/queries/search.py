"""Filters, BM25, cosine, fusion, interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import index, search
from tabularium.sources.payloads import payloads, read
from tabularium.sources.shared import file_system, kept, new_folder, stamp

PAYLOADS = """(SELECT doc_id AS table_id, source AS ticker, lang AS report_type, CAST(2015 + doc_id % 11 AS INTEGER) AS year,
  CASE doc_id % 4 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'cash_flow' ELSE 'note_table' END AS table_type,
  doc_id + 1 AS start_line, text AS index_text FROM documents)"""
#: Folders of terms and files a folder; more for larger tables.
BUCKETS, PARTS = 16, 1
_STOP = "'bao', 'bang', 'cac', 'cho', 'co', 'cong', 'cua', 'cuoi', 'den', 'dong', 'giua', 'la', 'nam', 'ngay', 'nhieu', 'so', 'theo', 'trong', 'trieu', 'ty', 'vao', 'va'"


def fold_sql(x: str) -> str:
    return f"replace(strip_accents(replace(lower({x}), 'ß', 'ss')), 'đ', 'd')"


def tokens_sql(x: str) -> str:
    folded = f"list_transform(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1), lambda w: {fold_sql('w')})"
    kept = f"list_filter({folded}, lambda w: w NOT IN ({_STOP}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {folded} END"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.metadata_filter({"ticker": ["src1", "src3", "src7"], "year": [2016, 2017, 2021], "report_type": ["en", "fr"], "table_type": []})
    return payloads(spark, sf_dir).where(wanted).select("table_id", "ticker", "year", "report_type", "table_type")


def token_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search.tokens(F.col("index_text"))
    return payloads(spark, sf_dir).select("table_id", F.size(terms).cast("long").alias("n_terms"), F.concat_ws(" ", terms).alias("terms"))


def filter_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = payloads(spark, sf_dir).where("table_type = 'cash_flow' and year = 2020")
    return search.relaxed(recent, ["fr"]).select("table_id", "ticker", "report_type", "relaxed", "keeps_type")


#: The folders of the indexes of this process: a table is indexed once as long as its files are the same.
_KEPT: dict[tuple, str] = {}


def _indexed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the documents, built when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, f"{sf_dir}/documents.parquet"))
    path = _KEPT.get(key)
    if path:
        fs, versions = file_system(spark, f"{path}/versions")
        if fs.exists(versions):
            return index.opened(spark, path)
    held = index.created(spark, new_folder(spark, "index"), BUCKETS, PARTS).synced(payloads(spark, sf_dir))
    _KEPT[key] = held.path
    return held


def _best(spark: SparkSession, sf_dir: str, k: int, by_ticker: bool = False, rank: str = "rank") -> DataFrame:
    """The k best tables of each question (or of each of its tickers) by lexical search, found once: plans use them several times."""
    best = _indexed(spark, sf_dir).best(questions(spark, sf_dir), k, by_ticker, rank)
    return kept(best.withColumnRenamed("scope", "ticker"), "lexical")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir, 10)
    return best.select("question_id", F.col("rank").cast("long").alias("rank"), "table_id", F.round("score", 6).alias("score"))


def _dense(spark: SparkSession, sf_dir: str, k: int, rank: str = "rank") -> DataFrame:
    """The k vectors that are most like each query vector, found once."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("table_id"), "embedding")
    asked = vectors.where("table_id % 20 = 0").select((F.col("table_id") / 20).cast("long").alias("question_id"), F.col("embedding").alias("query"))
    return kept(search.best_cosine(vectors, asked, k, rank), "dense")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _dense(spark, sf_dir, 10)
    return best.select("question_id", F.col("rank").cast("long").alias("rank"), "table_id", F.round("score", 5).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir, 40, rank="dense_rank").select("question_id", "table_id", "dense_rank")
    lexical = _best(spark, sf_dir, 40, rank="bm25_rank").select("question_id", "table_id", "bm25_rank")
    return search.fused(dense, lexical).select("question_id", F.col("rank").cast("long").alias("rank"), "table_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("rrf_score", 9).alias("rrf_score"))


def fusion_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused rows with their metadata, or the fields in which the two lists disagree: the lexical list is stale for every seventh table, and lacks a type for every 31st."""
    about = payloads(spark, sf_dir).select("table_id", *search.FIELDS)
    stale = about.withColumn("year", F.when(F.col("table_id") % 7 == 0, F.col("year") - 1).otherwise(F.col("year"))).withColumn("table_type", F.when(F.col("table_id") % 31 != 0, F.col("table_type")))
    dense = _dense(spark, sf_dir, 40, rank="dense_rank").select("question_id", "table_id", "dense_rank")
    lexical = _best(spark, sf_dir, 40, rank="bm25_rank").select("question_id", "table_id", "bm25_rank")
    checked = search.metadata_conflicts(dense.join(about, "table_id"), lexical.join(stale, "table_id"))
    out = search.fused(dense, lexical).join(checked, ["question_id", "table_id"], "left").join(about, "table_id", "left")
    conflicts = F.coalesce("conflicts", F.lit(""))
    known = [F.when(conflicts == "", F.col(f)).alias(f) for f in ("year", "table_type")]
    return out.select("question_id", F.col("rank").cast("long").alias("rank"), "table_id", conflicts.alias("conflicts"), F.when(conflicts != "", "conflict").otherwise("ok").alias("status"), *known)


def balanced_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _best(spark, sf_dir, 80, by_ticker=True, rank="bucket_rank")
    out = search.interleaved(ranked, 80)
    return out.select("question_id", F.col("position").cast("long").alias("position"), "ticker", F.col("bucket_rank").cast("long").alias("bucket_rank"), "table_id")


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk on an index that went through changes: rows came, texts changed and changed back, rows went and came again, and it was merged."""
    rows, asked = payloads(spark, sf_dir), questions(spark, sf_dir)
    odd = F.when(F.col("table_id") % 11 == 0, F.concat("index_text", F.lit(" other words"))).otherwise(F.col("index_text"))
    held = index.created(spark, new_folder(spark, "index"), BUCKETS, PARTS).synced(rows.where("table_id % 7 <> 0").withColumn("index_text", odd))
    held = held.synced(rows.where("table_id % 13 <> 0"))
    held = index.opened(spark, held.path).synced(rows.where("table_id % 5 <> 0")).merged()
    held = index.opened(spark, held.path).synced(rows)
    best = held.best(asked, 10)
    return best.select("question_id", F.col("rank").cast("long").alias("rank"), "table_id", F.round("score", 6).alias("score"))


_LEXICAL = f"""toks AS (SELECT ticker, table_id, {tokens_sql('index_text')} AS terms FROM {PAYLOADS} p),
docs AS (SELECT ticker, table_id, len(terms) AS length, unnest(terms) AS term FROM toks),
post AS (SELECT ticker, table_id, length, term, count(*) AS tf FROM docs GROUP BY ALL),
sizes AS (SELECT ticker, count(*) AS n, avg(len(terms)) AS mean FROM toks GROUP BY ticker),
dfs AS (SELECT ticker, term, count(*) AS df FROM post GROUP BY ALL),
ask AS (SELECT DISTINCT question_id, unnest(terms) AS term FROM (SELECT item_id AS question_id, {tokens_sql('text')} AS terms FROM benchmark)),
lexical AS (SELECT question_id, ticker, table_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 9) AS score
  FROM post JOIN dfs USING (ticker, term) JOIN sizes USING (ticker) JOIN ask USING (term) GROUP BY ALL)"""
_DENSE = """dense AS (SELECT CAST(q.vec_id // 20 AS BIGINT) AS question_id, e.vec_id AS table_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"""


def _rank(source: str, by: str = "question_id") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, table_id) AS rank FROM {source})"


QUERIES = {"metadata_filter": metadata_filter, "token_fold": token_fold, "filter_relax": filter_relax, "bm25_topk": bm25_topk, "dense_topk": dense_topk, "rrf_fusion": rrf_fusion, "balanced_interleave": balanced_interleave, "index_search": index_search, "fusion_metadata": fusion_metadata}

ORACLES = {
    "metadata_filter": f"SELECT table_id, ticker, year, report_type, table_type FROM {PAYLOADS} p WHERE ticker IN ('src1', 'src3', 'src7') AND year IN (2016, 2017, 2021) AND report_type IN ('en', 'fr')",
    "token_fold": f"SELECT table_id, CAST(len(terms) AS BIGINT) AS n_terms, array_to_string(terms, ' ') AS terms FROM (SELECT table_id, {tokens_sql('index_text')} AS terms FROM {PAYLOADS} p)",
    "filter_relax": f"SELECT table_id, ticker, report_type, NOT strict AS relaxed, keeps_type FROM (SELECT *, min(strict) OVER () AS keeps_type FROM (SELECT *, max(report_type = 'fr') OVER (PARTITION BY ticker) AS strict FROM {PAYLOADS} p WHERE table_type = 'cash_flow' AND year = 2020)) WHERE NOT strict OR report_type = 'fr'",
    "bm25_topk": f"WITH {_LEXICAL} SELECT question_id, rank, table_id, round(score, 6) AS score FROM {_rank('lexical')} WHERE rank <= 10",
    "dense_topk": f"WITH {_DENSE} SELECT question_id, rank, table_id, round(score, 5) AS score FROM {_rank('dense')} WHERE rank <= 10",
    "rrf_fusion": f"""WITH {_LEXICAL}, {_DENSE}, l AS (SELECT question_id, table_id, rank AS bm25_rank FROM {_rank('lexical')} WHERE rank <= 40), d AS (SELECT question_id, table_id, rank AS dense_rank FROM {_rank('dense')} WHERE rank <= 40),
f AS (SELECT question_id, table_id, dense_rank, bm25_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 12) AS s FROM d FULL JOIN l USING (question_id, table_id))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, least(coalesce(dense_rank, 1000000000), coalesce(bm25_rank, 1000000000)), table_id) AS rank, table_id, dense_rank, bm25_rank, round(s, 9) AS rrf_score FROM f""",
    "balanced_interleave": f"""WITH {_LEXICAL}, r AS (SELECT question_id, ticker, table_id, rank AS bucket_rank FROM {_rank('lexical', 'question_id, ticker')} WHERE rank <= 80),
q AS (SELECT question_id, ceil(80.0 / count(DISTINCT ticker)) AS quota FROM r GROUP BY question_id)
SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY bucket_rank, ticker, table_id) AS position, ticker, bucket_rank, table_id FROM r JOIN q USING (question_id) WHERE bucket_rank <= quota) WHERE position <= 80""",
}
ORACLES["index_search"] = ORACLES["bm25_topk"]
ORACLES["fusion_metadata"] = f"""WITH {_LEXICAL}, {_DENSE}, l AS (SELECT question_id, table_id, rank AS bm25_rank FROM {_rank('lexical')} WHERE rank <= 40), d AS (SELECT question_id, table_id, rank AS dense_rank FROM {_rank('dense')} WHERE rank <= 40),
f AS (SELECT question_id, table_id, dense_rank, bm25_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 12) AS s FROM d FULL JOIN l USING (question_id, table_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, least(coalesce(dense_rank, 1000000000), coalesce(bm25_rank, 1000000000)), table_id) AS rank,
  CASE WHEN dense_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN concat_ws(',', CASE WHEN table_id % 7 = 0 THEN 'year' END, CASE WHEN table_id % 31 = 0 THEN 'table_type' END) ELSE '' END AS conflicts FROM f)
SELECT question_id, rank, table_id, conflicts, CASE WHEN conflicts = '' THEN 'ok' ELSE 'conflict' END AS status, CASE WHEN conflicts = '' THEN year END AS year, CASE WHEN conflicts = '' THEN table_type END AS table_type FROM r LEFT JOIN {PAYLOADS} p USING (table_id)"""
