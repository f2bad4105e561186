"""Metrics and run states; labels stand for relevance, sources for buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.text import is_close
from tabularium.operators import evaluation, search
from tabularium.queries.search import _LEXICAL, _best, _rank, questions
from tabularium.sources.payloads import read

GOLD = "gold AS (SELECT i.item_id AS question_id, d.doc_id AS item FROM labels d JOIN benchmark i ON d.doc_id % 40 = i.item_id % 40 WHERE d.quality = 1)"
_PRED = f"pred AS (SELECT question_id, table_id AS item, rank FROM {_rank('lexical')} WHERE rank <= 80)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 80).select("question_id", F.col("table_id").alias("item"), "rank")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are relevant to the questions whose number has the same remainder."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item"), (F.col("doc_id") % 40).alias("slot"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 40).alias("slot"))
    return good.join(asked, "slot").select("question_id", "item")


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.ranking_scores(_predicted(spark, sf_dir), _gold(spark, sf_dir), questions(spark, sf_dir).select("question_id"))
    return out.select("question_id", F.col("hits").cast("long").alias("hits"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f2", "mrr")))


def metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.scores_at(_predicted(spark, sf_dir), _gold(spark, sf_dir), questions(spark, sf_dir).select("question_id"), (5, 10, 20, 80))
    return out.select(F.col("k").cast("long").alias("k"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f2")), "n")


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking_metrics(spark, sf_dir)
    return rows.agg(*(F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "f2", "mrr")), F.count(F.lit(1)).alias("n"))


def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored order totals against the sum of their lines, with relative tolerance; orders without lines count as wrong."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total"))
    rows = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    match = F.coalesce(is_close(F.col("o_totalprice"), F.col("total"), 0.5, 1e-6), F.lit(False))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(match).cast("long").alias("n_right"), F.count_if(F.col("total").isNull()).cast("long").alias("n_missing"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the statuses of all orders, and those of urgent and high ones as the prediction."""
    orders = read(spark, sf_dir, "orders")
    urgent = F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"), F.col("o_orderstatus"))
    return orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("expected"), F.array_sort(F.collect_set(urgent)).alias("predicted"))


def filter_set_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("o_custkey", *evaluation.set_scores(F.col("expected"), F.col("predicted")))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sets(spark, sf_dir).select(evaluation.label(F.col("expected")).alias("expected"), evaluation.label(F.col("predicted")).alias("predicted"))
    return rows.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def bucket_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources found for a question against the sources of its relevant documents, summed over all questions."""
    source = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source")
    found = _best(spark, sf_dir, 10).select("question_id", F.col("ticker").alias("source")).distinct()
    wanted = _gold(spark, sf_dir).join(source, "item").select("question_id", "source").distinct()
    hits = found.join(wanted, ["question_id", "source"], "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sums = n(hits, "hits").join(n(found, "found"), F.lit(True)).join(n(wanted, "wanted"), F.lit(True))  # one row each
    return sums.select("hits", "found", "wanted", F.round(evaluation.precision(F.col("hits"), F.col("found")), 6).alias("precision"), F.round(evaluation.recall(F.col("hits"), F.col("wanted")), 6).alias("recall"))


def question_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their lines: a single one, one per supplier, several of a supplier."""
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("most") == 1, "one_per_doc").otherwise("multi_per_doc")
    return per.groupBy(kind.alias("slice")).agg(F.count(F.lit(1)).alias("n_questions"), F.sum("n").cast("long").alias("n_tables"))


def loss_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where relevant documents are lost: before the 80 retrieved, the 20 best, the 10 best of the selection."""
    ranks = _best(spark, sf_dir, 80).select("question_id", F.col("table_id").alias("item"), "rank")
    stage = F.when(F.col("rank").isNull(), "retriever").when(F.col("rank") > 20, "reranker").when(F.col("rank") > 10, "selector").otherwise("kept")
    return _gold(spark, sf_dir).join(ranks, ["question_id", "item"], "left").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def golden_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are checked like golden records: a unique id, values within bounds, a document that exists."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("known"))
    rows = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).join(docs, "doc_id", "left")
    problem = F.when(F.col("n") > 1, "repeated").when(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1), "value").when(F.col("known").isNull(), "unknown").when((F.col("toxic") == 1) & (F.col("quality") == 1), "contradiction")
    return rows.select("doc_id", F.coalesce(problem, F.lit("ok")).alias("status"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).cast("long").alias("n_large"), F.count_if(F.col("value").isNull()).cast("long").alias("n_null"), F.count_distinct("user_id").alias("n_users"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without label, and those whose label is to be made again."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    return evaluation.pending(docs, labels.select("doc_id"), labels.where("toxic = 1").select("doc_id"), "doc_id")


def failure_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, with how many there were."""
    return evaluation.last(read(spark, sf_dir, "events"), "user_id", "event_id", "event_id", "event_type")


def replay_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of the assistant in each conversation."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text_md5", F.md5("text"))
    return evaluation.last(turns, "conv_id", "turn", "turn", "text_md5")


def submission_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as evidence: an ordered array of variables and paths."""
    lines = read(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("data/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"), F.lit(".csv"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), path.alias("path")))).alias("all"))
    evidence = F.transform("all", lambda x, i: F.concat(F.lit("df_"), (i + 1).cast("string"), F.lit("="), x["path"]))
    return per.select("l_orderkey", F.size("all").cast("long").alias("n"), F.concat_ws(";", evidence).alias("evidence"))


QUERIES = {f.__name__: f for f in (ranking_metrics, metrics_at_k, macro_metrics, answer_accuracy, filter_set_accuracy, confusion_matrix, bucket_pr, question_slices, loss_attribution, golden_validate, status_counts, resume_pending, failure_latest, replay_last_event, submission_shape)}

_F2 = "coalesce(5 * p * r / nullif(4 * p + r, 0), 0)"
_SCORED = f"""scored AS (SELECT question_id, hits, p, r, {_F2} AS f, mrr FROM (SELECT item_id AS question_id, coalesce(hits, 0) AS hits, coalesce(coalesce(hits, 0)::DOUBLE / nullif(np, 0), 0) AS p, coalesce(coalesce(hits, 0)::DOUBLE / nullif(ng, 0), 1) AS r, coalesce(1.0::DOUBLE / first, 0) AS mrr
 FROM benchmark LEFT JOIN (SELECT question_id AS item_id, count(*) AS np FROM pred GROUP BY ALL) USING (item_id) LEFT JOIN (SELECT question_id AS item_id, count(*) AS ng FROM gold GROUP BY ALL) USING (item_id)
 LEFT JOIN (SELECT question_id AS item_id, count(*) AS hits, min(rank) FILTER (rank <= 5) AS first FROM pred JOIN gold USING (question_id, item) GROUP BY ALL) USING (item_id)))"""
_SETS = "sets AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS e, coalesce(list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderpriority[1] IN ('1', '2'))), []) AS p FROM orders GROUP BY o_custkey)"
ORACLES = {
    "ranking_metrics": f"WITH {_LEXICAL}, {_PRED}, {GOLD}, {_SCORED} SELECT question_id, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f2, round(mrr, 6) AS mrr FROM scored",
    "metrics_at_k": f"""WITH {_LEXICAL}, {_PRED}, {GOLD}, ks AS (SELECT item_id AS question_id, unnest([5, 10, 20, 80]) AS k FROM benchmark),
 s AS (SELECT question_id, k, (SELECT count(*) FROM pred p WHERE p.question_id = ks.question_id AND rank <= k) AS np, (SELECT count(*) FROM pred p JOIN gold g USING (question_id, item) WHERE p.question_id = ks.question_id AND rank <= k) AS h, (SELECT count(*) FROM gold g WHERE g.question_id = ks.question_id) AS ng FROM ks),
 t AS (SELECT k, coalesce(h::DOUBLE / nullif(np, 0), 0) AS p, coalesce(h::DOUBLE / nullif(ng, 0), 1) AS r FROM s)
 SELECT CAST(k AS BIGINT) AS k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg({_F2}), 6) AS f2, count(*) AS n FROM t GROUP BY k""",
    "macro_metrics": f"WITH {_LEXICAL}, {_PRED}, {GOLD}, {_SCORED} SELECT round(avg(round(p, 6)), 5) AS precision, round(avg(round(r, 6)), 5) AS recall, round(avg(round(f, 6)), 5) AS f2, round(avg(round(mrr, 6)), 5) AS mrr, count(*) AS n FROM scored",
    "answer_accuracy": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (abs(o_totalprice - total) <= greatest(0.5 * greatest(abs(o_totalprice), abs(total)), 1e-6)) AS n_right, count(*) FILTER (total IS NULL) AS n_missing FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    "filter_set_accuracy": f"WITH {_SETS} SELECT o_custkey, len(list_filter(e, lambda x: NOT list_contains(p, x))) = 0 AND len(list_filter(p, lambda x: NOT list_contains(e, x))) = 0 AS exact, len(list_filter(e, lambda x: NOT list_contains(p, x))) = 0 AS covered, array_to_string(list_filter(e, lambda x: NOT list_contains(p, x)), ',') AS missing, array_to_string(list_filter(p, lambda x: NOT list_contains(e, x)), ',') AS extra FROM sets",
    "confusion_matrix": f"WITH {_SETS} SELECT array_to_string(e, '+') AS expected, CASE WHEN len(p) > 0 THEN array_to_string(p, '+') ELSE '<error-or-missing>' END AS predicted, count(*) AS n FROM sets GROUP BY ALL",
    "bucket_pr": f"""WITH {_LEXICAL}, {GOLD}, f AS (SELECT DISTINCT question_id, ticker AS source FROM {_rank('lexical')} WHERE rank <= 10), w AS (SELECT DISTINCT question_id, source FROM gold JOIN documents ON doc_id = item),
 s AS (SELECT (SELECT count(*) FROM f JOIN w USING (question_id, source)) AS hits, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM w) AS wanted) SELECT hits, found, wanted, round(coalesce(hits::DOUBLE / nullif(found, 0), 0), 6) AS precision, round(coalesce(hits::DOUBLE / nullif(wanted, 0), 1), 6) AS recall FROM s""",
    "question_slices": "SELECT CASE WHEN n = 1 THEN 'single' WHEN most = 1 THEN 'one_per_doc' ELSE 'multi_per_doc' END AS slice, count(*) AS n_questions, CAST(sum(n) AS BIGINT) AS n_tables FROM (SELECT l_orderkey, sum(n) AS n, max(n) AS most FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL) GROUP BY 1",
    "loss_attribution": f"WITH {_LEXICAL}, {_PRED}, {GOLD} SELECT CASE WHEN rank IS NULL THEN 'retriever' WHEN rank > 20 THEN 'reranker' WHEN rank > 10 THEN 'selector' ELSE 'kept' END AS stage, count(*) AS n FROM gold LEFT JOIN pred USING (question_id, item) GROUP BY 1",
    "golden_validate": "SELECT l.doc_id, CASE WHEN n > 1 THEN 'repeated' WHEN quality NOT IN (0, 1) OR toxic NOT IN (0, 1) THEN 'value' WHEN d.doc_id IS NULL THEN 'unknown' WHEN toxic = 1 AND quality = 1 THEN 'contradiction' ELSE 'ok' END AS status FROM (SELECT doc_id, count(*) AS n, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY ALL) l LEFT JOIN documents d USING (doc_id)",
    "status_counts": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS n_large, count(*) FILTER (value IS NULL) AS n_null, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "resume_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))",
    "failure_latest": "SELECT user_id, count(*) AS n, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "replay_last_event": "SELECT conv_id, count(*) AS n, max(turn) AS turn, md5(arg_max(text, turn)) AS text_md5 FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "submission_shape": "SELECT l_orderkey, count(*) AS n, string_agg('df_' || rn || '=data/' || l_partkey || '_' || l_suppkey || '.csv', ';' ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'data/' || l_partkey || '_' || l_suppkey || '.csv') AS rn FROM lineitem) GROUP BY l_orderkey",
}
