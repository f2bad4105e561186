"""A reranker fitted on questions whose passages stand in documents, and used on the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import reranking, search
from tabularium.queries.search import _best, _dense, questions
from tabularium.sources.payloads import of_tables, payloads
from tabularium.sources.shared import new_folder

FEATURES = ("lexical", "lexical_place", "dense", "dense_place", "word_share", "pair_share", "length")
#: Candidates of either search, folds of questions, and words in a row that a document must share with a question to be good.
CANDIDATES, FOLDS, SAME = 40, 4, 10


def _runs(terms: Column, n: int) -> Column:
    """All runs of n words, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.concat_ws(" ", F.slice(terms, i, n))))


def _runs_or_none(terms: Column, n: int) -> Column:
    return F.when(F.size(terms) >= n, _runs(terms, n)).otherwise(F.array().cast("array<string>"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both searches' best tables of each question with features, the rank that fusion gives them, and whether they are good."""
    dense = _dense(spark, sf_dir, CANDIDATES, rank="dense_rank")
    lexical = _best(spark, sf_dir, CANDIDATES, rank="bm25_rank")
    keys = ["question_id", "table_id"]
    fused = search.fused(dense.select(*keys, "dense_rank"), lexical.select(*keys, "bm25_rank")).select(*keys, "rank", "dense_rank", "bm25_rank")
    scores = lambda df, name: df.select(*keys, F.col("score").alias(name))
    asked = questions(spark, sf_dir).select("question_id", search.tokens(F.col("question")).alias("q"))
    texts = of_tables(payloads(spark, sf_dir), fused.join(asked, "question_id", "left_semi")).select("table_id", search.tokens(F.col("index_text")).alias("t"))
    # a vector's number can go beyond the questions; what has no question has nothing to be ranked by
    rows = fused.join(scores(dense, "dense"), keys, "left").join(scores(lexical, "lexical"), keys, "left").join(asked, "question_id").join(texts, "table_id")
    share = lambda n: F.try_divide(F.size(F.array_intersect(_runs_or_none(F.col("q"), n), _runs_or_none(F.col("t"), n))), F.size(_runs_or_none(F.col("q"), n)))
    place = lambda c: F.coalesce(1 / (search.RRF + F.col(c)), F.lit(0.0))
    return rows.select(
        *keys,
        "rank",
        F.arrays_overlap(_runs_or_none(F.col("q"), SAME), _runs_or_none(F.col("t"), SAME)).alias("good"),
        "lexical",
        place("bm25_rank").alias("lexical_place"),
        "dense",
        place("dense_rank").alias("dense_place"),
        share(1).alias("word_share"),
        share(2).alias("pair_share"),
        F.log1p(F.size("t")).alias("length"),
        reranking.folds(F.col("question_id"), FOLDS).alias("fold"),
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with rerank_rank: each fold's by weights that were fitted on the other folds."""
    path = new_folder(spark, "judged")  # fitted on many times, so it is written once
    reranking.scaled(candidates(spark, sf_dir), FEATURES).write.parquet(path)
    rows = spark.read.parquet(path)
    return reranking.reranked(rows, reranking.fitted(rows, FOLDS))


def learned_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("question_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), F.col("rank").cast("long").alias("fused_rank"), "table_id", "good", F.round("score", 4).alias("score"))


QUERIES: dict = {"learned_rerank": learned_rerank}
#: The weights are found by iteration, which SQL can't express; tests hold them against all pairs, and the ranks on questions that were held out.
ORACLES: dict = {}
