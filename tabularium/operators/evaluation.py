"""Metrics of rankings, filters and answers, and the state of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(hits: Column, predicted: Column) -> Column:
    return F.coalesce(F.try_divide(hits, predicted), F.lit(0.0))


def recall(hits: Column, relevant: Column) -> Column:
    """One where nothing is relevant."""
    return F.coalesce(F.try_divide(hits, relevant), F.lit(1.0))


def f2(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0))


def ranking_scores(predicted: DataFrame, gold: DataFrame, questions: DataFrame, cut: int = 5) -> DataFrame:
    """precision, recall, f2 and mrr (first hit within cut) per question.

    predicted: question_id, item, rank (an item once each); gold: question_id, item; questions without
    prediction count as empty ones.
    """
    hits = predicted.join(gold, ["question_id", "item"], "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("hits"), F.min(F.when(F.col("rank") <= cut, F.col("rank"))).alias("first"))
    n_predicted = predicted.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_predicted"))
    n_gold = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    rows = questions.join(n_predicted, "question_id", "left").join(n_gold, "question_id", "left").join(hits, "question_id", "left").na.fill(0, ["hits", "n_predicted", "n_gold"])
    p, r = precision(F.col("hits"), F.col("n_predicted")), recall(F.col("hits"), F.col("n_gold"))
    return rows.select("question_id", "hits", p.alias("precision"), r.alias("recall"), f2(p, r).alias("f2"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def scores_at(predicted: DataFrame, gold: DataFrame, questions: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Means of ranking_scores() over questions for each cut, in one pass over the ranks."""
    each = questions.withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    n_gold = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_gold"))
    marked = predicted.join(gold.withColumn("hit", F.lit(1)), ["question_id", "item"], "left").select("question_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))
    inside = each.join(marked, "question_id").where("rank <= k").groupBy("question_id", "k").agg(F.count(F.lit(1)).alias("n_predicted"), F.sum("hit").alias("hits"))
    rows = each.join(inside, ["question_id", "k"], "left").join(n_gold, "question_id", "left").na.fill(0, ["hits", "n_predicted", "n_gold"])
    p, r = precision(F.col("hits"), F.col("n_predicted")), recall(F.col("hits"), F.col("n_gold"))
    return rows.groupBy("k").agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f2(p, r)).alias("f2"), F.count(F.lit(1)).alias("n"))


def set_scores(expected: Column, predicted: Column) -> list[Column]:
    """Of two arrays as sets: equal, covered, missing and extra values."""
    missing, extra = F.array_sort(F.array_except(expected, predicted)), F.array_sort(F.array_except(predicted, expected))
    return [((F.size(missing) == 0) & (F.size(extra) == 0)).alias("exact"), (F.size(missing) == 0).alias("covered"), F.concat_ws(",", missing).alias("missing"), F.concat_ws(",", extra).alias("extra")]


def label(values: Column) -> Column:
    """A set as one label; empty or null means that there was no prediction."""
    return F.when(F.size(F.coalesce(values, F.array())) > 0, F.concat_ws("+", F.array_sort(F.array_distinct(values)))).otherwise("<error-or-missing>")


def last(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The row of each key with the largest order; aggregated before the shuffle."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last"), F.count(F.lit(1)).alias("n"))
    return best.select(key, "n", "last.*")


def pending(selected: DataFrame, done: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """What is selected and not done, or is to be done again."""
    return selected.join(done.join(retry, key, "left_anti"), key, "left_anti")
