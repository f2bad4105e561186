"""A reranker that is fitted on judged candidates: a linear score, by pairs of a good and another candidate of one question."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of the squares of the weights, jobs of Newton's method at most, the step at which it ends, good candidates that are compared at once.
L2, ROUNDS, ENOUGH, BLOCK = 1e-3, 60, 1e-9, 64


def folds(key: Column, n: int) -> Column:
    """The fold of a question, by a hash of its id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)).cast("int")


def scaled(rows: DataFrame, features: Sequence[str], by: str = "fold") -> DataFrame:
    """rows with x: array<double> of the features less the mean of the rows in other folds, over their deviation; nulls and NaN are zero before, a constant is zero after."""
    clean = rows.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})
    sums = clean.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in features), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in features))  # a row for each fold
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    about = sums.select(by, rest("n").alias("n"), *(rest(f"{k}_{c}").alias(f"{k}_{c}") for c in features for k in "sq"))
    mean = lambda c: F.try_divide(F.col(f"s_{c}"), F.col("n"))
    spread = lambda c: F.sqrt(F.greatest(F.try_divide(F.col(f"q_{c}"), F.col("n")) - mean(c) * mean(c), F.lit(0.0)))
    ranges = about.select(by, F.array(*(F.coalesce(mean(c), F.lit(0.0)) for c in features)).alias("_m"), F.array(*(F.coalesce(spread(c), F.lit(0.0)) for c in features)).alias("_d"))
    moved = F.transform(F.arrays_zip(F.array(*features).alias("v"), F.col("_m").alias("m"), F.col("_d").alias("d")), lambda t: F.when(t["d"] > 1e-9, (t["v"] - t["m"]) / t["d"]).otherwise(0.0))
    return clean.join(F.broadcast(ranges), by).withColumn("x", moved).drop("_m", "_d")  # a row for each fold is sent


def pair_sums(good: np.ndarray, other: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of a question: the mean over its pairs of log(1 + exp(-margin)), of its gradient and of its Hessian, in one row; good candidates in blocks."""
    d = len(weights)
    out, n = np.zeros(1 + d + d * d), len(good) * len(other)
    for at in range(0, len(good), BLOCK):
        apart = (good[at : at + BLOCK, None, :] - other[None, :, :]).reshape(-1, d)
        margin = apart @ weights
        miss = 0.5 * (1 - np.tanh(margin / 2))
        out[0] += np.logaddexp(0, -margin).sum()
        out[1 : 1 + d] -= miss @ apart
        out[1 + d :] += ((apart * (miss * (1 - miss))[:, None]).T @ apart).ravel()
    return out / n


def fitted(rows: DataFrame, n_folds: int = 0, l2: float = L2) -> dict[int, list[float]]:
    """For each fold the weights that make the mean loss of the questions of all other folds, with l2 times half the squares, least.

    rows: question_id, x (array<double>), good (boolean) and, with folds, fold; without, fold 0 learns from all. A question counts as one however
    many pairs it has; one without a good candidate, or without another, has none. Every question's candidates are those that search left,
    so they fit a task, where sums stand for pairs. All folds go forward in the same jobs: of each task and fold a row of sums is
    left, added in two steps, and the driver gets a total a fold. The loss is convex, so the layout of the rows doesn't matter. A fold that has
    no pair to learn from is left out.
    """
    known = rows.withColumn("fold", F.col("fold") if n_folds else F.lit(-1)).dropna(subset=["question_id", "x", "good", "fold"])
    lists = known.groupBy("question_id", "fold").agg(F.collect_list(F.when(F.col("good"), F.col("x"))).alias("good"), F.collect_list(F.when(~F.col("good"), F.col("x"))).alias("other"))
    lists = lists.where((F.size("good") > 0) & (F.size("other") > 0)).select("fold", "good", "other").persist()
    try:
        first = lists.select(F.size(F.col("good")[0])).head()
        if first is None:
            return {}
        d, n = first[0], 1 + first[0] + first[0] ** 2
        names = [f"c{k}" for k in range(n + 1)]

        def totals(asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held: dict[int, np.ndarray] = {}
                for frame in frames:
                    for own, good, other in zip(frame["fold"], frame["good"], frame["other"], strict=True):
                        good, other = np.stack(good), np.stack(other)
                        for fold, w in asked.items():
                            if fold != own:
                                held[fold] = held.get(fold, 0.0) + np.append(pair_sums(good, other, w), 1.0)
                if held:
                    yield pd.DataFrame([[k, *v] for k, v in held.items()])

            parts = lists.mapInPandas(run, "fold int, " + ", ".join(f"{c} double" for c in names)).withColumn("p", F.spark_partition_id() % 64)
            some = parts.groupBy("fold", "p").agg(*(F.sum(c).alias(c) for c in names))
            out = {}
            for row in some.groupBy("fold").agg(*(F.sum(c).alias(c) for c in names)).collect():  # a row for each fold
                t, w = np.array(row[1:-1], float) / row[-1], asked[row["fold"]]
                out[row["fold"]] = t[0] + l2 / 2 * w @ w, t[1 : 1 + d] + l2 * w, t[1 + d :].reshape(d, d) + l2 * np.eye(d)
            return out

        weights = {fold: np.zeros(d) for fold in range(max(n_folds, 1))}
        now = totals(weights)
        weights = {fold: w for fold, w in weights.items() if fold in now}
        steps, open_ = {k: np.linalg.solve(now[k][2], now[k][1]) for k in weights}, set(weights)
        for _ in range(ROUNDS):
            tried = totals({k: weights[k] - steps[k] for k in open_})
            for k, new in tried.items():
                small = np.abs(steps[k]).max() < ENOUGH
                if new[0] > now[k][0] and not small:
                    steps[k] = steps[k] / 2  # too long
                    continue
                weights[k], now[k] = weights[k] - steps[k], new
                steps[k] = np.linalg.solve(new[2], new[1])
                if small:
                    open_.discard(k)
            if not open_:
                break
        return {k: w.tolist() for k, w in weights.items()}
    finally:
        lists.unpersist()


def reranked(rows: DataFrame, weights: dict[int, Sequence[float]], by: str = "fold") -> DataFrame:
    """rows (question_id, table_id, x and their fold) with score, by the weights of their fold, and rerank_rank; ties by table_id. Folds without weights score zero."""
    score = F.lit(0.0)
    for fold, w in weights.items():
        own = F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, w))).cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        score = F.when(F.col(by) == fold, own).otherwise(score)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "table_id"))
    return rows.withColumn("score", F.round(score, 6)).withColumn("rerank_rank", place)
