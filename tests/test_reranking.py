"""The fitted reranker against all pairs in numpy, and against fusion on questions that were held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import reranking
from tabularium.queries import reranking as registered

SCHEMA = "question_id long, table_id long, x array<double>, good boolean"


def judged(seed=2, n=30, d=3):
    rng, rows = np.random.default_rng(seed), []
    for q in range(n):
        for t in range(int(rng.integers(2, 12))):
            x = rng.normal(size=d)
            rows.append((q, t, x.tolist(), bool(x @ [1.5, -0.5, 0.0] + rng.normal() > 0.7)))
    return rows


def loss(rows, w):
    """By definition."""
    each = []
    for q in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == q]
        pairs = [np.log1p(np.exp(-(np.array(a[2]) - np.array(b[2])) @ w)) for a in own if a[3] for b in own if not b[3]]
        each += [np.mean(pairs)] if pairs else []
    return np.mean(each) + reranking.L2 / 2 * w @ w


def test_sums_of_pairs():
    """Gradient and Hessian against differences, and blocks against the whole."""
    rng = np.random.default_rng(1)
    good, other, w, h = rng.normal(size=(150, 3)), rng.normal(size=(7, 3)), rng.normal(size=3), 1e-5
    at = reranking.pair_sums(good, other, w)
    wanted = np.mean([np.log1p(np.exp(-(a - b) @ w)) for a in good for b in other])
    assert at[0] == pytest.approx(wanted)
    for k in range(3):
        step = h * np.eye(3)[k]
        more, less = reranking.pair_sums(good, other, w + step), reranking.pair_sums(good, other, w - step)
        assert at[1 + k] == pytest.approx((more[0] - less[0]) / (2 * h), abs=1e-7)
        assert at[4:].reshape(3, 3)[k] == pytest.approx((more[1:4] - less[1:4]) / (2 * h), abs=1e-7)


def test_least_loss_in_any_layout(spark):
    rows = judged()
    df = spark.createDataFrame(rows, SCHEMA)
    w = np.array(reranking.fitted(df)[0])
    least = loss(rows, w)
    rng = np.random.default_rng(5)
    assert all(loss(rows, w + rng.normal(size=3) * s) > least for s in (1e-3, 0.1, 1.0) for _ in range(20))
    for other in (df.repartition(5), df.orderBy(F.desc("table_id")).coalesce(1)):
        assert reranking.fitted(other)[0] == pytest.approx(w, abs=1e-7)
    by_fold = df.withColumn("fold", (F.col("question_id") % 3).cast("int"))
    together = reranking.fitted(by_fold, 3)
    for fold in range(3):
        assert together[fold] == pytest.approx(reranking.fitted(by_fold.where(F.col("fold") != fold))[0], abs=1e-7)


def test_odd_rows(spark):
    assert reranking.fitted(spark.createDataFrame([], SCHEMA)) == {}
    one_kind = [(1, 1, [1.0], True), (2, 1, [0.0], False), (None, 1, [1.0], True), (3, 1, None, True), (3, 2, [1.0], None)]
    assert reranking.fitted(spark.createDataFrame(one_kind, SCHEMA)) == {}
    same = [(1, 1, [1.0, 0.0], True), (1, 2, [1.0, 0.0], False)] * 2
    assert reranking.fitted(spark.createDataFrame(same, SCHEMA)) == {0: [0.0, 0.0]}
    parted = [(1, 1, [1.0], True), (1, 2, [-1.0], False)]
    assert 0 < reranking.fitted(spark.createDataFrame(parted, SCHEMA))[0][0] < 100
    rows = spark.createDataFrame([(1, 1, 1.0, None, 0), (1, 2, 3.0, float("nan"), 0), (2, 1, 5.0, 2.0, 1)], "question_id long, table_id long, a double, b double, fold int")
    got = {(r["question_id"], r["table_id"]): r["x"] for r in reranking.scaled(rows, ["a", "b"]).collect()}
    assert got == {(1, 1): [0.0, 0.0], (1, 2): [0.0, 0.0], (2, 1): [3.0, 0.0]}  # one other row has no deviation
    ranks = reranking.reranked(reranking.scaled(rows, ["a", "b"]), {1: [2.0, 1.0]}).orderBy("question_id", "table_id").collect()
    assert [(r["score"], r["rerank_rank"]) for r in ranks] == [(0.0, 1), (0.0, 2), (6.0, 1)]


def test_better_than_fusion_on_held_out_questions(spark):
    rows = registered.learned_rerank(spark, "/root/testdata/sf0.01").where("good").groupBy("question_id").agg(F.min("rerank_rank").alias("new"), F.min("fused_rank").alias("old")).collect()
    mrr = lambda c: sum(1 / r[c] for r in rows if r[c] <= 5) / len(rows)
    print(len(rows), mrr("new"), mrr("old"))
    assert len(rows) >= 20
    assert mrr("new") > mrr("old")
