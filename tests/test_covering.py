"""Choices under coverage against the steps over all buckets, one by one, and against the best choice there is."""

import itertools
import random

import pytest

from tabularium.operators import covering

SCHEMA = "question_id long, bucket string, table_id long, concept string, weight long, cost long"


def offers(n, seed):
    rng, rows = random.Random(seed), []
    for q in range(n):
        for t in range(rng.randint(1, 9)):
            bucket, cost = rng.choice("abc"), rng.choice((1, 1, 2, 3))
            rows += [(q, bucket, q * 100 + t, f"{bucket}_{c}", 1 + c % 3, cost) for c in rng.sample(range(6), rng.randint(1, 5))]
    return rows


def cells_of(rows, weight):
    cells = {}
    for _, b, t, c, w, k in rows:
        cells.setdefault((t, b, k), {})[b, c] = w
        cells[t, b, k][b, ""] = weight
    return cells


def by_steps(rows, most, weight):
    """The rule itself, over all buckets of a question."""
    out = []
    for q in sorted({r[0] for r in rows}):
        cells, done = cells_of([r for r in rows if r[0] == q], weight), set()
        for place in range(1, most + 1):
            gains = [(-sum(w for c, w in own.items() if c not in done) / k, k, t, b) for (t, b, k), own in cells.items()]
            ratio, k, t, b = min(gains)
            if ratio == 0:
                break
            done |= set(cells[t, b, k])
            out.append((q, place, t, b, round(-ratio * k), -ratio))
    return out


@pytest.mark.parametrize("many", [256, 2, 0])
def test_by_steps(spark, many):
    """Within a row, by joins, and some buckets each way."""
    rows = offers(12, 5)
    got = covering.covering(spark.createDataFrame(rows, SCHEMA), 4, 4, many)
    assert sorted(map(tuple, got.collect())) == by_steps(rows, 4, 4)


def test_close_to_the_best(spark):
    """With equal costs the weight covered is at least 1 - 1/e of what any choice of so many tables covers."""
    rows = [(*r[:5], 1) for r in offers(25, 6)]
    got = covering.covering(spark.createDataFrame(rows, SCHEMA), 3).collect()
    same = 0
    for q in range(25):
        cells = cells_of([r for r in rows if r[0] == q], covering.BUCKET_WEIGHT)
        best = max(sum(dict(c for t in some for c in cells[t].items()).values()) for some in itertools.combinations(cells, min(3, len(cells))))
        reached = sum(r["gain"] for r in got if r["question_id"] == q)
        assert best >= reached >= (1 - 1 / 2.718281828) * best
        same += reached == best
    assert same >= 20


def test_names_that_count(spark):
    declared = spark.createDataFrame([(1, "a", "a_sales"), (1, "b", "b_sales"), (1, "b", "costs"), (None, "a", "x")], "question_id long, bucket string, concept string")
    claims = [(1, "a", 1, 1, "a_sales"), (1, "b", 2, 2, "a_sales"), (1, "b", 2, 2, "costs"), (1, "a", 1, 1, "costs"), (1, "a", 1, 1, "ab_new"), (1, "ab", 3, 3, "ab_new"), (1, "a", 1, 1, None), (1, "b", 2, 2, "plain"), (1, "b", 2, 2, "plain"), (2, "a", 4, 1, "a_")]
    got = covering.registered(declared, spark.createDataFrame(claims, "question_id long, bucket string, table_id long, position long, concept string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, "a_costs"), (1, "a", 1, "a_sales"), (1, "a", 1, "ab_new"), (1, "ab", 3, "ab_new"), (1, "b", 2, "b_plain"), (1, "b", 2, "b_sales"), (1, "b", 2, "costs"), (2, "a", 4, "a_")]


def test_odd_rows(spark):
    rows = [(1, "a", 1, "x", 1, 1), (1, "a", 1, "x", 3, 2), (1, "a", 1, "x", 3, 2), (1, "a", 2, "", 1, 1), (1, "a", 3, None, 1, 1), (None, "a", 4, "x", 1, 1), (1, "a", 5, "y", 0, 1), (1, "a", 6, "y", 1, 0), (1, "a", 7, "x", 3, 1), (1, None, 8, "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for many in (256, 0):
        got = covering.covering(df.selectExpr("*", "1 AS n", "2 AS gain", "3 AS cells"), many=many)
        assert list(map(tuple, got.collect())) == [(1, 1, 1, "a", 7, 7.0)]
        assert covering.covering(df.where("false"), many=many).count() == 0


def test_audit(spark):
    declared = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "c", "z")], "question_id long, bucket string, concept string")
    offered = spark.createDataFrame([(1, "a", 1, "x", 1, 1), (1, "a", 2, "w", 1, 1), (2, "a", 3, "x", 1, 1), (3, "c", 4, "other", 1, 1)], SCHEMA)
    got = covering.audited(declared, offered, covering.covering(offered))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2, "b:y", "b", "bucket"), (2, 1, 1, "", "", "ok"), (3, 2, 1, "c:z", "", "concept")]
