"""Structures within bounds against the same rule, written as a recursion."""

import json
import random

from pyspark.sql import functions as F

from tabularium.functions.structures import TOO_DEEP, bounded

RANDOM = random.Random(11)
NAMES = ["a", "b", "ab" * 4, "ab" * 4 + "x", "é", 'q"\\', "", "z"]


def some(depth=0):
    kind = RANDOM.random()
    if depth < 7 and kind < 0.4:
        return {RANDOM.choice(NAMES): some(depth + 1) for _ in range(RANDOM.randint(0, 7))}
    if depth < 7 and kind < 0.75:
        return [some(depth + 1) for _ in range(RANDOM.randint(0, 6))]
    return RANDOM.choice([None, True, False, 0, -12, 7_000_000_000, 2.5, "", "text", "longer than what is kept", 'é "\\\n\t/', "😀" * 9])


def rule(value, depth, items, longest, name, at=0):
    if at >= depth:
        return TOO_DEEP
    if isinstance(value, str):
        return value[:longest]
    if isinstance(value, dict):
        return {k[:name]: rule(value[k], depth, items, longest, name, at + 1) for k in sorted(value, key=str.encode)[:items]}
    if isinstance(value, list):
        return [rule(v, depth, items, longest, name, at + 1) for v in value[:items]]
    return value


def test_against_the_rule(spark):
    values = [some() for _ in range(300)]
    df = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=k % 2 == 0)) for k, v in enumerate(values)], "k int, t string")
    got = {r["k"]: json.loads(r["b"]) for r in df.select("k", bounded(F.col("t"), 4, 3, 8, 8).alias("b")).collect()}
    assert got == {k: rule(v, 4, 3, 8, 8) for k, v in enumerate(values)}


def test_odd_texts(spark):
    rows = [(None, None), ("", None), ("{", None), ('{"a":1,"a":2}', None), ("null", "null"), ("[]", "[]"), (" {} ", "{}"), ("[" * 40 + "]" * 40, "[" * 5 + f'"{TOO_DEEP}"' + "]" * 5), (json.dumps("x" * 600), json.dumps("x" * 500)), (json.dumps(list(range(30))), json.dumps(list(range(25)), separators=(",", ":")))]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string")
    got = [r["b"] for r in df.select("k", bounded(F.col("t")).alias("b")).orderBy("k").collect()]
    assert got == [b for _, b in rows]


def test_grows_with_the_depth_alone(spark):
    """Twice the levels, about twice the expression."""
    size = lambda depth: len(str(bounded(F.col("t"), depth)))
    sizes = [size(d) for d in (2, 4, 8)]
    assert sizes[2] - sizes[1] < 2.5 * (sizes[1] - sizes[0])
