"""Digest trees: the same for any layout, and a way down to the rows that differ."""

import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from tabularium.operators import digests
from tabularium.sources.shared import new_folder

SCHEMA = "id long, name string, at timestamp, score double, tags array<string>, more map<string,int>, raw binary"


def run(n=400):
    rng = random.Random(3)
    return [(k if k % 50 else None, rng.choice(["a", "b:1", None]), datetime(2020, 1, 1 + k % 28), k / 7, ["x", None], {"p": k, "q": 1}, bytes([k % 256])) for k in range(n)]


def held(df):
    return sorted(map(tuple, df.collect()))


def test_any_layout(spark):
    df = spark.createDataFrame(run(), SCHEMA)
    one = held(digests.tree(df, ["id"]))
    for other in (df.repartition(7), df.repartition(3, "name").sortWithinPartitions("score"), df.select(*reversed(df.columns)), df.coalesce(1)):
        assert held(digests.tree(other, ["id"])) == one
    assert one[0][:3] == (0, "", 400)
    for level in range(digests.DEPTH + 1):
        assert sum(n for at, _, n, _ in one if at == level) == 400
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert held(digests.tree(df, ["id"])) == one
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert held(digests.tree(df.unionAll(df), ["id"]))[0] != one[0]
    assert [r[:3] for r in held(digests.tree(df.where("false"), ["id"]))] == [(0, "", 0)]


def test_way_down_to_a_row(spark):
    """One changed row differs in one node a level; kept trees tell the same, and the plan reads a folder a level."""
    df = spark.createDataFrame(run(), SCHEMA)
    changed = df.withColumn("score", F.when(F.col("id") == 123, -1.0).otherwise(F.col("score")))
    kept = []
    for rows in (df, changed):
        digests.keep(digests.tree(rows, ["id"]), path := new_folder(spark, "digests"))
        kept.append(digests.opened(spark, path))
    found = digests.differing(*kept)
    assert [r[0] for r in held(found)] == [0, 1, 2, 3]
    assert "PartitionFilters: [isnotnull(level" in found._jdf.queryExecution().toString()
    leaves = found.where("level = 3")
    assert held(digests.changes(df, changed, leaves, ["id"])) == [(123, 1, 1, "changed")]
    assert digests.differing(kept[0], kept[0]).count() == 0


def test_changes_against_counters(spark):
    """Random losses, repeats and changes, null keys included, against counted rows."""
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), rng.choice("ab"), rng.randint(0, 2)) for _ in range(300)]
    later = [r for r in rows if rng.random() > 0.05] + rng.sample(rows, 6) + [(99, "z", 1)]
    schema = "`a.b` long, c string, v int"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame(later, schema)
    leaves = digests.differing(digests.tree(one, ["a.b"], depth=2), digests.tree(two, ["a.b"], depth=2), 2).where("level = 2")
    lost, new = Counter(), Counter()
    for r, n in (Counter(rows) - Counter(later)).items():
        lost[r[0]] += n
    for r, n in (Counter(later) - Counter(rows)).items():
        new[r[0]] += n
    wanted = {(k, lost[k], new[k], "missing" if not new[k] else "changed" if lost[k] else "extra") for k in lost | new}
    assert set(map(tuple, digests.changes(one, two, leaves, ["a.b"], depth=2).collect())) == wanted
