"""Digests of tables that don't hang on order or partitions: a tree that tells where two runs differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StructType, TimestampType

#: Hexadecimal digits of a key's hash that name a leaf, and numbers of 60 bits that a row's hash is cut into.
DEPTH, PARTS = 3, 4


def _text(column: Column, kind: DataType) -> Column:
    """A value as text that is the same in every session: times as microseconds, no negative zero, maps by sorted entries."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, DoubleType | FloatType):
        return (column + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(column)
    if isinstance(kind, MapType):
        return F.when(column.isNotNull(), F.to_json(F.array_sort(F.map_entries(column))))
    if isinstance(kind, ArrayType | StructType):
        return F.when(column.isNotNull(), F.to_json(column, {"ignoreNullFields": "false"}))
    return column.cast("string")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the named columns in order of their names: each as its length, ":" and its text, or "-" if it is null."""
    texts = [_text(F.col(f"`{c}`"), rows.schema[c].dataType) for c in sorted(columns)]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hashed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int) -> DataFrame:
    return rows.select(*(F.col(f"`{k}`") for k in keys), F.substring(fingerprint(rows, keys), 1, depth).alias("_path"), fingerprint(rows, columns).alias("_row"))


def tree(rows: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """(level, path, n_rows, digest): the root at level 0 with path "", its leaves at level `depth`.

    A row belongs to the leaf that the first digits of its key's hash name, so one row that changes without its key changes a single path. A node's
    digest is that of the number of its rows and the sums of their hashes, cut into four numbers: any order, repartitioning or retry gives the
    same, and repeated rows count. It guards against mistakes, not against one who makes up rows. Rows are summed before the one
    shuffle, which moves at most 16 ** depth sums a task. An empty table has its root alone. columns: all if not given.
    """
    numbers = [F.conv(F.substring("_row", 15 * k + 1, 15), 16, 10).cast("decimal(28,0)") for k in range(PARTS)]
    sums = [f"s{k}" for k in range(PARTS)]
    leaves = _hashed(rows, keys, columns or rows.columns, depth).groupBy(F.col("_path").alias("leaf")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).cast("decimal(38,0)").alias(s) for x, s in zip(numbers, sums, strict=True)))
    # a leaf stands for itself on each level above it: its sums are all that is needed there
    nodes = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "*").select("level", F.expr("substring(leaf, 1, level)").alias("path"), "n", *sums)
    total = nodes.unionByName(rows.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n"), *(F.lit(0).cast("decimal(38,0)").alias(s) for s in sums)))
    added = total.groupBy("level", "path").agg(F.sum("n").alias("n_rows"), *(F.sum(s).cast("decimal(38,0)").cast("string").alias(s) for s in sums))
    return added.select("level", "path", "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *sums), 256).alias("digest"))


def keep(nodes: DataFrame, path: str) -> None:
    """Writes a tree beside a run, a folder for each level; few nodes, so one file each."""
    nodes.coalesce(1).write.partitionBy("level").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, n_rows long, digest string, level int").parquet(path).select("level", "path", "n_rows", "digest")


def differing(before: DataFrame, after: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, path, n_before, n_after): the nodes in which two trees of one depth differ, from the root down.

    Each level looks at children of nodes that differ alone, and on kept trees reads its own folder alone.
    """
    found = []
    for level in range(depth + 1):
        one, two = (t.where(F.col("level") == level).select("path", F.col("n_rows").alias(f"n_{name}"), F.col("digest").alias(name)) for t, name in ((before, "before"), (after, "after")))
        if found:
            above = found[-1].select(F.col("path").alias("parent"))
            one, two = (t.join(above, F.substring("path", 1, level - 1) == F.col("parent"), "left_semi") for t in (one, two))
        both = one.join(two, "path", "full").where(~F.col("before").eqNullSafe(F.col("after")))
        found.append(both.select(F.lit(level).alias("level"), "path", F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"), F.coalesce("n_after", F.lit(0)).cast("long").alias("n_after")))
    return reduce(DataFrame.unionByName, found)


def changes(before: DataFrame, after: DataFrame, leaves: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """(keys, n_lost, n_new, status): what became of the rows of each key in these leaves (path): "missing", "extra" or "changed".

    Rows count as often as they stand. Only rows of the leaves are shuffled; both tables have the same columns. Null keys are keys.
    """
    own = columns or before.columns
    sides = [_hashed(t, keys, own, depth).withColumn("_n", F.lit(n)).join(leaves.select(F.col("path").alias("_path")), "_path", "left_semi") for t, n in ((before, -1), (after, 1))]
    names = [F.col(f"`{k}`") for k in keys]
    left = sides[0].unionByName(sides[1]).groupBy(*names, "_row").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    out = left.groupBy(*names).agg(F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("n_lost"), F.sum(F.greatest("_n", F.lit(0))).alias("n_new"))
    return out.withColumn("status", F.when(F.col("n_new") == 0, "missing").when(F.col("n_lost") == 0, "extra").otherwise("changed"))
