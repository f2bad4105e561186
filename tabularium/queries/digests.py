"""Digests of runs: orders stand for the records of a run, a later run loses, repeats and changes some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import digests
from tabularium.sources.payloads import read
from tabularium.sources.shared import new_folder

KEYS = ("o_orderkey",)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.to_date("o_orderdate").alias("o_orderdate"))


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each 1009 orders one has another price and one another status that is null, one is gone, one stands twice, and one has a new number."""
    rows, kind = _run(spark, sf_dir), F.col("o_orderkey") % 1009
    price = F.when(kind == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)")
    status = F.when(kind != 7, F.col("o_orderstatus"))
    every = rows.where(kind != 11).withColumns({"o_totalprice": price, "o_orderstatus": status}).withColumn("n", F.explode(F.when(kind == 13, F.array(F.lit(0), F.lit(0))).when(kind == 17, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))))
    return every.withColumn("o_orderkey", F.when(F.col("n") == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))).drop("n")


def run_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = digests.tree(_run(spark, sf_dir), KEYS)
    return nodes.select(F.col("level").cast("long").alias("level"), "path", "n_rows", "digest")


def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two runs, found from their kept trees."""
    runs, kept = (_run(spark, sf_dir), _later(spark, sf_dir)), []
    for rows in runs:
        path = new_folder(spark, "digests")
        digests.keep(digests.tree(rows, KEYS), path)
        kept.append(digests.opened(spark, path))
    leaves = digests.differing(*kept).where(F.col("level") == digests.DEPTH)
    return digests.changes(*runs, leaves, KEYS)


QUERIES = {"run_digest": run_digest, "run_changes": run_changes}

_ROWS = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders"


def _cell(x: str) -> str:
    return f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


_HASHED = f"h AS (SELECT sha256({_cell('o_orderkey')}) AS k, sha256({' || '.join(_cell(c) for c in ('o_custkey', 'o_orderdate', 'o_orderkey', 'o_orderstatus', 'o_totalprice'))}) AS r FROM ({_ROWS}))"
_SUMS = " || ':' || ".join(f"sum(CAST('0x' || r[{15 * k + 1}:{15 * k + 15}] AS BIGINT))" for k in range(digests.PARTS))
ORACLES = {
    "run_digest": f"WITH {_HASHED} SELECT level, k[:level] AS path, count(*) AS n_rows, sha256(count(*) || ':' || {_SUMS}) AS digest FROM h, (SELECT unnest(range({digests.DEPTH + 1})) AS level) GROUP BY ALL",
    "run_changes": """SELECT CASE WHEN n = 1 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, n_lost, n_new, status FROM (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderkey % 1009 AS kind FROM orders)
 JOIN (VALUES (3, 0, 1, 1, 'changed'), (7, 0, 1, 1, 'changed'), (11, 0, 1, 0, 'missing'), (13, 0, 0, 1, 'extra'), (17, 0, 1, 0, 'missing'), (17, 1, 0, 1, 'extra')) AS v(kind, n, n_lost, n_new, status) USING (kind)""",
}
