"""Calculations over statements: a row per entity and year, a column per measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Financial ratios by name: from measures to a Column; zero denominators give null.
RATIOS: dict[str, Callable[[], Column]] = {
    "margin": lambda: F.try_divide(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100,
    "cost_share": lambda: F.try_divide("cost", "revenue") * 100,
    "turnover": lambda: F.try_divide("revenue", "balance"),
    "coverage": lambda: F.try_divide(F.col("balance") - F.col("cost"), F.col("cost")),
    "unit_price": lambda: F.try_divide("revenue", "quantity"),
}


def _by_year() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("year")


def statements(sales: DataFrame, orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """(entity, year, revenue, cost, quantity, balance) per nation and year of the order."""
    lines = sales.select("l_orderkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), (F.col("l_extendedprice") * F.col("l_tax")).alias("c"))
    per_order = lines.groupBy("l_orderkey").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("l_quantity").alias("q"))
    placed = orders.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    joined = placed.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per_nation = joined.groupBy("c_nationkey", "year").agg(F.sum("r").alias("revenue"), F.sum("c").alias("cost"), F.sum("q").alias("quantity"), F.sum("o_totalprice").alias("balance"))
    named = per_nation.join(nations.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    money = [F.round(c, 4).alias(c) for c in ("revenue", "cost", "quantity", "balance")]
    return named.select(F.col("n_name").alias("entity"), F.col("year").cast("int").alias("year"), *money)


def mean(measure: str) -> Column:
    """Of amounts with 4 decimals, summed as decimals, so that the order of rows doesn't matter."""
    return F.sum(F.col(measure).cast("decimal(20,4)")).cast("double") / F.count(measure)


def previous(measure: Column, years: int = 1) -> Column:
    """The measure so many years before; null if that year is missing."""
    return F.when(F.lag("year", years).over(_by_year()) == F.col("year") - years, F.lag(measure, years).over(_by_year()))


def following(measure: Column) -> Column:
    return F.when(F.lead("year").over(_by_year()) == F.col("year") + 1, F.lead(measure).over(_by_year()))


def growth(measure: Column) -> Column:
    """Percent over the year before."""
    return F.try_divide(measure - previous(measure), previous(measure)) * 100


def average_of_two(measure: Column) -> Column:
    """Of this year and the year before; null without it."""
    return (measure + previous(measure)) / 2


def best_year(rows: DataFrame, measure: str, largest: bool = True, by: str = "entity") -> DataFrame:
    """The row of each entity with the largest (smallest) measure; the earliest of equals."""
    order = Window.partitionBy(by).orderBy(F.desc(measure) if largest else F.asc(measure), "year")
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def sensitivity(rise: float) -> Column:
    """By how many percent revenue must grow to keep its margin when cost rises by a share, with the margin as it is."""
    margin = F.try_divide(F.col("revenue") - F.col("cost"), F.col("revenue"))
    return F.try_divide(F.lit(rise) * F.col("cost"), F.col("revenue") * (1 - margin)) * 100
