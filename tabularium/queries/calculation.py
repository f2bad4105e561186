"""Calculations over statements per nation and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.text import is_number, known_scale, raw_scale, unit_factor
from tabularium.operators import guards
from tabularium.plans import calculations as calc
from tabularium.sources.payloads import read

def stmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calc.statements(*(read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation")))


STMT = """per_order AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS r, sum(l_extendedprice * l_tax) AS c, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
stmt AS (SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(r), 4) AS revenue, round(sum(c), 4) AS cost, round(sum(q), 4) AS quantity, round(sum(o_totalprice), 4) AS balance
  FROM per_order JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_LAG = "CASE WHEN lag(year) OVER w = year - 1 THEN lag({0}) OVER w END"
_W = "WINDOW w AS (PARTITION BY entity ORDER BY year)"
MARGIN = "((revenue - cost) / nullif(revenue, 0) * 100)"

_FORMS: dict[str, tuple] = {
    "calc_lookup": (lambda s: s.select("entity", "year", F.round(F.col("revenue") / 1e6, 6).alias("value")), "SELECT entity, year, round(revenue / 1e6, 6) AS value FROM stmt"),
    "calc_ratio": (lambda s: s.select("entity", "year", F.round(F.try_divide("cost", "revenue") * 100, 6).alias("value")), "SELECT entity, year, round(cost / nullif(revenue, 0) * 100, 6) AS value FROM stmt"),
    "calc_growth": (lambda s: s.select("entity", "year", F.round(calc.growth(F.col("revenue")), 6).alias("value")), f"SELECT entity, year, round((revenue - {_LAG.format('revenue')}) / nullif({_LAG.format('revenue')}, 0) * 100, 6) AS value FROM stmt {_W}"),
    "calc_difference": (lambda s: s.select("entity", "year", F.round(F.col("revenue") - calc.previous(F.col("revenue")), 4).alias("value")), f"SELECT entity, year, round(revenue - {_LAG.format('revenue')}, 4) AS value FROM stmt {_W}"),
    "calc_sum": (lambda s: s.where("year between 1996 and 1999").groupBy("entity").agg(F.round(F.sum("revenue"), 4).alias("value")), "SELECT entity, round(sum(revenue), 4) AS value FROM stmt WHERE year BETWEEN 1996 AND 1999 GROUP BY entity"),
    "calc_mean": (lambda s: s.groupBy("year").agg(F.round(calc.mean("revenue"), 6).alias("value"), F.count(F.lit(1)).alias("n")), "SELECT year, round(CAST(sum(CAST(revenue AS DECIMAL(20, 4))) AS DOUBLE) / count(*), 6) AS value, count(*) AS n FROM stmt GROUP BY year"),
    "calc_extreme": (lambda s: s.groupBy("entity").agg(F.max("revenue").alias("largest"), F.min("revenue").alias("smallest")), "SELECT entity, max(revenue) AS largest, min(revenue) AS smallest FROM stmt GROUP BY entity"),
    "calc_argmax": (lambda s: calc.best_year(s, "revenue").select("entity", F.col("year").cast("double").alias("value")), "SELECT entity, CAST(year AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY revenue DESC, year) AS n FROM stmt) WHERE n = 1"),
    "calc_argmax_lookup": (lambda s: calc.best_year(s, "revenue").select("entity", "year", F.round(F.col("cost") / 1e6, 6).alias("value")), "SELECT entity, year, round(cost / 1e6, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY revenue DESC, year) AS n FROM stmt) WHERE n = 1"),
    "calc_next_period": (lambda s: calc.best_year(s.withColumn("next", calc.following(F.col("cost"))), "revenue", largest=False).select("entity", "year", F.round("next", 4).alias("value")), f"SELECT entity, year, round(nxt, 4) AS value FROM (SELECT *, CASE WHEN lead(year) OVER w = year + 1 THEN lead(cost) OVER w END AS nxt, row_number() OVER (PARTITION BY entity ORDER BY revenue, year) AS n FROM stmt {_W}) WHERE n = 1"),
    "calc_filtered_agg": (lambda s: s.where(calc.RATIOS["cost_share"]() < 4.2).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("revenue"), 4).alias("value")), "SELECT year, count(*) AS n, round(sum(revenue), 4) AS value FROM stmt WHERE cost / nullif(revenue, 0) * 100 < 4.2 GROUP BY year"),
    "calc_forall": (lambda s: s.where("year < 2001").groupBy("entity").agg(F.bool_and(F.col("revenue") > 100_000).alias("every"), F.count(F.lit(1)).alias("n")), "SELECT entity, bool_and(revenue > 100000) AS every, count(*) AS n FROM stmt WHERE year < 2001 GROUP BY entity"),
    "calc_count_if": (lambda s: s.groupBy("year").agg(F.count_if(F.col("revenue") > 1_000_000).cast("long").alias("n")), "SELECT year, count(*) FILTER (revenue > 1000000) AS n FROM stmt GROUP BY year"),
    "calc_median_filter": (lambda s: s.join(s.groupBy("year").agg(F.median("revenue").alias("m")), "year").where("revenue > m").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(calc.mean("cost"), 6).alias("value")), "SELECT year, count(*) AS n, round(CAST(sum(CAST(cost AS DECIMAL(20, 4))) AS DOUBLE) / count(*), 6) AS value FROM stmt JOIN (SELECT year, median(revenue) AS m FROM stmt GROUP BY year) USING (year) WHERE revenue > m GROUP BY year"),
    "calc_margin_pp": (lambda s: s.select("entity", "year", F.round(calc.RATIOS["margin"]() - calc.previous(calc.RATIOS["margin"]()), 6).alias("value")), f"SELECT entity, year, round({MARGIN} - {_LAG.format(MARGIN)}, 6) AS value FROM stmt {_W}"),
    "calc_sensitivity": (lambda s: s.select("entity", "year", F.round(calc.sensitivity(0.1), 6).alias("value")), "SELECT entity, year, round(0.1::DOUBLE * cost / nullif(revenue * (1 - (revenue - cost) / nullif(revenue, 0)), 0) * 100, 6) AS value FROM stmt"),
    "calc_avg_balance": (lambda s: s.select("entity", "year", F.round(F.try_divide(F.col("revenue"), calc.average_of_two(F.col("balance"))), 6).alias("value")), f"SELECT entity, year, round(revenue / nullif((balance + {_LAG.format('balance')}) / 2, 0), 6) AS value FROM stmt {_W}"),
    "calc_ratio_library": (lambda s: s.select("entity", "year", *(F.round(r(), 6).alias(n) for n, r in calc.RATIOS.items())), f"SELECT entity, year, round({MARGIN}, 6) AS margin, round(cost / nullif(revenue, 0) * 100, 6) AS cost_share, round(revenue / nullif(balance, 0), 6) AS turnover, round((balance - cost) / nullif(cost, 0), 6) AS coverage, round(revenue / nullif(quantity, 0), 6) AS unit_price FROM stmt"),
}


def _query(form):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: form(stmt(spark, sf_dir))


def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of each customer's stored order values, and the factor that a question about them asks for."""
    orders = read(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, ("bao nhiêu triệu đồng", "bao nhiêu tỷ đồng", "bao nhiêu trăm tỷ đồng", "bao nhiêu nghìn đồng")))
    largest = orders.groupBy("o_custkey").agg(F.max(F.abs("o_totalprice") * 30_000).alias("largest"))
    asked = largest.withColumn("question", F.element_at(names, (F.col("o_custkey") % 4 + 1).cast("int")))
    stored, factor = raw_scale(F.col("largest")), unit_factor(F.col("question"))
    return asked.select("o_custkey", stored.alias("stored"), factor.alias("factor"), F.try_divide(factor, stored).alias("divisor"))


def answer_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are no finite numbers are refused: the value of each event over its distance to the hour."""
    value = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 15 == 0, F.lit(float("-inf"))).otherwise(F.try_divide("value", F.minute("ts")))
    return read(spark, sf_dir, "events").select("event_id", value.alias("x")).select("event_id", is_number(F.col("x")).alias("accepted"), F.when(is_number(F.col("x")), F.col("x")).alias("answer"))


#: Formulas that bring stored values to a unit, or should.
SCALED = ("df_1 / 1e6", "df_1 * 0.000001", "(df_1 + df_2) / 1000", "df_1 / 1000000000", "df_1", "df_1 * 1e3 / 1e5", "df_1/100000")


def scale_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas for the questions of unit_scale(), held to the factor that they should divide by."""
    formula = F.element_at(F.array(*map(F.lit, SCALED)), (F.col("o_custkey") % len(SCALED) + 1).cast("int"))
    return unit_scale(spark, sf_dir).select("o_custkey", guards.scale_problem(F.col("divisor"), formula).alias("problem"))


def scale_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors near known scales, or one over them, that each order might be multiplied by."""
    k = F.col("o_orderkey")
    factors = F.array(*(F.lit(x) for x in (1e3, 1e5, 1e6, 1e9, 1e11, 1e12, 1e4, -1e6, 0.0)))
    factor = F.element_at(factors, (k % 9 + 1).cast("int")) * F.element_at(F.array(*(F.lit(x) for x in (1.0, 1.000009, 0.999992, 1.00002))), (k % 4 + 1).cast("int"))
    value = F.when(k % 5 == 0, F.try_divide(F.lit(1.0), factor)).when(k % 7 == 0, F.col("o_totalprice").cast("double")).otherwise(factor)
    found = known_scale(F.col("value"))
    return read(spark, sf_dir, "orders").select("o_orderkey", value.alias("value")).select("o_orderkey", found["scale"].alias("scale"), found["reciprocal"].alias("reciprocal"))


QUERIES = {name: _query(form) for name, (form, _) in _FORMS.items()} | {"unit_scale": unit_scale, "scale_check": scale_check, "scale_match": scale_match, "answer_guard": answer_guard}
_UNIT_SCALE = """SELECT o_custkey, stored, factor, factor / stored AS divisor FROM (SELECT o_custkey, CASE WHEN largest >= 1e10 THEN 1.0::DOUBLE WHEN largest <= 1e9 THEN 1e6::DOUBLE END AS stored,
 CASE o_custkey % 4 WHEN 0 THEN 1e6::DOUBLE WHEN 1 THEN 1e9::DOUBLE WHEN 2 THEN 1e11::DOUBLE END AS factor FROM (SELECT o_custkey, max(abs(o_totalprice) * 30000) AS largest FROM orders GROUP BY o_custkey))"""
ORACLES = {name: f"WITH {STMT} {sql}" for name, (_, sql) in _FORMS.items()} | {
    "unit_scale": _UNIT_SCALE,
    "scale_check": f"SELECT o_custkey, CASE WHEN divisor IS NULL OR divisor = 1 OR list_contains([[1e6], [1e6], [1e3], [1e9], [], [1e-3, 1e5], [1e5]][o_custkey % 7 + 1], divisor) THEN '' ELSE 'scale' END AS problem FROM ({_UNIT_SCALE})",
    "scale_match": """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1 / nullif(f, 0) WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice AS DOUBLE) ELSE f END AS x FROM (SELECT o_orderkey, o_totalprice, [1e3, 1e5, 1e6, 1e9, 1e11, 1e12, 1e4, -1e6, 0.0][o_orderkey % 9 + 1]::DOUBLE * [1.0, 1.000009, 0.999992, 1.00002][o_orderkey % 4 + 1]::DOUBLE AS f FROM orders)),
 m AS (SELECT o_orderkey, s, r FROM v, (SELECT unnest([1e3, 1e5, 1e6, 1e9, 1e11, 1e12])::DOUBLE AS s), (SELECT unnest([false, true]) AS r) WHERE x > 0 AND abs(x - CASE WHEN r THEN 1 / s ELSE s END) <= 1e-5::DOUBLE * greatest(x, CASE WHEN r THEN 1 / s ELSE s END))
 SELECT o_orderkey, s AS scale, r AS reciprocal FROM orders LEFT JOIN m USING (o_orderkey)""",
    "answer_guard": """SELECT event_id, event_id % 10 <> 0 AND event_id % 15 <> 0 AND minute(ts) <> 0 AND value IS NOT NULL AS accepted, CASE WHEN event_id % 10 <> 0 AND event_id % 15 <> 0 AND minute(ts) <> 0 THEN value / minute(ts) END AS answer FROM events""",
}
