"""Rules on questions, plans and literals; questions are made from customers, plans from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.text import bare_tickers, explicit_tickers, words
from tabularium.operators import guards, search, selection
from tabularium.queries import selection as contexts
from tabularium.queries.search import _LEXICAL, PAYLOADS, _best, _rank
from tabularium.sources.payloads import lines, payloads, read

QUESTIONS = ("so sánh doanh thu hai công ty", "năm nào doanh thu cao nhất", "doanh thu là bao nhiêu", "trung bình trong giai đoạn", "chênh lệch lợi nhuận", "tỷ lệ chi phí là bao nhiêu phần trăm", "tăng trưởng doanh thu")
FORMULAS = ("df_1 / df_2", "df_1 / df_2 * 100", "(df_1 - df_2) / df_2 * 100", "round(df_1)", "df_1 # placeholder", "df_1 # Giả sử", "0 # defaults to 0", "df_2 # Không có dữ liệu")


def _pick(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def semantic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.regexp_replace("n_name", "_", "")
    year = (2015 + F.col("c_custkey") % 11).cast("int")
    text = F.concat(F.lit("Doanh thu "), F.lower("c_mktsegment"), F.lit(" của CTCP "), code, F.lit(" ("), code, F.lit(") năm "), year.cast("string"), F.lit(" - "), (year + 1).cast("string"), F.lit(" theo báo cáo tài chính hợp nhất là bao nhiêu?"))
    return rows.select("c_custkey", guards.semantic_query(text, code).alias("query"))


def coverage_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("years"))
    return years.select("o_custkey", guards.coverage_lock(_pick(QUESTIONS, "o_custkey"), F.col("o_custkey") % 3, F.col("years")).alias("reasons"))


def question_op_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    return rows.select("c_custkey", guards.operation_problems(_pick(QUESTIONS, "c_custkey"), _pick(FORMULAS, "c_custkey")).alias("problems"))


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key k of each event's properties: as they are, within a code fence, or without their end."""
    props = F.col("props")
    text = F.when(F.col("event_id") % 3 == 0, props).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(F.concat(F.lit("```\n"), F.replace(props, F.lit("}"), F.lit(", oops"))))
    return read(spark, sf_dir, "events").select("event_id", guards.json_object(text, "k").alias("k"))


def selector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as literals, half of them with a fraction, against the quantities in their lines."""
    parts, sales = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    literal = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(""))
    cells = sales.select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("int").cast("string").alias("cell"))
    return guards.selector_status(parts.select("p_partkey", literal.alias("literal")), cells, "p_partkey")


def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question names two sources and three or four years; of its ten best tables every third is not used."""
    best = _best(spark, sf_dir, 10).join(payloads(spark, sf_dir).select("table_id", "year"), "table_id")
    tables = best.groupBy("question_id").agg(F.collect_list(F.struct("ticker", "year", (F.col("rank") % 3 != 0).alias("used"))).alias("tables"))
    k = F.col("item_id")
    name = lambda n: F.concat(F.lit("src"), ((k + n) % 20).cast("string"))
    text = F.concat(F.lit("So sánh "), F.upper(name(0)), F.lit(" với ("), name(7), F.lit("), năm "), F.concat_ws(", ", *((2015 + (k + n) % 11).cast("string") for n in (0, 2, 4))), F.lit(" và 12020"))
    asked = read(spark, sf_dir, "benchmark").select(k.alias("question_id"), F.when(k % 4 == 0, F.concat(F.lit("năm "), F.concat_ws("-", *((2015 + (k + n) % 11).cast("string") for n in range(8))))).otherwise(text).alias("question"))
    return asked.join(tables, "question_id").select("question_id", guards.context_gaps(F.col("question"), F.col("tables")).alias("problem"))


def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's answer is a list of scores by position; each meets the candidate at that position."""
    best = _best(spark, sf_dir, 20)
    answers = best.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "table_id"))), lambda x: (x["table_id"] * 7919 % 1000) / 1000).alias("scores"))
    scores = answers.select("question_id", F.posexplode("scores").alias("position", "rerank_score")).select("question_id", (F.col("position") + 1).alias("rank"), "rerank_score")
    joined = best.select("question_id", "rank", "table_id").join(scores, ["question_id", "rank"])
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), "rank")
    return joined.select("question_id", "table_id", F.round("rerank_score", 6).alias("rerank_score"), F.row_number().over(order).cast("long").alias("rerank_rank"))


def planning_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner sees of each table: alias, metadata, size and first title."""
    about = payloads(spark, sf_dir).select("table_id", "year", "report_type", "table_type")
    tables, context = contexts.load_tables(spark, sf_dir), contexts.table_context(spark, sf_dir)
    out = tables.join(about, "table_id").join(context, "table_id", "left")
    return out.select("table_id", "alias", "ticker", "year", "report_type", "table_type", "row_count", F.element_at(F.split("titles", r"\|"), 1).alias("title"))


def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned rows (number table_id % 12 of each table) that exist, that are beyond the table, and that are blank."""
    held = lines(spark, sf_dir).groupBy("table_id").agg(F.max("row_position").alias("last"))
    planned = payloads(spark, sf_dir).select("table_id", (F.col("table_id") % 12).cast("int").alias("row_position"))
    real = lines(spark, sf_dir).select("table_id", "row_position", F.lit(True).alias("real"))
    rows = planned.join(held, "table_id", "left").join(real, ["table_id", "row_position"], "left")
    status = F.when(F.col("real"), "ok").when(F.col("last").isNull() | (F.col("row_position") > F.col("last")), "out of range").otherwise("blank")
    return rows.select("table_id", F.col("row_position").cast("long").alias("row_position"), status.alias("status"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of customers that name codes of nations in several ways: c_custkey, question."""
    code = lambda k: F.concat(F.lit("NAT"), k.cast("string"))
    a, b = code(F.col("c_nationkey")), code(F.col("c_custkey") % 25)
    kinds = (
        F.concat(F.lit("Doanh thu của ("), a, F.lit(") năm 2020")),
        F.concat(F.lit("mã cổ phiếu "), F.lower(a), F.lit(" tăng")),
        F.concat(a, F.lit(" và "), F.lower(b), F.lit(" so với x"), b),
        F.concat(F.lit("Mã "), a, F.lit(".")),
        F.concat(F.lit("so sánh "), a, F.lit(","), b, F.lit(" (2020) 12 ABC")),
        F.concat(F.lit("không mã nào: "), a, F.lit("é, NAT123456789 "), F.lower(b)),
    )
    text = kinds[-1]
    for k, kind in enumerate(kinds[:-1]):
        text = F.when(F.col("c_custkey") % len(kinds) == k, kind).otherwise(text)
    return read(spark, sf_dir, "customer").select("c_custkey", text.alias("question"))


def _found_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, ticker, explicit): the known codes of each question."""
    rows = _mentions(spark, sf_dir).select("c_custkey", explicit_tickers(F.col("question")).alias("e"), bare_tickers(F.col("question")).alias("b"))
    each = rows.select("c_custkey", F.explode(F.array_union("e", "b")).alias("ticker"), "e").select("c_custkey", "ticker", F.array_contains("e", F.col("ticker")).alias("explicit"))
    known = read(spark, sf_dir, "nation").select(F.concat(F.lit("NAT"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return each.join(known, "ticker")


def ticker_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that questions name, in brackets or behind the word for a code (explicit), or in capitals."""
    return _found_tickers(spark, sf_dir).select("c_custkey", "ticker", F.when(F.col("explicit"), "explicit_ticker").otherwise("exact_ticker").alias("match_type"))


def entity_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the nations that its question could mean.

    Nations of the region of one that is named collide with it. Nations whose number begins like that of one that is named
    are its fuzzy matches; for every ninth customer all others are as well, so that lists are cut.
    """
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity"), "n_regionkey")
    found = _found_tickers(spark, sf_dir)
    sure = found.select("c_custkey", F.col("nation").alias("entity"), F.when(F.col("explicit"), "explicit_ticker").otherwise("exact_ticker").alias("match_type"), F.lit(1.0).alias("score"), F.col("ticker").alias("matched_text"))
    near = found.join(nation, (F.col("region") == F.col("n_regionkey")) & (F.col("nation") != F.col("entity"))).select("c_custkey", "entity", F.lit("collision").alias("match_type"), F.lit(1.0).alias("score"), F.col("ticker").alias("matched_text"))
    alike = F.expr("substring(cast(entity as string), 1, 1) = substring(cast(nation as string), 1, 1) or c_custkey % 9 = 0")
    fuzzy = found.join(F.broadcast(nation), alike).select("c_custkey", "entity", F.lit("fuzzy_company_name").alias("match_type"), (F.lit(0.8) + (F.col("entity") % 4) / 100).alias("score"), F.concat("ticker", F.lit("-"), (F.col("entity") % 3).cast("string")).alias("matched_text"))
    matches = sure.unionByName(near).unionByName(fuzzy).withColumnRenamed("c_custkey", "question_id")
    out = selection.shortlisted(matches)
    return out.select(F.col("question_id").alias("c_custkey"), F.col("position").cast("long").alias("n"), F.col("entity").cast("long").alias("nation"), "match_type", "status")


def filter_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that a planner might give for each customer, held to a list of twelve nations."""
    k = F.col("c_custkey")
    key = lambda n: F.format_string("c%02d", n)
    keys = F.array_compact(F.array(F.when(k % 13 != 0, key(k % 7 + 1)), F.when(k % 13 != 0, key(k % 5 + 2)), F.when(k % 11 == 0, key(F.lit(99).cast("long")))))
    kinds = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in (("aggregated",), (), ("separate", "consolidated"), ("consolidated",), ("annual",))))
    years = F.when(k % 17 == 0, F.array().cast("array<bigint>")).otherwise(F.array(2014 + k % 13, 2014 + k % 13, F.lit(2019).cast("long")))
    answers = read(spark, sf_dir, "customer").select(k.alias("question_id"), keys.alias("keys"), years.alias("years"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("report_types"))
    place = (12 - F.col("n_nationkey")).cast("long")
    listed = read(spark, sf_dir, "nation").where("n_nationkey < 12").select(key(place).alias("key"), place.alias("position"), F.col("n_name").alias("ticker"))
    shortlist = answers.select("question_id").join(F.broadcast(listed), F.lit(True))  # twelve for each
    return guards.chosen_filters(answers, shortlist)


def entity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with their third character left out, within a sentence, against all names."""
    names = read(spark, sf_dir, "part").select(selection.match_text(F.col("p_name")).alias("alias")).distinct()
    asked = names.select(F.col("alias").alias("question_id"), words(F.concat(F.lit("stock of "), F.substring("alias", 1, 2), F.expr("substring(alias, 4)"), F.lit(" this year"))).alias("words"))
    return guards.best_windows(asked, names, 5).select(F.col("question_id").alias("asked"), "alias", "score", "matched_text")


QUERIES = {f.__name__: f for f in (semantic_query, coverage_lock, question_op_rules, json_repair, selector_check, context_coverage, rerank_apply, planning_inventory, plan_coverage, ticker_mentions, entity_shortlist, filter_validate, entity_fuzzy)}

_LINES = contexts._LINES
_FOUND = r"""asked AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Doanh thu của (' || a || ') năm 2020' WHEN 1 THEN 'mã cổ phiếu ' || lower(a) || ' tăng' WHEN 2 THEN a || ' và ' || lower(b) || ' so với x' || b WHEN 3 THEN 'Mã ' || a || '.'
  WHEN 4 THEN 'so sánh ' || a || ',' || b || ' (2020) 12 ABC' ELSE 'không mã nào: ' || a || 'é, NAT123456789 ' || lower(b) END AS question FROM (SELECT c_custkey, 'NAT' || c_nationkey AS a, 'NAT' || c_custkey % 25 AS b FROM customer)),
 e AS (SELECT DISTINCT c_custkey, upper(unnest(regexp_extract_all(question, '(?i)(?:\(\s*|\bmã(?:\s+cổ\s+phiếu)?\s+)([A-Za-z0-9]+)(?:\s*\)|\b)', 1))) AS ticker FROM asked),
 w AS (SELECT DISTINCT c_custkey, unnest(regexp_extract_all(question, '[A-Za-z0-9]+')) AS ticker FROM asked),
 found AS (SELECT c_custkey, ticker, n_nationkey AS nation, n_regionkey AS region, bool_or(sure) AS explicit FROM (SELECT *, true AS sure FROM e UNION ALL SELECT *, false FROM w WHERE length(ticker) BETWEEN 2 AND 8 AND ticker = upper(ticker) AND ticker <> lower(ticker)) JOIN nation ON ticker = 'NAT' || n_nationkey GROUP BY ALL)"""
ORACLES = {
    "semantic_query": "SELECT c_custkey, 'Doanh thu ' || lower(c_mktsegment) AS query FROM customer",
    "coverage_lock": f"""SELECT o_custkey, array_to_string(list_filter([CASE WHEN o_custkey % 3 > 1 AND regexp_matches(q, 'so sánh|trung bình|chênh lệch') THEN 'multi_ticker' END, CASE WHEN years > 1 AND regexp_matches(q, 'năm nào|giai đoạn') THEN 'multi_year' END], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT o_custkey, {_pick_sql(QUESTIONS, 'o_custkey')} AS q, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY o_custkey)""",
    "question_op_rules": """SELECT c_custkey, array_to_string(list_filter([CASE WHEN q = 5 AND f = 0 THEN 'percent' END, CASE WHEN q = 4 AND f <> 2 THEN 'difference' END, CASE WHEN q = 6 AND f <> 2 THEN 'change' END, CASE WHEN f = 3 THEN 'rounding' END, CASE WHEN f >= 4 THEN 'placeholder' END], lambda x: x IS NOT NULL), ',') AS problems
 FROM (SELECT c_custkey, c_custkey % 7 AS q, c_custkey % 8 AS f FROM customer)""",
    "json_repair": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "selector_check": """WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '' END AS literal, p_size FROM part)
 SELECT p_partkey, literal, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND CAST(l_quantity AS INTEGER) = p_size) THEN 'missing' WHEN p_partkey % 2 = 0 THEN 'numeric' ELSE 'exact' END AS status FROM p""",
    "context_coverage": f"""WITH {_LEXICAL}, t AS (SELECT question_id, l.ticker, CAST(year AS VARCHAR) AS y, rank % 3 <> 0 AS used FROM {_rank('lexical')} l JOIN {PAYLOADS} p USING (table_id) WHERE rank <= 10),
 q AS (SELECT item_id AS question_id, CASE WHEN item_id % 4 = 0 THEN [] ELSE ['src' || item_id % 20, 'src' || (item_id + 7) % 20] END AS tickers, [CAST(2015 + (item_id + n) % 11 AS VARCHAR) for n in CASE WHEN item_id % 4 = 0 THEN range(8) ELSE [0, 2, 4] END] AS years FROM benchmark),
 g AS (SELECT question_id, list_sort(list_filter(list_distinct(list(ticker)), lambda x: list_contains(any_value(tickers), x) AND NOT list_contains(coalesce(list(ticker) FILTER (used), []), x))) AS no_ticker, list_filter(list_distinct(list(y)), lambda x: list_contains(any_value(years), x)) AS asked, coalesce(list(y) FILTER (used), []) AS seen FROM t JOIN q USING (question_id) GROUP BY question_id)
 SELECT question_id, CASE WHEN len(no_ticker) > 0 THEN 'tickers ' || array_to_string(no_ticker, ',') WHEN len(asked) >= 3 AND len(list_filter(asked, lambda x: NOT list_contains(seen, x))) > 0 THEN 'years ' || array_to_string(list_sort(list_filter(asked, lambda x: NOT list_contains(seen, x))), ',') ELSE '' END AS problem FROM g""",
    "rerank_apply": f"WITH {_LEXICAL}, b AS (SELECT question_id, table_id, rank, (table_id * 7919 % 1000)::DOUBLE / 1000 AS s FROM {_rank('lexical')} WHERE rank <= 20) SELECT question_id, table_id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, rank) AS rerank_rank FROM b",
    "planning_inventory": rf"""WITH {_LINES}, c AS (SELECT table_id, count(*) AS row_count, arg_min(substring(trim(regexp_replace(label, '[ \t\n\r\f\x0b]+', ' ', 'g')), 1, 160), row_position) AS title FROM lines GROUP BY table_id)
 SELECT table_id, 'df_' || row_number() OVER (PARTITION BY ticker ORDER BY table_id) AS alias, ticker, year, report_type, table_type, row_count, string_split(title, '|')[1] AS title FROM c JOIN {PAYLOADS} p USING (table_id)""",
    "plan_coverage": f"""WITH {_LINES}, h AS (SELECT table_id, max(row_position) AS last, list(row_position) AS all_rows FROM lines GROUP BY table_id)
 SELECT doc_id AS table_id, doc_id % 12 AS row_position, CASE WHEN list_contains(all_rows, doc_id % 12) THEN 'ok' WHEN last IS NULL OR doc_id % 12 > last THEN 'out of range' ELSE 'blank' END AS status FROM documents LEFT JOIN h ON table_id = doc_id""",
    "ticker_mentions": f"WITH {_FOUND} SELECT c_custkey, ticker, CASE WHEN explicit THEN 'explicit_ticker' ELSE 'exact_ticker' END AS match_type FROM found",
    "filter_validate": """WITH a AS (SELECT c_custkey AS k, list_filter([CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 7 + 1 END, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 5 + 2 END, CASE WHEN c_custkey % 11 = 0 THEN 99 END], lambda x: x IS NOT NULL) AS keys,
  CASE WHEN c_custkey % 17 = 0 THEN [] ELSE [2014 + c_custkey % 13, 2014 + c_custkey % 13, 2019] END AS years FROM customer)
 SELECT k AS question_id, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) FROM nation WHERE list_contains(a.keys, 12 - n_nationkey)), '') AS tickers, CASE WHEN len(years) = 0 THEN '' WHEN years[1] = 2019 THEN '2019' ELSE years[1] || ',2019' END AS years,
  CASE WHEN len(keys) = 0 THEN 'no key' WHEN len(list_distinct(keys)) < len(keys) THEN 'repeated key' WHEN list_contains(keys, 99) THEN 'unknown key' WHEN len(years) = 0 THEN 'no year' WHEN years[1] < 2015 OR years[1] > 2025 THEN 'year' WHEN k % 5 IN (1, 2, 4) THEN 'report type' END AS problem FROM a""",
    "entity_shortlist": f"""WITH {_FOUND}, every AS (SELECT c_custkey, nation AS entity, CASE WHEN explicit THEN 0 ELSE 1 END AS p, 1.0::DOUBLE AS score, ticker AS t FROM found
  UNION ALL SELECT c_custkey, n_nationkey, 4, 1.0::DOUBLE, ticker FROM found JOIN nation ON n_regionkey = region AND n_nationkey <> nation
  UNION ALL SELECT c_custkey, n_nationkey, 5, 0.8::DOUBLE + (n_nationkey % 4)::DOUBLE / 100, ticker || '-' || n_nationkey % 3 FROM found, nation WHERE CAST(n_nationkey AS VARCHAR)[1] = CAST(nation AS VARCHAR)[1] OR c_custkey % 9 = 0),
 own AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p, score DESC, length(t) DESC, entity, t) AS o FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, entity ORDER BY p, score DESC, length(t) DESC, entity, t) AS i FROM every) WHERE i = 1),
 c AS (SELECT c_custkey, count(*) FILTER (p < 5) AS n_sure, count(*) FILTER (p < 4) AS n_exact FROM own GROUP BY c_custkey),
 f AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, t ORDER BY o) AS turn, min(o) OVER (PARTITION BY c_custkey, t) AS g FROM own WHERE p = 5),
 r AS (SELECT c_custkey, entity, p, row_number() OVER (PARTITION BY c_custkey ORDER BY o) AS n FROM own WHERE p < 5 UNION ALL SELECT c_custkey, entity, p, n_sure + row_number() OVER (PARTITION BY c_custkey ORDER BY turn, g) FROM f JOIN c USING (c_custkey))
 SELECT c_custkey, n, CAST(entity AS BIGINT) AS nation, ['explicit_ticker', 'exact_ticker', '', '', 'collision', 'fuzzy_company_name'][p + 1] AS match_type, CASE WHEN n_exact > 15 THEN 'too many' ELSE 'ok' END AS status FROM r JOIN c USING (c_custkey) WHERE n <= 15""",
}
