"""Shortlists of companies, from the questions' own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import guards, routing
from tabularium.sources.payloads import read


def _names(key: Column) -> tuple[Column, Column]:
    """Two words of a supplier's name: three suppliers share the first."""
    word = lambda letter, k: F.concat(F.lit(letter), F.substring(F.md5(F.concat(F.lit(letter), k.cast("string"))), 1, 7))
    return word("a", F.floor(key / 3)), word("b", key)


def _own_names(key: Column) -> tuple[Column, Column]:
    """As _names(), but no two keys below 2 ** 28 share a word that they shouldn't: seven digits of a hash do clash among thousands of names."""
    digits = lambda k: F.lower(F.lpad(F.hex(F.pmod(F.pmod(k.cast("long"), F.lit(1 << 28)) * 0x9E3779B, F.lit(1 << 28))), 7, "0"))
    return F.concat(F.lit("a"), digits(F.floor(key / 3))), F.concat(F.lit("b"), digits(key))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies (ticker, company); every other name begins with a form of company."""
    key = F.col("s_suppkey")
    name = F.concat_ws(" ", *_own_names(key))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), key.cast("string")).alias("ticker"), F.when(key % 2 == 0, F.concat(F.lit("CTCP "), name)).otherwise(name).alias("company"))


def question_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' questions that name suppliers by code, by name with and without its form, with a letter left out, or not at all."""
    n = read(spark, sf_dir, "supplier").count()
    k = F.col("c_custkey") % n
    (a, b), (a2, b2) = _own_names(k), _own_names((k + 5) % n)
    code = lambda x: F.concat(F.lit("T"), x.cast("string"))
    join = lambda *x: F.concat_ws(" ", *(F.lit(w) if isinstance(w, str) else w for w in x))
    kinds = (
        F.concat(F.lit("Doanh thu của ("), code(k), F.lit(") năm 2020")),
        join(code(k), "và so với", F.lower(code(k))),
        join("doanh thu của CTCP", F.upper(a), b, "năm nay"),
        F.concat(F.lit("lợi nhuận "), a, F.lit(" - "), b, F.lit(", quý 1")),
        F.concat(F.lit("lợi nhuận "), a, F.lit(" "), F.substring(b, 1, 2), F.substring(b, 4, 9), F.lit(" năm")),
        F.lit("không nêu tên"),
        F.concat(F.lit("của "), a, F.lit("  "), b, F.lit(" và mã "), code((k + 1) % n)),
        join("so sánh", a, b, "với", a2, b2),
    )
    text = F.element_at(F.array(*kinds), (F.col("c_custkey") % 8 + 1).cast("int"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), text.alias("question"))
    out = routing.shortlist(asked, catalogue(spark, sf_dir))
    return out.select("question_id", F.col("position").cast("long").alias("position"), "entity", "match_type", "status")


#: Questions with one or two companies: {a}, {b} are codes, {A}, {B} names, {y} a year and {z} the next.
ASKED = (
    "So sánh doanh thu của {a} và {b} từ năm {y} đến {z} theo báo cáo hợp nhất là bao nhiêu?",
    "Lợi nhuận của CTCP {A} ({a}) và Ngân hàng TMCP {B} năm {y}–{z} bằng bao nhiêu",
    "Tổng công ty {A}, tập đoàn {B}: nợ phải trả năm{y}, 1{y} và {y}",
    "{a} {a},{b} x{a} {b}9 doanh thu thuần riêng của",
    "{a} năm {y}?",
    "công ty cổ phần {A} có vốn chủ sở hữu trong năm {z} tại",
    "- {B} - {b}: Bao nhiêu công ty con của công ty {A} ()",
    "chi phí {A}{B} tới {y} tới {z} theo báo cáo tài chính riêng của {a}",
)


def question_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' questions that name two suppliers by code and by name, without what search doesn't need; every third question's companies have no aliases."""
    n = read(spark, sf_dir, "supplier").count()
    key = F.col("c_custkey")
    k, other = key % n, (key * 7 + 3) % n
    code = lambda x: F.concat(F.lit("T"), x.cast("string"))
    name = lambda x: F.concat_ws(" ", *_names(x))
    text = F.element_at(F.array(*map(F.lit, ASKED)), (key % len(ASKED) + 1).cast("int"))
    year = 2015 + key % 9
    for mark, value in (("a", F.when(key % 2 == 0, F.lower(code(k))).otherwise(code(k))), ("b", code(other)), ("A", F.when(key % 5 == 0, F.upper(name(k))).otherwise(name(k))), ("B", name(other)), ("y", year.cast("string")), ("z", (year + 1).cast("string"))):
        text = F.replace(text, F.lit("{" + mark + "}"), value)
    company = lambda x: F.struct(code(x).alias("ticker"), F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("CTCP "), name(x)), name(x))).alias("aliases"))
    return read(spark, sf_dir, "customer").select("c_custkey", guards.rewritten_question(text, F.array(company(k), company(other))).alias("query"))


def _without_sql(text: str, pattern: str, edge: str = "") -> str:
    """Two rounds, for what stands between two matches is an edge of both."""
    if not edge:
        return f"regexp_replace({text}, {pattern}, ' ', 'gi')"
    once = lambda x: f"regexp_replace({x}, '(^|{edge})(?:' || {pattern} || ')($|{edge})', '\\1 \\2', 'gi')"
    return once(once(text))


def _rewrite_sql() -> str:
    """The rule in steps t0, t1, ..., each a regular expression without looking around."""
    ascii_, digit, letter = "[^A-Za-z0-9]", "[^0-9]", "[^\\p{L}\\p{N}_]"
    literal = lambda x: f"regexp_replace({{}}, regexp_escape({x}), ' ', 'gi')"
    steps = [lambda t: _without_sql(t, "'T' || k", ascii_)]
    steps += [lambda t: f"CASE WHEN aliases THEN {literal('na').format(literal(chr(39) + 'CTCP ' + chr(39) + ' || na').format(t))} ELSE {t} END", lambda t: _without_sql(t, "'T' || o", ascii_)]
    steps += [lambda t: f"CASE WHEN aliases THEN {literal('nb').format(literal(chr(39) + 'CTCP ' + chr(39) + ' || nb').format(t))} ELSE {t} END"]
    steps += [lambda t: _without_sql(t, "'20[0-9]{2}\\s*(?:[-–—]|đến|tới)\\s*(?:năm\\s+)?20[0-9]{2}'", digit), lambda t: _without_sql(t, "'20[0-9]{2}'", digit)]
    steps += [lambda t, p=p: _without_sql(t, f"'{p}'") for p in guards.SCOPES]
    steps += [lambda t: f"CASE WHEN aliases THEN {_without_sql(t, chr(39) + '|'.join(guards.KINDS_OF_COMPANY) + chr(39), letter)} ELSE {t} END"]
    steps += [lambda t: _without_sql(t, "'là\\s+bao\\s+nhiêu|bao\\s+nhiêu'", letter), lambda t: _without_sql(t, "'của|năm'", letter), lambda t: _without_sql(t, "'\\(\\s*\\)'")]
    steps += [lambda t: f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ,.;:-–—?')", lambda t: f"regexp_replace({t}, '(?:\\s+(?:{'|'.join(guards.TRAILING)}))+\\s*$', '', 'i')", lambda t: f"nullif(trim({t}), '')"]
    out = ""
    for n, step in enumerate(steps):
        out += f", t{n + 1} AS (SELECT * EXCLUDE (t), {step('t')} AS t FROM t{n})"
    return out + f" SELECT c_custkey, t AS query FROM t{len(steps)}"


QUERIES = {"question_shortlist": question_shortlist, "question_rewrite": question_rewrite}

ORACLES = {
    "question_shortlist": """WITH n AS (SELECT count(*) AS n FROM supplier), q AS (SELECT c_custkey AS id, c_custkey % 8 AS kind, c_custkey % n AS k, n FROM customer, n),
s AS (SELECT id, k, 0 AS p, 1.0 AS score, 0 AS words, length('T' || k) AS size FROM q WHERE kind = 0 UNION ALL SELECT id, k, 1, 1.0, 0, length('T' || k) FROM q WHERE kind = 1
 UNION ALL SELECT id, k, 2, 1.0, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END, CASE WHEN k % 2 = 0 THEN 22 ELSE 17 END FROM q WHERE kind = 2
 UNION ALL SELECT id, k, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END, 1.0, 2, 17 FROM q WHERE kind IN (3, 6, 7) UNION ALL SELECT id, (k + 5) % n, CASE WHEN (k + 5) % n % 2 = 0 THEN 3 ELSE 2 END, 1.0, 2, 17 FROM q WHERE kind = 7
 UNION ALL SELECT id, (k + 1) % n, 0, 1.0, 0, length('T' || (k + 1) % n) FROM q WHERE kind = 6 UNION ALL SELECT id, k, 5, 0.8, 2, 16 FROM q WHERE kind = 4),
c AS (SELECT * FROM s UNION ALL SELECT id, s_suppkey, 4, score, 0, size FROM s JOIN supplier ON s_suppkey // 3 = k // 3 AND s_suppkey <> k WHERE words = 2),
o AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY p, score DESC, size DESC) AS r FROM c)
SELECT id AS question_id, row_number() OVER (PARTITION BY id ORDER BY p, score DESC, size DESC, 'T' || k) AS position, 'T' || k AS entity, ['explicit_ticker', 'exact_ticker', 'exact_alias', 'normalized_alias', 'collision', 'fuzzy_company_name'][p + 1] AS match_type, 'ok' AS status FROM o WHERE r = 1
UNION ALL SELECT id, NULL, NULL, NULL, 'none' FROM q WHERE kind = 5""",
}
_NAME = lambda x: f"'a' || substr(md5('a' || ({x}) // 3), 1, 7) || ' b' || substr(md5('b' || {x}), 1, 7)"
_ASKED_SQL = "[" + ", ".join(f"'{q}'" for q in ASKED) + f"][c_custkey % {len(ASKED)} + 1]"
for _mark, _value in (("a", "CASE WHEN c_custkey % 2 = 0 THEN 't' ELSE 'T' END || k"), ("b", "'T' || o"), ("A", "CASE WHEN c_custkey % 5 = 0 THEN upper(na) ELSE na END"), ("B", "nb"), ("y", "CAST(y AS VARCHAR)"), ("z", "CAST(y + 1 AS VARCHAR)")):
    _ASKED_SQL = f"replace({_ASKED_SQL}, '{{{_mark}}}', {_value})"
ORACLES["question_rewrite"] = f"""WITH n AS (SELECT count(*) AS n FROM supplier), c AS (SELECT c_custkey, c_custkey % n AS k, (c_custkey * 7 + 3) % n AS o, c_custkey % 3 <> 0 AS aliases, 2015 + c_custkey % 9 AS y FROM customer, n),
m AS (SELECT *, {_NAME('k')} AS na, {_NAME('o')} AS nb FROM c), t0 AS (SELECT *, {_ASKED_SQL} AS t FROM m){_rewrite_sql()}"""
