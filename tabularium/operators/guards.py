"""Rules that questions, plans and answers are held to, as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabularium.functions.text import known_scale, names_word
from tabularium.operators.selection import windows
from tabularium.sources.shared import met

#: Phrases of questions; fixed values.
PERCENT = r"bao\s+nhiêu\s+(phần\s+trăm|%)"
DIFFERENCE = ("chênh lệch", "hiệu số")
CHANGE = ("tỷ lệ thay đổi", "tốc độ tăng", "tăng trưởng")
MULTI_TICKER = ("trong nhóm", "xét nhóm", "nhóm doanh nghiệp", "gồm", "giữa", "so sánh", "so với", "trung bình", "bình quân", "hiệu số", "chênh lệch", "tổng chi phí", "tổng giá trị")
MULTI_YEAR = ("trong giai đoạn", "trong các năm", "năm có", "năm nào", "cao nhất", "thấp nhất", "lớn nhất", "nhỏ nhất", "trung vị", "cả ba năm", "cả hai năm")
SCOPES = ("theo báo cáo tài chính hợp nhất", "theo báo cáo tài chính riêng", "theo báo cáo hợp nhất", "theo báo cáo riêng", "báo cáo tài chính hợp nhất", "báo cáo tài chính riêng", "báo cáo hợp nhất", "báo cáo riêng", "công ty mẹ", "hợp nhất", "riêng", "tổng hợp", "consolidated", "separate", "aggregated")
KINDS_OF_COMPANY = ("tổng công ty", r"công ty\s+cổ phần", "công ty", "tập đoàn", r"ngân hàng\s+TMCP", "ngân hàng", "CTCP")
PLACEHOLDERS = ("placeholder", "for simplicity", "assume ", "giả sử", "tạm dùng", "...", "data missing", "missing data", "data unavailable", "defaults to 0", "default to 0", "không có dữ liệu")
TRAILING = ("của", "tại", "trong", "năm", "theo", "từ", "đến", "giai đoạn")

_EDGE = r"(?<![\p{L}\p{N}_])(?:%s)(?![\p{L}\p{N}_])"


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def _quoted(text: Column) -> Column:
    """A pattern that stands for a text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _between_words(terms: Sequence[str]) -> str:
    return "(?iu)" + _EDGE % "|".join(terms)


def without_companies(question: Column, companies: Column) -> Column:
    """The question without codes, where no ASCII letter or digit touches them, and without aliases, wherever they stand; each company's in its order, in any case.

    companies: array<struct<ticker, aliases: array<string>>>; nulls and empty texts among them are left out.
    """
    told = lambda texts: F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    patterns = lambda c: F.concat(
        F.transform(told(F.array(c["ticker"])), lambda t: F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), _quoted(t), F.lit("(?![A-Za-z0-9])"))),
        F.transform(told(c["aliases"]), lambda a: F.concat(F.lit("(?iu)"), _quoted(a))),
    )
    every = F.flatten(F.transform(F.filter(companies, lambda c: c.isNotNull()), patterns))
    return F.aggregate(F.coalesce(every, F.array().cast("array<string>")), question, lambda text, pattern: F.regexp_replace(text, pattern, F.lit(" ")))


#: What goes after the companies, in this order; kinds of company go only if a company has an alias.
_PERIODS = (r"(?iu)(?<!\d)20\d{2}\s*(?:[-–—]|đến|tới)\s*(?:năm\s+)?20\d{2}(?!\d)", r"(?<!\d)20\d{2}(?!\d)")
_FILLERS = (_between_words((r"là\s+bao\s+nhiêu", r"bao\s+nhiêu")), _between_words(("của", "năm")), r"\(\s*\)", r"\s+")


def rewritten_question(question: Column, companies: Column, named: Column | None = None) -> Column:
    """The question without its companies, periods, scopes and question words; null if nothing is left.

    companies: as for without_companies. named: are kinds of company ("công ty", "ngân hàng" ...) to go as well? If it isn't given, they
    go where a company of the question has an alias.
    """
    without = lambda text, patterns: reduce(lambda t, p: F.regexp_replace(t, p, " "), patterns, text)
    has_alias = F.exists(companies, lambda c: F.exists(c["aliases"], lambda a: F.coalesce(a, F.lit("")) != ""))
    text = without(without_companies(question, companies), (*_PERIODS, *(f"(?iu){phrase}" for phrase in SCOPES)))
    text = F.when(F.coalesce(has_alias if named is None else named, F.lit(False)), without(text, [_between_words(KINDS_OF_COMPANY)])).otherwise(text)
    text = F.regexp_replace(without(text, _FILLERS), r"^[ ,.;:–—?-]+|[ ,.;:–—?-]+$", "")
    text = F.regexp_replace(text, rf"(?iu)(?:\s+(?:{'|'.join(TRAILING)}))+\s*$", "")
    return F.nullif(F.trim(text), F.lit(""))


def semantic_query(question: Column, ticker: Column) -> Column:
    """rewritten_question() for one company without aliases whose kind goes, too."""
    one = F.array(F.struct(ticker.cast("string").alias("ticker"), F.array().cast("array<string>").alias("aliases")))
    return rewritten_question(question, one, F.lit(True))


def coverage_lock(question: Column, tickers: Column, years: Column) -> Column:
    """Why all buckets of a question are needed, by its words and how many tickers and years there are; empty if they are not."""
    text = F.lower(F.regexp_replace(question, r"\s+", " "))
    reasons = F.array(F.when((tickers > 1) & has_any(text, MULTI_TICKER), "multi_ticker"), F.when((years > 1) & has_any(text, MULTI_YEAR), "multi_year"))
    return F.concat_ws(",", F.array_compact(reasons))


def operation_problems(question: Column, formula: Column) -> Column:
    """What a question asks for and its formula lacks, joined by commas."""
    text = F.lower(question)
    return F.concat_ws(
        ",",
        F.array_compact(
            F.array(
                F.when(text.rlike(PERCENT) & formula.contains("/") & ~formula.rlike(r"\*\s*100(?![0-9])"), "percent"),
                F.when(has_any(text, DIFFERENCE) & ~formula.contains("-"), "difference"),
                F.when(has_any(text, CHANGE) & ~formula.contains("-"), "change"),
                F.when(formula.rlike(r"(?i)\bround\s*\(") & ~text.contains("làm tròn"), "rounding"),
                F.when(has_any(F.lower(formula), PLACEHOLDERS), "placeholder"),
            )
        ),
    )


def scale_problem(expected: Column, formula: Column) -> Column:
    """"scale" if a formula should divide by the expected factor and no factor in it does so; empty otherwise.

    Factors are numbers behind / or * that are known scales or one over them; nothing is expected if the factor is null or one.
    """
    pattern = r"([/*])\s*([0-9][0-9.]*(?:[eE]-?[0-9]+)?)"
    signs, numbers = (F.regexp_extract_all(formula, F.lit(pattern), F.lit(k)) for k in (1, 2))
    factors = F.zip_with(signs, F.transform(numbers, lambda x: known_scale(x.try_cast("double"))), lambda sign, k: F.when((sign == "/") == ~k["reciprocal"], k["scale"]).otherwise(1 / k["scale"]))
    used = F.exists(factors, lambda x: F.coalesce(F.abs(x - expected) <= 1e-5 * expected, F.lit(False)))
    return F.when(expected.isNull() | (expected == 1) | used, "").otherwise("scale")


def json_object(text: Column, key: str) -> Column:
    """The value of a key as text: from the object, with or without a code fence around it; salvaged if it is malformed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    salvaged = F.nullif(F.regexp_extract(bare, rf'"{key}"\s*:\s*"?([^",}}\s]+)', 1), F.lit(""))
    return F.coalesce(F.get_json_object(bare, f"$.{key}"), salvaged)


def selector_status(literals: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Is a literal of a plan the text of a cell, or equal to one as a number? literals: key, literal; cells: key, cell."""
    number = lambda c: F.expr(f"try_cast({c} AS decimal(30, 10))")
    exact = literals.join(cells.select(key, F.col("cell").alias("literal")).distinct(), [key, "literal"], "left_semi").withColumn("exact", F.lit(True))
    numeric = literals.withColumn("x", number("literal")).join(cells.withColumn("x", number("cell")).select(key, "x").distinct(), [key, "x"], "left_semi").drop("x").withColumn("numeric", F.lit(True))
    rows = literals.join(exact, [key, "literal"], "left").join(numeric, [key, "literal"], "left")
    return rows.select(key, "literal", F.when(F.col("exact"), "exact").when(F.col("numeric"), "numeric").otherwise("missing").alias("status"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff and Obershelp's similarity, which Spark lacks."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(ratio, DoubleType())(a, b)


def fuzzy(questions: DataFrame, aliases: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(question, alias, score) of names that are alike: 0.7 of their ratio and 0.3 of their words' F1; word counts differ by 2 at most.

    Names meet on words, for without a common word the score is 0.7 at most. The ratio is at most what the names' lengths
    allow; only pairs that could reach the threshold are compared in Python. threshold must be above 0.7.
    """
    if threshold <= 0.7:
        raise ValueError("names without a common word could be alike")
    parts = lambda c: F.split(c, " ")
    asked = questions.select("question").distinct().select("question", F.explode(F.array_distinct(parts("question"))).alias("word"))
    known = aliases.select("alias").distinct().select("alias", F.explode(F.array_distinct(parts("alias"))).alias("word"))
    common = met(asked, known, "word").where(F.abs(F.size(parts("question")) - F.size(parts("alias"))) <= 2).groupBy("question", "alias").agg(F.count(F.lit(1)).alias("common"))
    f1 = 2 * F.col("common") / (F.size(F.array_distinct(parts("question"))) + F.size(F.array_distinct(parts("alias"))))
    length = F.char_length("question") + F.char_length("alias")
    possible = 0.7 * 2 * F.least(F.char_length("question"), F.char_length("alias")) / length + 0.3 * f1 >= threshold - 1e-9
    near = common.where(possible).select("question", "alias", (0.7 * sequence_ratio(F.col("question"), F.col("alias")) + 0.3 * f1).alias("score"))
    return near.where(F.col("score") >= threshold)


def best_windows(questions: DataFrame, aliases: DataFrame, longest: int, threshold: float = 0.8) -> DataFrame:
    """(question_id, alias, score, matched_text): for each alias the run of words of a question that is most like it, the shortest of equals.

    questions: question_id, words (array); runs of up to longest words are looked at.
    """
    runs = questions.select("question_id", F.explode(windows(F.col("words"), longest)).alias("w")).select("question_id", F.col("w.text").alias("question")).distinct()
    found = met(runs, fuzzy(runs, aliases, threshold), "question")
    order = F.struct(F.col("score"), -F.char_length("question"), F.col("question"))
    return found.groupBy("question_id", "alias").agg(F.max(order).alias("b")).select("question_id", "alias", "b.score", F.col("b.question").alias("matched_text"))


def context_gaps(question: Column, tables: Column) -> Column:
    """What a question names and the used tables lack; empty if nothing.

    tables: array<struct<ticker, year, used>> of all that is loaded. Every ticker named must be used; if all are, and three
    or more years are named, so must every year.
    """
    years = F.regexp_extract_all(question, F.lit("([0-9]+)"), F.lit(1))
    values = lambda rows, c: F.array_distinct(F.transform(rows, lambda t: t[c].cast("string")))
    used = F.filter(tables, lambda t: t["used"])
    tickers = F.filter(values(tables, "ticker"), lambda t: t.isNotNull() & (t != "") & names_word(question, t))
    asked = F.filter(values(tables, "year"), lambda y: y.isNotNull() & F.array_contains(years, y))
    said = lambda label, missing: F.concat(F.lit(label), F.concat_ws(",", F.array_sort(missing)))
    no_ticker, no_year = F.array_except(tickers, values(used, "ticker")), F.array_except(asked, values(used, "year"))
    return F.when(F.size(no_ticker) > 0, said("tickers ", no_ticker)).when((F.size(asked) >= 3) & (F.size(no_year) > 0), said("years ", no_year)).otherwise("")


REPORT_TYPES = ("aggregated", "consolidated", "separate")


def chosen_filters(answers: DataFrame, shortlist: DataFrame, years: tuple[int, int] = (2015, 2025)) -> DataFrame:
    """(question_id, tickers, years, problem): a planner's filters, held to the shortlist of each question.

    answers: question_id, keys, years, report_types (arrays); shortlist: question_id, key, position, ticker. Tickers come in
    the order of the shortlist. The first problem counts: no key, a key twice, a key that is not on the list, no year,
    a year out of bounds, not exactly one known report type.
    """
    each = answers.select("question_id", F.explode(F.array_distinct("keys")).alias("key")).join(shortlist, ["question_id", "key"])
    known = each.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_known"), F.array_sort(F.collect_list(F.struct("position", "ticker"))).alias("t"))
    rows = answers.join(known, "question_id", "left")
    n, distinct = F.size("keys"), F.size(F.array_distinct("keys"))
    problem = (
        F.when(n < 1, "no key")
        .when(distinct < n, "repeated key")
        .when(F.coalesce("n_known", F.lit(0)) < distinct, "unknown key")
        .when(F.size("years") < 1, "no year")
        .when(F.exists("years", lambda y: ~y.between(*years)), "year")
        .when((F.size("report_types") != 1) | ~F.element_at(F.concat("report_types", F.array(F.lit(""))), 1).isin(*REPORT_TYPES), "report type")
    )
    return rows.select("question_id", F.concat_ws(",", "t.ticker").alias("tickers"), F.concat_ws(",", F.transform(F.array_distinct("years"), lambda y: y.cast("string"))).alias("years"), problem.alias("problem"))
