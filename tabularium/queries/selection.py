"""Contexts, selection, coverage and entities; lines of documents stand for table rows, part names for companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.text import collapse, without_company_form
from tabularium.operators import search, selection
from tabularium.queries.search import _LEXICAL, PAYLOADS, _best, _rank, fold_sql
from tabularium.queries.search import questions as search_questions
from tabularium.sources.payloads import lines, of_tables, payloads, read

#: Words that a question shares with table rows.
ASKED = ("the", "that", "with", "que", "les", "der", "und")


def _scored_lines(spark: SparkSession, sf_dir: str, tables: DataFrame | None = None) -> DataFrame:
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}_]+", " ")), " "))
    return lines(spark, sf_dir, tables).withColumn("score", F.size(F.array_intersect(words, F.array(*map(F.lit, ASKED)))))


def load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases in order of tables within each source, with the number of rows and of cells (words)."""
    per = lines(spark, sf_dir).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(F.split(F.trim("label"), " +"))).cast("long").alias("n_cells"))
    named = per.join(payloads(spark, sf_dir).select("table_id", "ticker", "start_line"), "table_id")
    alias = F.concat(F.lit("df_"), F.row_number().over(Window.partitionBy("ticker").orderBy("table_id")).cast("string"))
    return named.select("ticker", "table_id", alias.alias("alias"), "n_rows", "n_cells", F.concat("ticker", F.lit("|"), F.col("start_line").cast("string")).alias("reference"))


def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's row catalogue: labels cut to a cell, numbered as records of a file, with its first three distinct ones as titles."""
    rows = lines(spark, sf_dir).select("table_id", "row_position", F.substring(collapse(F.col("label")), 1, selection.CELL).alias("label"))
    per = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_position", "label"))).alias("rows"))
    titles = F.slice(F.array_distinct("rows.label"), 1, 3)
    catalogue = F.transform("rows", lambda r: F.concat((r["row_position"] + 2).cast("string"), F.lit("="), r["label"]))
    return per.select("table_id", F.size("rows").cast("long").alias("row_count"), F.concat_ws("|", titles).alias("titles"), F.md5(F.concat_ws("\n", catalogue)).alias("catalogue_md5"))


def context_seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.seed_rows(_scored_lines(spark, sf_dir)).select("table_id", F.col("row_position").cast("long").alias("row_position"), F.col("score").cast("long").alias("score"))


def _labels(spark: SparkSession, sf_dir: str, tables: DataFrame | None = None) -> DataFrame:
    """Lines as labels: single spaces, cut to a cell; blank ones are none."""
    return lines(spark, sf_dir, tables).select("table_id", "row_position", F.substring(collapse(F.col("label")), 1, selection.CELL).alias("label")).where("label <> ''")


def _titles(spark: SparkSession, sf_dir: str, tables: DataFrame | None = None) -> DataFrame:
    """The first three different labels of each table."""
    first = _labels(spark, sf_dir, tables).groupBy("table_id", "label").agg(F.min("row_position").alias("first"))
    return first.withColumn("title_no", F.row_number().over(Window.partitionBy("table_id").orderBy("first"))).where("title_no <= 3").select("table_id", "title_no", "label")


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The best tables of each question by lexical search, with the question's text."""
    asked = search_questions(spark, sf_dir)
    return _best(spark, sf_dir, k).withColumnRenamed("ticker", "bucket").join(asked, "question_id")


def _row_size(label: str = "label") -> Column:
    """Characters of a row as JSON."""
    return F.char_length(F.to_json(F.struct((F.col("row_position") + 2).alias("row"), F.col(label).alias("label"))))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detailed rows that fit into 4000 characters of JSON after the table's catalogue of rows."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("row_position") + 2).alias("row"), "label")))
    head = F.to_json(F.struct(F.col("n").alias("row_count"), F.col("rows").alias("row_catalog"), F.array().cast("array<string>").alias("detailed_rows")))
    heads = _labels(spark, sf_dir).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), rows.alias("rows")).select("table_id", F.char_length(head).alias("header"))
    details = selection.seed_rows(_scored_lines(spark, sf_dir)).select("table_id", "row_position").join(_labels(spark, sf_dir), ["table_id", "row_position"]).join(heads, "table_id")
    kept = selection.within_budget(details, _row_size(), 4000, header=F.col("header")).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("used").alias("used"))
    return heads.join(kept, "table_id", "left").select("table_id", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("used", "header").cast("long").alias("n_chars"))


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for each of the five best tables of a question."""
    candidates = _candidates(spark, sf_dir, 5).select("question_id", "question", "table_id")
    found = selection.match_summary(candidates, _labels(spark, sf_dir, candidates), _titles(spark, sf_dir, candidates))
    return found.select("question_id", "table_id", "kind", F.col("n").cast("long").alias("n"), F.col("row_position").cast("long").alias("row_position"), F.md5("title").alias("title_md5"))


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detailed rows, then catalogue rows, of a question's three best tables, within 6000 characters of JSON; rows that match go first."""
    candidates = _candidates(spark, sf_dir, 3).select("question_id", "question", "table_id")
    labels, keys = _labels(spark, sf_dir, candidates), ["question_id", "table_id"]
    matched = selection.match_summary(candidates, labels, _titles(spark, sf_dir, candidates)).where("row_position is not null")
    priority = matched.select(*keys, "row_position", (F.col("n") + F.when(F.col("kind") == "exact_row", 0).otherwise(3)).alias("priority"))
    about = of_tables(payloads(spark, sf_dir), candidates).select("table_id", F.char_length(F.to_json(F.struct("table_type", F.substring("index_text", 1, 300).alias("index_text")))).alias("header"))
    listed = labels.join(selection.seed_rows(_scored_lines(spark, sf_dir, candidates)).select("table_id", "row_position"), ["table_id", "row_position"], "left_semi").withColumn("which", F.lit(0)).unionByName(labels.withColumn("which", F.lit(1)))
    rows = candidates.select(*keys).join(listed, "table_id").join(priority, [*keys, "row_position"], "left").join(about, "table_id")
    order = Window.partitionBy(*keys, "which").orderBy(F.col("priority").asc_nulls_last(), "row_position")
    placed = rows.select(*keys, "header", "which", F.row_number().over(order).alias("position"), _row_size().alias("size"))
    kept = selection.packed_lists(placed, 6000, keys)
    per = kept.groupBy(*keys).agg(F.count_if(F.col("which") == 0).alias("n_detailed"), F.count_if(F.col("which") == 1).alias("n_catalogue"), F.max("used").cast("long").alias("n_chars"))
    none = F.lit(0).cast("long")
    out = candidates.select(*keys).join(about, "table_id").join(per, keys, "left")
    return out.select(*keys, F.coalesce("n_detailed", none).alias("n_detailed"), F.coalesce("n_catalogue", none).alias("n_catalogue"), F.coalesce("n_chars", F.col("header").cast("long")).alias("n_chars"))


def row_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned rows (every third) and detailed ones of each table, once each, with their text."""
    planned = lines(spark, sf_dir).where("row_position % 3 = 0").select("table_id", "row_position")
    wanted = planned.unionByName(selection.seed_rows(_scored_lines(spark, sf_dir)).select("table_id", "row_position")).distinct()
    rows = lines(spark, sf_dir).join(wanted, ["table_id", "row_position"], "left_semi")
    return rows.select("table_id", F.col("row_position").cast("long").alias("row_position"), F.md5("label").alias("label_md5"))


def rerank_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 of a question's 80 best tables, from all its buckets and of all kinds of statement; common words stand for what balance sheets speak of."""
    ranked = _best(spark, sf_dir, 80)
    kind = selection.balance_kind(F.col("table_type"), F.col("index_text"), ("the",), ("und", "que"))
    about = payloads(spark, sf_dir).select("table_id", "year", "report_type", kind.alias("statement"))
    out = selection.balanced(ranked.drop("rank").join(about, "table_id"), 20, ("ticker", "year", "report_type"), F.col("statement"))
    return out.select("question_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), "table_id")


def scout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads(spark, sf_dir).select(F.col("ticker").alias("bucket"), F.col("table_id").alias("rank"))
    return selection.scout_chunks(rows).select(F.col("rank").alias("table_id"), "bucket", "chunk")


def lexical_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a question's 20 best tables those with a row or title that is a phrase of it: at most two of a source, eight in all."""
    best = _candidates(spark, sf_dir, 20)
    out = selection.rescued(best, _labels(spark, sf_dir, best).select("table_id", "label"))
    shown = [F.round(f"best.{c}", 6).alias(c) for c in ("label_share", "question_share")]
    return out.select("question_id", F.col("position").cast("long").alias("position"), "bucket", "table_id", F.col("best.overlap").cast("long").alias("overlap"), *shown)


def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's 20 best tables where ranks or scores are missing here and there, in the order that is left."""
    best = _best(spark, sf_dir, 20)
    holes = best.withColumn("rank", F.when(F.col("table_id") % 3 != 0, F.floor(F.col("rank") / 4))).withColumn("score", F.when(F.col("table_id") % 5 == 0, F.lit(float("inf"))).when(F.col("table_id") % 7 != 0, F.col("score")))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(*selection.fallback_order()))
    return holes.select("question_id", place.cast("long").alias("place"), "table_id")


def nomination_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scouts name the twelve best tables in turn, some twice and some that are no candidates; four of each are kept."""
    best = _candidates(spark, sf_dir, 20)
    top = best.where("rank <= 12").withColumn("scout", F.col("rank") % 2)
    named = top.select("question_id", "scout", F.floor(F.col("rank") / 2).alias("position"), "table_id")
    again = top.select("question_id", "scout", (F.col("rank") + 20).cast("long").alias("position"), "table_id")
    unknown = top.where("rank <= 2").select("question_id", "scout", F.lit(0).cast("long").alias("position"), (-F.col("table_id") - 1).alias("table_id"))
    scouts = selection.salvaged(named.unionByName(again).unionByName(unknown), best, 4)
    rescues = selection.rescued(best, _labels(spark, sf_dir, best).select("table_id", "label")).select("question_id", "table_id", "position")
    out = selection.nominated(scouts, rescues, best.select("question_id", "table_id", "bucket", "rank"))
    return out.select("question_id", F.col("place").cast("long").alias("place"), "table_id", "bucket", "source")


def selection_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected tables in order, scored (n - position + 1) / n."""
    best = _best(spark, sf_dir, 18)
    n = F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    return best.select("question_id", "table_id", F.round((n - F.col("rank") + 1) / n, 6).alias("selection_score"))


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each question that none of its ten best tables holds."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    best = _best(spark, sf_dir, 10).select("question_id", "table_id")
    held = search.postings(of_tables(payloads(spark, sf_dir), best), asked).select("table_id", "term")
    covered = best.join(held, "table_id").select("question_id", "term").distinct()
    return asked.join(covered, ["question_id", "term"], "left_anti")


def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of each question numbered by their first table, tables numbered within: b01_t01 and so on."""
    best = _best(spark, sf_dir, 20)
    first = best.groupBy("question_id", "ticker").agg(F.min("rank").alias("first"))
    numbered = first.withColumn("b", F.row_number().over(Window.partitionBy("question_id").orderBy("first"))).drop("first")
    t = F.row_number().over(Window.partitionBy("question_id", "ticker").orderBy("rank"))
    return best.join(numbered, ["question_id", "ticker"]).select("question_id", "table_id", F.format_string("b%02d_t%02d", F.col("b"), t).alias("candidate_key"))


#: Forms before and behind names that customers get as companies.
FORMS = ("", "Công ty Cổ phần ", "NGÂN HÀNG TMCP ", "Tổng công ty CTCP ", "Tập đoàn  Công ty TNHH ", "công ty ", "Ngân hàng thương mại cổ phần ")
TAILS = ("", " - CTCP", " – công ty  cổ phần")


def _company(key: Column) -> Column:
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return F.concat(pick(FORMS, key), F.lit("Việt "), F.element_at(F.split("c_mktsegment", ""), 1), F.lit(" "), key.cast("string"), pick(TAILS, key))


def company_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of companies without the words for their form."""
    return read(spark, sf_dir, "customer").select("c_custkey", without_company_form(_company(F.col("c_custkey"))).alias("bare"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the codes have one name, the others two."""
    k = F.col("c_custkey") % 40
    rows = read(spark, sf_dir, "customer").withColumn("c_mktsegment", F.lit("X"))
    return rows.select(F.concat(F.lit("T"), k.cast("string")).alias("ticker"), collapse(_company(F.when(k < 20, k).otherwise(F.col("c_custkey") % 80))).alias("company")).distinct()


def catalog_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's aliases, the name and the bare name, longest first, if they have five characters; codes with several names are in conflict."""
    rows = _catalogue(spark, sf_dir)
    each = rows.select("ticker", F.explode(F.array_distinct(F.array("company", without_company_form(F.col("company"))))).alias("alias")).where(F.char_length("alias") >= 5)
    aliases = F.transform(F.array_sort(F.collect_set(F.struct((-F.char_length("alias")).alias("n"), "alias"))), lambda a: a["alias"])
    named, counts = each.groupBy("ticker").agg(F.concat_ws("|", aliases).alias("aliases")), rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(named, "ticker", "left").select("ticker", F.when(F.col("n") > 1, "conflict").otherwise("ok").alias("status"), F.when(F.col("n") == 1, F.col("aliases")).alias("aliases"))


def collision_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of companies' names with the number of companies that hold them; only those of several are collisions."""
    names = read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", _company(F.col("c_custkey")), F.lower("c_mktsegment")).alias("name"))
    each = names.select("c_custkey", F.explode(selection.collision_words(F.col("name"))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").cast("long").alias("first_owner")).where("n > 1")


def entity_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations named in texts "orders of NATION_3 and .." that are made from customers: the first place of each name."""
    nation = read(spark, sf_dir, "nation")
    near = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other"))
    texts = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(near, F.col("k") == (F.col("c_custkey") % 25).cast("int"))
    words = F.split(selection.match_text(F.concat_ws(" ", F.lit("orders of"), "n_name", F.lit("and"), "other", F.lit("in"), "c_mktsegment")), " ")
    # a column of their own, or each window would fold the text anew
    grams = texts.select("c_custkey", words.alias("words")).select("c_custkey", F.explode(selection.windows(F.col("words"), 3)).alias("w")).select("c_custkey", "w.start", "w.size", "w.text")
    known = nation.select(F.col("n_nationkey").alias("entity"), selection.match_text(F.col("n_name")).alias("text"))
    found = grams.join(known, "text").groupBy("c_custkey", "entity").agg(F.min("start").cast("long").alias("start"))
    return found.select("c_custkey", F.col("entity").cast("long").alias("entity"), "start")


def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of each customer's orders written as a text with a range, read back as a list."""
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    text = F.concat(F.lit("doanh thu giai đoạn "), (F.col("a") + 20).cast("string"), F.lit(" - "), (F.col("b") + 20).cast("string"), F.lit(" của công ty"))
    both = per.select("o_custkey", F.regexp_extract(text, r"(20\d{2})\s*[-–—]\s*(20\d{2})", 1).cast("int").alias("first"), F.regexp_extract(text, r"(20\d{2})\s*[-–—]\s*(20\d{2})", 2).cast("int").alias("last"))
    return both.select("o_custkey", F.concat_ws(",", F.transform(F.sequence("first", "last"), lambda y: y.cast("string"))).alias("years"))


QUERIES = {f.__name__: f for f in (load_tables, table_context, context_seed_rows, context_budget, context_pack, match_summary, row_hydration, rerank_balanced, scout_chunks, lexical_rescue, fallback_order, company_strip, nomination_merge, selection_materialize, coverage_audit, candidate_keys, catalog_aliases, collision_index, entity_exact, year_range)}

_LINES = "lines AS (SELECT * FROM (SELECT doc_id AS table_id, unnest(string_split(text, chr(10))) AS label, unnest(range(len(string_split(text, chr(10))))) AS row_position FROM documents) WHERE trim(label, ' ') <> '')"
_ASK = ", ".join(f"'{w}'" for w in ASKED)
_SCORE = rf"scored AS (SELECT *, len(list_filter(list_distinct(string_split(trim(regexp_replace(lower(label), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ')), lambda w: w IN ({_ASK}))) AS score FROM lines)"
_SEEDS = """placed AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_position) AS place, count(*) OVER (PARTITION BY table_id) AS n, row_number() OVER (PARTITION BY table_id ORDER BY score > 0 DESC, score DESC, row_position) AS s FROM scored),
chosen AS (SELECT * FROM placed p WHERE n < 9 OR EXISTS (SELECT 1 FROM placed q WHERE q.table_id = p.table_id AND q.s <= 3 AND abs(q.place - p.place) <= 1)),
seeds AS (SELECT * FROM (SELECT table_id, row_position, score, row_number() OVER (PARTITION BY table_id ORDER BY row_position) AS k FROM chosen) WHERE k <= 9)"""
_MATCH = "trim(regexp_replace(replace(strip_accents(replace(lower({0}), 'ß', 'ss')), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_BEST = lambda k: f"(SELECT * FROM {_rank('lexical')} WHERE rank <= {k})"
_STOP = "'bao', 'bằng', 'các', 'có', 'công', 'của', 'cuối', 'đến', 'đồng', 'là', 'năm', 'ngày', 'nhiêu', 'số', 'tháng', 'theo', 'trong', 'triệu', 'ty', 'tỷ', 'vào', 'và'"
_SENSE = lambda x: f"list_filter(list_distinct({_WORDS.format(x)}), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
_LABELS = rf"{_LINES}, labels AS (SELECT * FROM (SELECT table_id, row_position, substring(trim(regexp_replace(label, '[ \t\n\r\f\x0b]+', ' ', 'g')), 1, 160) AS l FROM lines) WHERE l <> '')"
_TITLES = "titles AS (SELECT * FROM (SELECT table_id, l, row_number() OVER (PARTITION BY table_id ORDER BY first) AS title_no FROM (SELECT table_id, l, min(row_position) AS first FROM labels GROUP BY ALL)) WHERE title_no <= 3)"
_SEEN = lambda k: rf"""seen AS (SELECT question_id, table_id, ticker AS bucket, rank, score, array_to_string({_WORDS.format('text')}, ' ') AS asked, {_SENSE('text')} AS qt FROM {_BEST(k)} JOIN benchmark ON item_id = question_id),
 met AS (SELECT *, {_WORDS.format('l')} AS lw, {_SENSE('l')} AS lt FROM seen JOIN labels USING (table_id)),
 strong AS (SELECT * FROM (SELECT *, CASE WHEN (len(lw) >= 2 OR len(lw) = 1 AND regexp_full_match(l, '[A-Z][A-Z0-9/.-]{{2,9}}')) AND contains(asked, array_to_string(lw, ' ')) THEN 1 ELSE 0 END AS exact, len(list_intersect(qt, lt)) AS overlap FROM met) WHERE exact = 1 OR overlap >= 2),
 shared AS (SELECT *, coalesce(overlap::DOUBLE / nullif(len(lt), 0), 0) AS label_share, coalesce(overlap::DOUBLE / nullif(len(qt), 0), 0) AS question_share FROM strong)"""  # noqa: E731
_SUMMARY = rf"""ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_id ORDER BY exact DESC, overlap DESC, label_share DESC, CAST(row_position AS VARCHAR)) AS n, least(sum(exact) OVER (PARTITION BY question_id, table_id), 3) AS x FROM shared),
 rows_of AS (SELECT question_id, table_id, CASE WHEN n <= x THEN 'exact_row' ELSE 'strong_row' END AS kind, CAST(CASE WHEN n <= x THEN n ELSE n - x END AS BIGINT) AS n, row_position FROM ranked WHERE n <= x + 5)"""
_RESCUED = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, table_id ORDER BY exact DESC, overlap DESC, label_share DESC, question_share DESC) AS i FROM shared WHERE len(qt) > 0 AND len(lt) > 0) WHERE i = 1 AND exact = 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, label_share DESC, question_share DESC, rank) AS p FROM best),
 k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY p) AS position FROM (SELECT *, row_number() OVER (PARTITION BY question_id, bucket ORDER BY p) AS b FROM o) WHERE b <= 2)"""
_JSON_ROW = "length(CAST(to_json({'row': row_position + 2, 'label': l}) AS VARCHAR))"
_FORM = lambda key: f"[{', '.join(repr(x) for x in FORMS)}][{key} % {len(FORMS)} + 1]"
_COMPANY = lambda key, letter: f"{_FORM(key)} || 'Việt ' || {letter} || ' ' || CAST({key} AS VARCHAR) || [{', '.join(repr(x) for x in TAILS)}][{key} % {len(TAILS)} + 1]"
_SPACED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_BEFORE = "['ngan hang thuong mai co phan', 'ngan hang tmcp', 'ngan hang', 'tong cong ty co phan', 'tong cong ty', 'tap doan', 'cong ty co phan', 'cong ty tnhh', 'cong ty', 'ctcp']"
#: Prefixes go one by one, in rounds.
_BARE = lambda source: rf"""strip AS (SELECT key, name AS rest, 0 AS step FROM {source} UNION ALL SELECT key, array_to_string(string_split(rest, ' ')[len(string_split(pre, ' ')) + 1:], ' '), step + 1 FROM (SELECT *, list_filter({_BEFORE}, lambda p: starts_with({fold_sql('rest')}, p || ' '))[1] AS pre FROM strip) WHERE pre IS NOT NULL),
 bare AS (SELECT key, trim(regexp_replace(arg_max(rest, step), '(?i)\s*[-–—]\s*(CTCP|Công ty cổ phần)\s*$', '')) AS bare FROM strip GROUP BY key)"""  # noqa: E731
ORACLES = {
    "load_tables": rf"WITH {_LINES}, p AS (SELECT table_id, count(*) AS n_rows, CAST(sum(len(regexp_split_to_array(trim(label, ' '), ' +'))) AS BIGINT) AS n_cells FROM lines GROUP BY table_id) SELECT ticker, table_id, 'df_' || row_number() OVER (PARTITION BY ticker ORDER BY table_id) AS alias, n_rows, n_cells, ticker || '|' || start_line AS reference FROM p JOIN {PAYLOADS} x USING (table_id)",
    "table_context": rf"""WITH {_LINES}, r AS (SELECT table_id, row_position, substring(trim(regexp_replace(label, '[ \t\n\r\f\x0b]+', ' ', 'g')), 1, 160) AS l FROM lines),
 t AS (SELECT table_id, string_agg(l, '|' ORDER BY first) AS titles FROM (SELECT table_id, l, first, row_number() OVER (PARTITION BY table_id ORDER BY first) AS n FROM (SELECT table_id, l, min(row_position) AS first FROM r GROUP BY ALL)) WHERE n <= 3 GROUP BY table_id)
 SELECT table_id, count(*) AS row_count, any_value(titles) AS titles, md5(string_agg((row_position + 2) || '=' || l, chr(10) ORDER BY row_position)) AS catalogue_md5 FROM r JOIN t USING (table_id) GROUP BY table_id""",
    "context_seed_rows": f"WITH {_LINES}, {_SCORE}, {_SEEDS} SELECT table_id, row_position, score FROM seeds",
    "context_budget": f"""WITH {_LABELS}, {_SCORE}, {_SEEDS}, h AS (SELECT table_id, length(CAST(to_json({{'row_count': count(*), 'row_catalog': list({{'row': row_position + 2, 'label': l}} ORDER BY row_position), 'detailed_rows': []}}) AS VARCHAR)) AS header FROM labels GROUP BY table_id),
 d AS (SELECT table_id, header + sum({_JSON_ROW} + 1) OVER (PARTITION BY table_id ORDER BY row_position) - 1 AS used FROM seeds JOIN labels USING (table_id, row_position) JOIN h USING (table_id))
 SELECT table_id, count(used) AS n_rows, CAST(coalesce(max(used), any_value(header)) AS BIGINT) AS n_chars FROM h LEFT JOIN (SELECT * FROM d WHERE used <= 4000) USING (table_id) GROUP BY table_id""",
    "context_pack": f"""WITH {_LEXICAL}, {_LABELS}, {_SCORE}, {_SEEDS}, {_SEEN(3)}, {_SUMMARY}, c AS (SELECT question_id, s.table_id, length(CAST(to_json({{'table_type': table_type, 'index_text': substring(index_text, 1, 300)}}) AS VARCHAR)) AS header FROM seen s JOIN {PAYLOADS} p USING (table_id)),
 r AS (SELECT c.question_id, c.table_id, header, which, {_JSON_ROW} AS size, row_number() OVER (PARTITION BY c.question_id, c.table_id, which ORDER BY (SELECT n + CASE kind WHEN 'exact_row' THEN 0 ELSE 3 END FROM rows_of o WHERE o.question_id = c.question_id AND o.table_id = c.table_id AND o.row_position = x.row_position) NULLS LAST, row_position) AS position
  FROM c JOIN (SELECT table_id, row_position, l, unnest(CASE WHEN (table_id, row_position) IN (SELECT (table_id, row_position) FROM seeds) THEN [0, 1] ELSE [1] END) AS which FROM labels) x USING (table_id)),
 one AS (SELECT * FROM (SELECT *, header + sum(size + 1) OVER (PARTITION BY question_id, table_id ORDER BY position) - 1 AS used FROM r WHERE which = 0) WHERE used <= 6000),
 mid AS (SELECT c.question_id, c.table_id, any_value(c.header) AS header, count(used) AS n_detailed, coalesce(max(used), any_value(c.header)) AS before FROM c LEFT JOIN one USING (question_id, table_id) GROUP BY ALL),
 two AS (SELECT * FROM (SELECT r.question_id, r.table_id, before + sum(size + 1) OVER (PARTITION BY r.question_id, r.table_id ORDER BY position) - 1 AS used FROM r JOIN mid USING (question_id, table_id) WHERE which = 1) WHERE used <= 6000)
 SELECT question_id, table_id, any_value(n_detailed) AS n_detailed, count(used) AS n_catalogue, CAST(coalesce(max(used), any_value(before)) AS BIGINT) AS n_chars FROM mid LEFT JOIN two USING (question_id, table_id) GROUP BY question_id, table_id""",
    "match_summary": f"""WITH {_LEXICAL}, {_LABELS}, {_TITLES}, {_SEEN(5)}, {_SUMMARY},
 t AS (SELECT question_id, table_id, title_no, l, len(tw) >= 2 AND contains(asked, array_to_string(tw, ' ')) AS exact, len(list_intersect(qt, tt)) AS overlap FROM (SELECT *, {_WORDS.format('l')} AS tw, {_SENSE('l')} AS tt FROM seen JOIN titles USING (table_id))),
 u AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_id, exact ORDER BY CASE WHEN exact THEN title_no ELSE -overlap END, l) AS n FROM t WHERE exact OR overlap > 0)
 SELECT question_id, table_id, kind, n, row_position, NULL AS title_md5 FROM rows_of UNION ALL SELECT question_id, table_id, CASE WHEN exact THEN 'exact_title' ELSE 'title' END, n, NULL, md5(l) FROM u WHERE n <= 3""",
    "row_hydration": f"WITH {_LINES}, {_SCORE}, {_SEEDS} SELECT table_id, row_position, md5(label) AS label_md5 FROM lines WHERE row_position % 3 = 0 OR (table_id, row_position) IN (SELECT (table_id, row_position) FROM seeds)",
    "rerank_balanced": f"""WITH {_LEXICAL}, a AS (SELECT l.question_id, l.ticker, year, report_type, table_id, score, rank, CASE table_type WHEN 'note_table' THEN NULL WHEN 'balance_sheet' THEN CASE WHEN contains(lower(index_text), 'the') THEN 'assets' WHEN contains(lower(index_text), 'und') OR contains(lower(index_text), 'que') THEN 'liabilities' ELSE table_type END ELSE table_type END AS kind FROM {_BEST(80)} l JOIN {PAYLOADS} p USING (table_id)),
 w AS (SELECT question_id, count(DISTINCT (ticker, year, report_type)) AS n_buckets FROM a GROUP BY question_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY question_id, ticker, year, report_type ORDER BY rank) AS i, row_number() OVER (PARTITION BY question_id, ticker, year, report_type, kind ORDER BY rank) AS o, min(rank) OVER (PARTITION BY question_id, ticker, year, report_type) AS f FROM a JOIN w USING (question_id)),
 m AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY f, i) AS n FROM b WHERE n_buckets > 1 AND (i = 1 OR (kind IS NOT NULL AND o = 1))),
 e AS (SELECT b.*, CASE WHEN m.table_id IS NOT NULL AND (m.i = 1 OR m.n <= 20) THEN 0 ELSE 1 END AS filler FROM b LEFT JOIN m USING (question_id, table_id)),
 g AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY filler, rank) AS place FROM e)
 SELECT question_id, rerank_rank, table_id FROM (SELECT question_id, table_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rerank_rank FROM g WHERE place <= 20 OR filler = 0) WHERE rerank_rank <= 20""",
    "scout_chunks": "SELECT doc_id AS table_id, source AS bucket, CAST((coalesce(start, 0) + n - 1) % 2 AS INTEGER) AS chunk FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) JOIN (SELECT source, sum(s) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM (SELECT source, count(*) AS s FROM documents GROUP BY source)) USING (source)",
    "fallback_order": f"""WITH {_LEXICAL}, h AS (SELECT question_id, table_id, CASE WHEN table_id % 3 <> 0 THEN rank // 4 END AS r, CASE WHEN table_id % 5 <> 0 AND table_id % 7 <> 0 THEN score END AS s FROM {_BEST(20)})
 SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY r NULLS LAST, s DESC NULLS LAST, CAST(table_id AS VARCHAR)) AS place, table_id FROM h""",
    "company_strip": f"""WITH RECURSIVE n AS (SELECT c_custkey AS key, {_SPACED.format(_COMPANY('c_custkey', 'c_mktsegment[1]'))} AS name FROM customer), {_BARE('n')} SELECT key AS c_custkey, bare FROM bare""",
    "lexical_rescue": f"""WITH {_LEXICAL}, {_LABELS}, {_SEEN(20)}, {_RESCUED}
 SELECT question_id, position, bucket, table_id, overlap, round(label_share, 6) AS label_share, round(question_share, 6) AS question_share FROM k WHERE position <= 8""",
    "nomination_merge": f"""WITH {_LEXICAL}, {_LABELS}, {_SEEN(20)}, {_RESCUED}, x AS (SELECT * FROM seen WHERE rank <= 12),
 n AS (SELECT question_id, rank % 2 AS scout, rank // 2 AS p, table_id FROM x UNION ALL SELECT question_id, rank % 2, rank + 20, table_id FROM x UNION ALL SELECT question_id, rank % 2, 0, -table_id - 1 FROM x WHERE rank <= 2),
 s AS (SELECT *, row_number() OVER (PARTITION BY question_id, scout ORDER BY p, table_id) AS place FROM (SELECT question_id, scout, table_id, min(p) AS p FROM n WHERE (question_id, table_id) IN (SELECT (question_id, table_id) FROM seen) GROUP BY ALL)),
 f AS (SELECT question_id, table_id, min(place) AS a, 0 AS step, 'scout' AS source FROM s WHERE place <= 4 GROUP BY ALL),
 g AS (SELECT * FROM f UNION ALL SELECT question_id, table_id, position, 1, 'rescue' FROM k WHERE position <= 8 AND (question_id, table_id) NOT IN (SELECT (question_id, table_id) FROM f)),
 h AS (SELECT g.*, bucket, rank FROM g JOIN seen USING (question_id, table_id)),
 e AS (SELECT * FROM h UNION ALL SELECT question_id, arg_min(table_id, rank), 0, 2, 'anchor', bucket, min(rank) FROM seen WHERE (question_id, bucket) NOT IN (SELECT (question_id, bucket) FROM h) GROUP BY question_id, bucket)
 SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY step, a, rank, table_id) AS place, table_id, bucket, source FROM e""",
    "selection_materialize": f"WITH {_LEXICAL} SELECT question_id, table_id, round((count(*) OVER (PARTITION BY question_id) - rank + 1)::DOUBLE / count(*) OVER (PARTITION BY question_id), 6) AS selection_score FROM {_BEST(18)}",
    "coverage_audit": f"WITH {_LEXICAL} SELECT question_id, term FROM ask WHERE (question_id, term) NOT IN (SELECT (question_id, term) FROM {_BEST(10)} JOIN post USING (table_id))",
    "candidate_keys": f"""WITH {_LEXICAL}, t AS (SELECT *, min(rank) OVER (PARTITION BY question_id, ticker) AS f, row_number() OVER (PARTITION BY question_id, ticker ORDER BY rank) AS t FROM {_BEST(20)})
 SELECT question_id, table_id, printf('b%02d_t%02d', dense_rank() OVER (PARTITION BY question_id ORDER BY f), t) AS candidate_key FROM t""",
    "catalog_aliases": f"""WITH RECURSIVE c AS (SELECT DISTINCT 'T' || c_custkey % 40 AS ticker, {_SPACED.format(_COMPANY("(CASE WHEN c_custkey % 40 < 20 THEN c_custkey % 40 ELSE c_custkey % 80 END)", "'X'"))} AS name FROM customer), n AS (SELECT DISTINCT name AS key, name FROM c), {_BARE('n')},
 a AS (SELECT DISTINCT ticker, unnest([name, bare]) AS alias FROM c JOIN bare ON key = name)
 SELECT ticker, CASE WHEN count(DISTINCT name) > 1 THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN count(DISTINCT name) = 1 THEN (SELECT string_agg(alias, '|' ORDER BY length(alias) DESC, alias) FROM a WHERE a.ticker = c.ticker AND length(alias) >= 5) END AS aliases FROM c GROUP BY ticker""",
    "collision_index": f"""WITH w AS (SELECT DISTINCT c_custkey, unnest(string_split({_MATCH.format("(" + _COMPANY('c_custkey', 'c_mktsegment[1]') + " || ' ' || lower(c_mktsegment))")}, ' ')) AS word FROM customer)
 SELECT word, count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS first_owner FROM w WHERE length(word) >= 3 AND word NOT IN ('bao', 'co', 'cong', 'ctcp', 'dau', 'doan', 'hang', 'ngan', 'phan', 'phat', 'tap', 'thuong', 'tong', 'trien', 'ty', 'viet', 'nam', 'tmcp', 'tnhh') GROUP BY word HAVING count(*) > 1""",
    "entity_exact": "SELECT c_custkey, CAST(e AS BIGINT) AS entity, CAST(min(s) AS BIGINT) AS start FROM (SELECT c_custkey, c_nationkey AS e, 3 AS s FROM customer UNION ALL SELECT c_custkey, c_custkey % 25, 6 FROM customer) GROUP BY c_custkey, e",
    "year_range": "SELECT o_custkey, array_to_string(range(min(year(o_orderdate)) + 20, max(year(o_orderdate)) + 21), ',') AS years FROM orders GROUP BY o_custkey",
}
