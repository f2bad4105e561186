"""From questions to the companies that they may mean: codes, names, names that are alike, and names that share words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.text import COLLISION_STOP_WORDS, bare_tickers, explicit_tickers, fold, without_company_form
from tabularium.operators.guards import best_windows
from tabularium.operators.selection import collision_words, match_text, preferred, shortlisted, windows
from tabularium.sources.shared import kept, met

LIMIT = 15
_OUT = ("question_id", "entity", "match_type", "score", "matched_text")


def aliases(catalogue: DataFrame) -> DataFrame:
    """(ticker, text, size, match_type, alike): names and names without the form of company, if they have five characters.

    alike: whether texts that are only similar count, which a name leaves to its shorter form.
    """
    both = catalogue.select("ticker", "company", without_company_form(F.col("company")).alias("bare")).select("ticker", F.explode(F.array_distinct(F.array(F.struct(F.col("company").alias("alias"), F.lit("exact_alias").alias("match_type")), F.struct(F.col("bare").alias("alias"), F.when(F.col("bare") == F.col("company"), "exact_alias").otherwise("normalized_alias").alias("match_type"))))).alias("a"))
    long = both.select("ticker", "a.alias", "a.match_type").where(F.char_length(fold(F.col("alias"))) >= 5)
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return long.select("ticker", match_text(F.col("alias")).alias("text"), "match_type", ((F.col("match_type") != "exact_alias") | (n == 1)).alias("alike")).withColumn("size", F.size(F.split("text", " ")))


def _named(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Codes in brackets or behind the word for a code, and in capitals."""
    found = questions.select("question_id", explicit_tickers(F.col("question")).alias("sure"), bare_tickers(F.col("question")).alias("bare"))
    each = found.select("question_id", F.explode(F.array_union("sure", "bare")).alias("ticker"), "sure")
    kind = F.when(F.array_contains("sure", F.col("ticker")), "explicit_ticker").otherwise("exact_ticker")
    return met(each, catalogue.select("ticker").distinct(), "ticker", "left_semi").select("question_id", F.col("ticker").alias("entity"), kind.alias("match_type"), F.lit(1.0).alias("score"), F.col("ticker").alias("matched_text"))


def matches(questions: DataFrame, catalogue: DataFrame, alike: bool = True, limit: int = LIMIT) -> DataFrame:
    """(question_id, entity, match_type, score, matched_text): all ways in which questions may mean companies.

    questions: question_id, question; catalogue: ticker, company, a row each. Companies collide with one that is matched if their names
    share a word with its text of two words at most. Of the owners of a word only so many are looked at as a list can need.
    """
    names = aliases(catalogue)
    longest = names.agg(F.max("size")).first()[0] or 1
    # a question becomes many runs of words, so questions are dealt to tasks by number, however few bytes they are
    dealt = questions.repartition(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question_id")
    asked = dealt.select("question_id", F.split(match_text(F.col("question")), " ").alias("words"))
    runs = asked.select("question_id", F.explode(windows(F.col("words"), longest)).alias("w")).select("question_id", F.col("w.text").alias("text")).distinct()
    exact = met(runs, names, "text").select("question_id", F.col("ticker").alias("entity"), "match_type", F.lit(1.0).alias("score"), F.col("text").alias("matched_text"))
    out = _named(questions, catalogue).unionByName(exact)
    if alike:
        near = best_windows(asked, names.where("alike").select(F.col("text").alias("alias")).distinct(), longest + 2)
        owned = met(near, names.where("alike").select("ticker", F.col("text").alias("alias")), "alias")
        # an alias that stands in the question is no similar one
        fuzzy = met(owned, runs.select("question_id", F.col("text").alias("alias")), ["question_id", "alias"], "left_anti")
        out = out.unionByName(fuzzy.select("question_id", F.col("ticker").alias("entity"), F.lit("fuzzy_company_name").alias("match_type"), "score", "matched_text"))
    out = kept(out, "matches")  # seeds and their companions read it, so neither the plan nor what it broadcasts doubles
    seeds = preferred(out)
    said = F.split(match_text(F.col("matched_text")), " ")
    by_code = F.col("match_type").isin("explicit_ticker", "exact_ticker")
    words = F.when(by_code, F.array(F.lower("entity"))).when(F.size(said) <= 2, F.filter(said, lambda w: ~w.isin(*COLLISION_STOP_WORDS))).otherwise(F.array().cast("array<string>"))
    each = seeds.select("question_id", "entity", "score", "matched_text", F.explode(F.array_distinct(words)).alias("word"))
    owners = catalogue.select(F.col("ticker").alias("owner"), F.explode(collision_words(F.col("company"))).alias("word"))
    # a list holds the first owners by code; those that match better themselves can take limit places, and the seed is none
    first = owners.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("owner"))).where(F.col("n") <= 2 * limit + 2).drop("n")
    shared = met(each, first, "word").where("owner <> entity")
    return out.unionByName(shared.select("question_id", F.col("owner").alias("entity"), F.lit("collision").alias("match_type"), "score", "matched_text"))


def shortlist(questions: DataFrame, catalogue: DataFrame, alike: bool = True, limit: int = LIMIT) -> DataFrame:
    """(question_id, position, entity, match_type, status) of each question; one row with status "none" for a question without any candidate."""
    # a list is put together from several uses of all matches, and read twice
    found = kept(shortlisted(kept(matches(questions, catalogue, alike, limit), "candidates"), limit), "shortlist")
    none = met(questions.select("question_id").distinct(), found.select("question_id").distinct(), "question_id", "left_anti")
    empty = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("position", "entity", "match_type")]
    return found.unionByName(none.select("question_id", *empty, F.lit("none").alias("status")))
