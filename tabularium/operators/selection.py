"""Row catalogues, balanced selection, coverage and entity matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions.text import COLLISION_STOP_WORDS, fold, is_phrase, question_tokens, words
from tabularium.sources.shared import met

#: Rows with a match that details start from, rows of details, characters of a cell.
SEEDS, DETAILS, CELL = 3, 9, 160


def seed_rows(rows: DataFrame, seeds: int = SEEDS, details: int = DETAILS) -> DataFrame:
    """rows (table_id, row_position, score) to show in detail.

    Tables of fewer than `details` rows are shown whole. Else the rows with the best positive scores,
    filled up by the first rows, and their neighbours; the first `details` of these.
    """
    table = Window.partitionBy("table_id")
    best = table.orderBy(F.desc(F.greatest(F.col("score"), F.lit(0)) > 0), F.desc(F.when(F.col("score") > 0, F.col("score"))), "row_position")
    placed = rows.withColumn("place", F.row_number().over(table.orderBy("row_position"))).withColumn("n", F.count(F.lit(1)).over(table)).withColumn("by_score", F.row_number().over(best))
    near = placed.where(F.col("by_score") <= seeds).select("table_id", F.explode(F.sequence(F.col("place") - 1, F.col("place") + 1)).alias("place")).distinct()
    marked = placed.join(near.withColumn("near", F.lit(True)), ["table_id", "place"], "left")
    chosen = marked.where((F.col("n") < details) | F.col("near"))
    return chosen.withColumn("k", F.row_number().over(table.orderBy("row_position"))).where(F.col("k") <= details).select("table_id", "row_position", "score")


def within_budget(rows: DataFrame, size: Column, budget: int, group: Sequence[str] = ("table_id",), order: Sequence[str] = ("row_position",), header: Column | None = None) -> DataFrame:
    """The first rows of each group that fit the budget: it stops at the first that does not.

    header is used up before; each row but the first takes a comma.
    """
    place = Window.partitionBy(*group).orderBy(*order)
    used = F.sum(size + 1).over(place.rowsBetween(Window.unboundedPreceding, 0)) - 1 + (F.lit(0) if header is None else header)
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def packed_lists(rows: DataFrame, budget: int, group: Sequence[str]) -> DataFrame:
    """Rows of two lists that share a budget: the first list until a row doesn't fit, then the second with what is left.

    rows: group, header (used up before), which (0 or 1), position, size. Each list's first row takes no comma.
    """
    one = within_budget(rows.where("which = 0"), F.col("size"), budget, group, ("position",), F.col("header"))
    left = one.groupBy(*group).agg(F.max("used").alias("before"))
    two = rows.where("which = 1").join(left, list(group), "left").withColumn("before", F.coalesce("before", "header"))
    two = within_budget(two, F.col("size"), budget, group, ("position",), F.col("before")).drop("before")
    return one.unionByName(two)


def balance_kind(table_type: Column, text: Column, assets: Sequence[str] = ("tài sản",), liabilities: Sequence[str] = ("nợ", "nguồn vốn")) -> Column:
    """The kind of statement that a bucket should have one of: balance sheets by what they speak of; null for notes."""
    has = lambda terms: F.greatest(*(F.contains(F.lower(text), F.lit(t)) for t in terms), F.lit(False))
    sheet = F.when(has(assets), "balance_sheet_assets").when(has(liabilities), "balance_sheet_liabilities").otherwise("balance_sheet")
    return F.when(table_type == "balance_sheet", sheet).when(table_type.isin("income_statement", "cash_flow"), table_type)


def balanced(rows: DataFrame, k: int, bucket: Sequence[str], kind: Column) -> DataFrame:
    """At most k rows of each question: the best of each bucket, the first of each kind in it while there is room, then the best of all.

    A question with a single bucket has its k best. rows: question_id, table_id, score and the bucket's columns.
    """
    question = Window.partitionBy("question_id").orderBy(F.desc("score"), "table_id")
    inside = Window.partitionBy("question_id", *bucket).orderBy(F.desc("score"), "table_id")
    ranked = rows.withColumn("kind", kind).withColumn("rank", F.row_number().over(question)).withColumn("in_bucket", F.row_number().over(inside))
    of_kind = Window.partitionBy("question_id", *bucket, "kind").orderBy("rank")
    ranked = ranked.withColumn("of_kind", F.row_number().over(of_kind))
    # buckets may have nulls, so they are joined by a name of their own
    ranked = ranked.withColumn("bucket_key", F.to_json(F.struct(*bucket)))
    first = Window.partitionBy("question_id")
    buckets = ranked.where("in_bucket = 1").withColumn("bucket_no", F.row_number().over(first.orderBy("rank"))).withColumn("n_buckets", F.count(F.lit(1)).over(first)).select("question_id", "bucket_key", "bucket_no", "n_buckets")
    ranked = ranked.join(buckets, ["question_id", "bucket_key"]).drop("bucket_key")
    must = (F.col("n_buckets") > 1) & ((F.col("in_bucket") == 1) | (F.col("kind").isNotNull() & (F.col("of_kind") == 1)))
    listed = ranked.where(must).withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("bucket_no", "in_bucket")))
    kept = listed.where((F.col("in_bucket") == 1) | (F.col("n") <= k)).select("question_id", "table_id", F.lit(0).alias("filler"))
    every = ranked.join(kept, ["question_id", "table_id"], "left").withColumn("filler", F.coalesce("filler", F.lit(1)))
    filled = every.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("filler", "rank")))
    chosen = filled.where((F.col("place") <= k) | (F.col("filler") == 0))
    return chosen.withColumn("rerank_rank", F.row_number().over(question)).where(F.col("rerank_rank") <= k)


def label_scores(rows: DataFrame) -> DataFrame:
    """rows (question, label) with exact, overlap and the shares of the label's and of the question's words; weak matches go.

    A match is strong if the label is a phrase of the question, or shares two words with it.
    """
    own = rows.withColumn("asked", F.array_join(words(F.col("question")), " ")).withColumn("asked_tokens", question_tokens(F.col("question"))).withColumn("own_tokens", question_tokens(F.col("label")))
    overlap = F.size(F.array_intersect("asked_tokens", "own_tokens"))
    scored = own.withColumns({"exact": is_phrase(F.col("label"), F.col("asked")).cast("int"), "overlap": overlap})
    shares = {"label_share": F.coalesce(F.try_divide("overlap", F.size("own_tokens")), F.lit(0.0)), "question_share": F.coalesce(F.try_divide("overlap", F.size("asked_tokens")), F.lit(0.0))}
    return scored.where((F.col("exact") == 1) | (F.col("overlap") >= 2)).withColumns(shares).drop("asked", "asked_tokens")


def lexical_best(rows: DataFrame) -> DataFrame:
    """(question_id, table_id, best): the best label of each table by exact, overlap and shares; labels and questions without words that carry meaning don't count."""
    scored = label_scores(rows.where(F.size(question_tokens(F.col("question"))) > 0)).where(F.size("own_tokens") > 0)
    return scored.groupBy("question_id", "table_id").agg(F.max(F.struct("exact", "overlap", "label_share", "question_share")).alias("best"))


def fallback_order(rank: str = "rank", score: str = "score", key: str = "table_id") -> list[Column]:
    """By rank, then score, then id as text; what has no rank or no finite score comes last."""
    finite = F.when(F.abs(F.col(score)) < float("inf"), F.col(score))
    return [F.col(rank).asc_nulls_last(), finite.desc_nulls_last(), F.col(key).cast("string")]


def rescued(candidates: DataFrame, labels: DataFrame, per_bucket: int = 2, total: int = 8) -> DataFrame:
    """Candidates with a label that is a phrase of the question, best first, at most so many of a bucket and in all.

    candidates: question_id, question, table_id, bucket, rank, score; labels: table_id, label.
    """
    best = lexical_best(candidates.select("question_id", "question", "table_id").join(labels, "table_id"))
    rows = candidates.drop("question").join(best.where("best.exact = 1"), ["question_id", "table_id"])
    return capped(rows, per_bucket, total, [F.desc("best"), *fallback_order()])


def match_summary(candidates: DataFrame, labels: DataFrame, titles: DataFrame) -> DataFrame:
    """(question_id, table_id, kind, n, row_position, title): what of a table speaks for it, best first.

    Up to 3 rows that are phrases of the question, 5 further strong rows, 3 titles that are phrases, 3 others that share a word.
    candidates: question_id, question, table_id; labels: table_id, row_position, label; titles: table_id, title_no, label.
    """
    table = Window.partitionBy("question_id", "table_id")
    order = table.orderBy(F.desc("exact"), F.desc("overlap"), F.desc("label_share"), F.col("row_position").cast("string"))
    rows = label_scores(candidates.join(labels, "table_id")).withColumn("n", F.row_number().over(order)).withColumn("n_exact", F.least(F.sum("exact").over(table), F.lit(3)))
    is_exact = F.col("n") <= F.col("n_exact")
    rows = rows.where(F.col("n") <= F.col("n_exact") + 5).select("question_id", "table_id", F.when(is_exact, "exact_row").otherwise("strong_row").alias("kind"), F.when(is_exact, F.col("n")).otherwise(F.col("n") - F.col("n_exact")).alias("n"), "row_position", F.lit(None).cast("string").alias("title"))
    own = candidates.join(titles, "table_id").withColumn("label_words", words(F.col("label")))
    phrase = (F.size("label_words") >= 2) & F.contains(F.array_join(words(F.col("question")), " "), F.array_join("label_words", " "))
    own = own.withColumn("exact", phrase).withColumn("overlap", F.size(F.array_intersect(question_tokens(F.col("question")), question_tokens(F.col("label")))))
    own = own.where(F.col("exact") | (F.col("overlap") > 0)).withColumn("kind", F.when(F.col("exact"), "exact_title").otherwise("title"))
    by = Window.partitionBy("question_id", "table_id", "kind").orderBy(F.when(F.col("exact"), F.col("title_no")).otherwise(-F.col("overlap")), "label")
    own = own.withColumn("n", F.row_number().over(by)).where("n <= 3").select("question_id", "table_id", "kind", "n", F.lit(None).cast("int").alias("row_position"), F.col("label").alias("title"))
    return rows.unionByName(own)


def diverse(rows: DataFrame, limit: int, order: Sequence[Column], group: str = "matched_text") -> DataFrame:
    """The first rows of each question, one of each group in turn; groups go by their best row."""
    best = Window.partitionBy("question_id", group).orderBy(*order)
    placed = rows.withColumn("turn", F.row_number().over(best)).withColumn("overall", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    first = placed.withColumn("group_place", F.min("overall").over(Window.partitionBy("question_id", group)))
    out = first.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("turn", "group_place")))
    return out.where(F.col("position") <= limit).drop("turn", "overall", "group_place")


#: Kinds of match, best first.
MATCH_TYPES = ("explicit_ticker", "exact_ticker", "exact_alias", "normalized_alias", "collision", "fuzzy_company_name")


def _match_order() -> list[Column]:
    return [F.col("priority"), F.desc("score"), F.desc(F.char_length("matched_text")), F.col("entity"), F.col("matched_text")]


def preferred(matches: DataFrame) -> DataFrame:
    """The best match of each entity of a question, with the priority of its kind."""
    kind = F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(MATCH_TYPES) for x in (name, k))), F.col("match_type"))
    best = Window.partitionBy("question_id", "entity").orderBy(*_match_order())
    return matches.withColumn("priority", kind).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def shortlisted(matches: DataFrame, limit: int = 15) -> DataFrame:
    """(question_id, position, entity, match_type, status): the companies that a question may mean, best kind of match first.

    matches: question_id, entity, match_type, score, matched_text. Fuzzy matches fill what is left, one of each text in turn.
    Status: "too many" if more than limit match exactly (then none are safe to drop); else "ok".
    """
    order, own = _match_order(), preferred(matches)
    sure = own.where("match_type <> 'fuzzy_company_name'").withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    counts = sure.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_sure"), F.count_if(F.col("priority") < 4).alias("n_exact"))
    tail = met(diverse(own.where("match_type = 'fuzzy_company_name'"), limit, order), counts.select("question_id", "n_sure"), "question_id", "left")
    tail = tail.withColumn("position", F.col("position") + F.coalesce("n_sure", F.lit(0))).drop("n_sure")
    every = met(sure.unionByName(tail).where(F.col("position") <= limit), counts.select("question_id", "n_exact"), "question_id", "left")
    return every.select("question_id", "position", "entity", "match_type", F.when(F.col("n_exact") > limit, "too many").otherwise("ok").alias("status"))


def collision_words(name: Column) -> Column:
    """The different folded words of a name that few companies bear: three characters or more, no word for a form of company."""
    return F.filter(F.array_distinct(F.split(match_text(name), " ")), lambda w: (F.char_length(w) >= 3) & ~w.isin(*COLLISION_STOP_WORDS))


def scout_chunks(rows: DataFrame) -> DataFrame:
    """Deals the rows of each bucket to two chunks in turn, each bucket beginning in the shorter one (rows: bucket, rank)."""
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)  # one row per bucket
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("rank")) - 1)
    return numbered.join(before, "bucket").withColumn("chunk", ((F.col("start") + F.col("n")) % 2).cast("int"))


def capped(rows: DataFrame, per_bucket: int, total: int, order: Sequence[Column]) -> DataFrame:
    """The first rows of each question with at most so many of a bucket and in all."""
    few = rows.withColumn("b", F.row_number().over(Window.partitionBy("question_id", "bucket").orderBy(*order))).where(F.col("b") <= per_bucket)
    return few.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("position") <= total).drop("b")


def salvaged(lists: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(question_id, scout, table_id, place): of each scout's list (position, table_id) the first k that are candidates, each once."""
    first = lists.groupBy("question_id", "scout", "table_id").agg(F.min("position").alias("position")).join(known.select("question_id", "table_id"), ["question_id", "table_id"], "left_semi")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("question_id", "scout").orderBy("position", "table_id")))
    return placed.where(F.col("place") <= k).select("question_id", "scout", "table_id", "place")


def nominated(scouts: DataFrame, rescues: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question_id, place, table_id, bucket, source): what scouts nominate, by their earliest place, then rescued tables, then anchors.

    scouts: as salvaged() has them; rescues: question_id, table_id, position; candidates: question_id, table_id, bucket, rank.
    A bucket without any table gets its best candidate as anchor.
    """
    keys = ["question_id", "table_id"]
    first = scouts.groupBy(*keys).agg(F.min("place").alias("at")).withColumns({"step": F.lit(0), "source": F.lit("scout")})
    more = rescues.select(*keys, F.col("position").alias("at")).join(first, keys, "left_anti").withColumns({"step": F.lit(1), "source": F.lit("rescue")})
    held = first.unionByName(more).join(candidates, keys)
    missing = candidates.join(held.select("question_id", "bucket"), ["question_id", "bucket"], "left_anti")
    anchors = missing.groupBy("question_id", "bucket").agg(F.min_by(F.struct("table_id", "rank"), "rank").alias("a")).select("question_id", "a.table_id", F.lit(0).alias("at"), F.lit(2).alias("step"), F.lit("anchor").alias("source"), "bucket", "a.rank")
    every = held.select("question_id", "table_id", "at", "step", "source", "bucket", "rank").unionByName(anchors)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("step", "at", "rank", "table_id"))
    return every.select("question_id", place.alias("place"), "table_id", "bucket", "source")


def match_text(name: Column) -> Column:
    """Folded letters and digits, single spaces."""
    return F.trim(F.regexp_replace(fold(name), "[^a-z0-9]+", " "))


def windows(words: Column, longest: int) -> Column:
    """All runs of at most so many words, as structs of start, size and text."""
    sizes = F.sequence(F.lit(1), F.lit(longest))
    runs = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.struct(i.alias("start"), size.alias("size"), F.concat_ws(" ", F.slice(words, i, size)).alias("text")))
    return F.filter(F.flatten(F.transform(sizes, runs)), lambda w: w["start"] + w["size"] - 1 <= F.size(words))
