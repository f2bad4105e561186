"""A choice of tables under coverage: the words of questions are the concepts, sources are the buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators import covering, search
from tabularium.queries.search import _LEXICAL, _best, _rank, questions
from tabularium.sources.payloads import of_tables, payloads
from tabularium.sources.shared import kept

#: Candidates of a question, those whose buckets are required, and tables that a choice may have.
CANDIDATES, REQUIRED, MOST = 40, 8, 6


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is declared and what is claimed.

    The buckets of a question's best candidates need each of its words of six letters or more. A table claims the question's words that it
    has: by their declared name, by the word itself, or by a name that begins with another bucket, by table_id % 3.
    """
    best = _best(spark, sf_dir, CANDIDATES).withColumnRenamed("ticker", "bucket")
    required = best.where(F.col("rank") <= REQUIRED).select("question_id", "bucket").distinct()
    asked = questions(spark, sf_dir).select("question_id", F.array_sort(F.array_distinct(search.tokens(F.col("question")))).alias("asked"))
    declared = required.join(asked, "question_id").select("question_id", "bucket", F.explode(F.filter("asked", lambda w: F.char_length(w) >= 6)).alias("word"))
    texts = of_tables(payloads(spark, sf_dir), best).select("table_id", search.tokens(F.col("index_text")).alias("terms"))
    held = best.join(required, ["question_id", "bucket"]).join(asked, "question_id").join(texts, "table_id")
    words = held.select("question_id", "bucket", "table_id", F.col("rank").alias("position"), F.explode(F.array_intersect("asked", "terms")).alias("word"))
    kind, named = F.col("table_id") % 3, F.concat(F.col("bucket"), F.lit("_"), F.col("word"))
    claim = F.when(kind == 0, named).when(kind == 1, F.col("word")).otherwise(F.concat(F.lit("src"), (F.col("table_id") % 20).cast("string"), F.lit("_"), F.col("word")))
    # both are used several times by what is made of them
    return kept(declared.select("question_id", "bucket", F.concat("bucket", F.lit("_"), "word").alias("concept")), "declared"), kept(words.withColumn("concept", claim), "claims")


def _offers(declared: DataFrame, claims: DataFrame) -> DataFrame:
    """A long concept weighs 2; a table beyond the tenth costs 3, others 2."""
    about = claims.groupBy("question_id", "bucket", "table_id").agg(F.when(F.min("position") > 10, 3).otherwise(2).alias("cost"))
    weight = F.when(F.char_length("concept") > 13, 2).otherwise(1)
    return covering.registered(declared, claims).withColumn("weight", weight).join(about, ["question_id", "bucket", "table_id"])


def cover_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = covering.covering(_offers(*_asked(spark, sf_dir)), MOST)
    return chosen.select("question_id", F.col("place").cast("long").alias("place"), "table_id", "bucket", "gain", F.round("ratio", 6).alias("ratio"))


def cover_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, claims = _asked(spark, sf_dir)
    offers = _offers(declared, claims)
    return covering.audited(declared, offers, covering.covering(offers, MOST))


QUERIES = {"cover_tables": cover_tables, "cover_audit": cover_audit}

_COVER = f"""RECURSIVE {_LEXICAL}, best AS (SELECT question_id, ticker AS bucket, table_id, rank AS position FROM {_rank('lexical')} WHERE rank <= {CANDIDATES}),
required AS (SELECT DISTINCT question_id, bucket FROM best WHERE position <= {REQUIRED}),
declared AS (SELECT question_id, bucket, bucket || '_' || term AS concept FROM required JOIN ask USING (question_id) WHERE length(term) >= 6),
held AS (SELECT DISTINCT question_id, bucket, b.table_id, position, ask.term AS term FROM best b JOIN required USING (question_id, bucket) JOIN ask USING (question_id) JOIN post ON post.table_id = b.table_id AND post.term = ask.term),
claims AS (SELECT question_id, bucket, table_id, position, CASE table_id % 3 WHEN 0 THEN bucket || '_' || term WHEN 1 THEN term ELSE 'src' || table_id % 20 || '_' || term END AS concept FROM (SELECT question_id, bucket, table_id, position, term FROM held)),
owners AS (SELECT question_id, concept, first(bucket ORDER BY step, position, table_id, bucket) AS owner FROM (SELECT question_id, concept, bucket, 0 AS step, 0 AS position, 0 AS table_id FROM declared
  UNION ALL SELECT question_id, concept, bucket, 1, position, table_id FROM claims WHERE concept[:length(bucket)] = bucket) GROUP BY ALL),
offers AS (SELECT DISTINCT question_id, bucket, table_id, CASE WHEN position > 10 THEN 3 ELSE 2 END AS cost, CASE WHEN owner IS NOT DISTINCT FROM bucket THEN concept
  ELSE bucket || '_' || CASE WHEN strpos(concept, '_') > 0 THEN concept[strpos(concept, '_') + 1:] ELSE concept END END AS concept FROM claims LEFT JOIN owners USING (question_id, concept)),
cells AS (SELECT *, CASE WHEN length(concept) > 13 THEN 2 ELSE 1 END AS weight FROM offers UNION ALL SELECT DISTINCT question_id, bucket, table_id, cost, '', {covering.BUCKET_WEIGHT} FROM offers),
tables AS (SELECT question_id, table_id, bucket, cost, list({{'c': concept, 'w': weight}}) AS cells FROM cells GROUP BY ALL),
sets AS (SELECT question_id, list({{'t': table_id, 'b': bucket, 'k': cost, 'cells': cells}}) AS sets FROM tables GROUP BY question_id),
steps AS (SELECT question_id, 0::BIGINT AS place, NULL::BIGINT AS table_id, NULL::VARCHAR AS bucket, NULL::BIGINT AS gain, NULL::DOUBLE AS ratio, []::VARCHAR[] AS done FROM sets
 UNION ALL SELECT question_id, place + 1, x.t, x.b, CAST(x.g AS BIGINT), -x.r, list_concat(done, list_transform(x.cells, lambda e: x.b || ':' || e.c)) FROM (
  SELECT question_id, place, done, list_sort(list_filter(list_transform(sets, lambda s: {{'r': -coalesce(list_sum(list_transform(list_filter(s.cells, lambda e: NOT list_contains(done, s.b || ':' || e.c)), lambda e: e.w)), 0) / s.k::DOUBLE,
    'k': s.k, 't': s.t, 'b': s.b, 'g': coalesce(list_sum(list_transform(list_filter(s.cells, lambda e: NOT list_contains(done, s.b || ':' || e.c)), lambda e: e.w)), 0), 'cells': s.cells}}), lambda y: y.g > 0))[1] AS x
  FROM steps JOIN sets USING (question_id) WHERE place < {MOST}) WHERE x IS NOT NULL)"""
ORACLES = {
    "cover_tables": f"WITH {_COVER} SELECT question_id, place, table_id, bucket, gain, round(ratio, 6) AS ratio FROM steps WHERE place > 0",
    "cover_audit": f"""WITH {_COVER}, needed AS (SELECT question_id, bucket, concept, max(must) AS must FROM (SELECT question_id, bucket, concept, true AS must FROM declared UNION ALL SELECT question_id, bucket, concept, false FROM offers) GROUP BY ALL),
chosen AS (SELECT question_id, table_id, bucket FROM steps WHERE place > 0), got AS (SELECT DISTINCT question_id, bucket, concept, true AS covered FROM offers JOIN chosen USING (question_id, bucket, table_id)),
r AS (SELECT question_id, count(*) AS n_cells, count(covered) AS n_covered, coalesce(string_agg(CASE WHEN covered IS NULL THEN bucket || ':' || concept END, ',' ORDER BY bucket || ':' || concept), '') AS uncovered,
  coalesce(string_agg(DISTINCT CASE WHEN met IS NULL AND must THEN bucket END, ',' ORDER BY CASE WHEN met IS NULL AND must THEN bucket END), '') AS unmet
  FROM needed LEFT JOIN got USING (question_id, bucket, concept) LEFT JOIN (SELECT DISTINCT question_id, bucket, true AS met FROM chosen) USING (question_id, bucket) GROUP BY question_id)
SELECT *, CASE WHEN unmet <> '' THEN 'bucket' WHEN uncovered <> '' THEN 'concept' ELSE 'ok' END AS status FROM r""",
}
