"""Structures within bounds: turns of conversations, and events by forty, as JSON of several levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.structures import NAME, TEXT, bounded
from tabularium.sources.payloads import read

#: Events of one structure.
GROUP = 40


def bounded_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts and names, more items and levels than are kept; every tenth group of events is cut short and so no JSON."""
    turn = F.struct(F.col("role"), F.repeat("text", (F.col("conv_id") % 9 + 1).cast("int")).alias("content"), F.array(F.col("turn").cast("string"), F.lit(None), F.lit("true")).alias("n" * (NAME + 20)))
    turns = read(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.to_json(turn, {"ignoreNullFields": "false"}).alias("whole"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda e: F.concat(F.lit("["), e["event_id"].cast("string"), F.lit(", "), e["props"], F.lit("]"))), ", ")
    groups = read(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / GROUP).alias("id")).agg(items.alias("items"), F.count(F.lit(1)).alias("n"))
    whole = F.concat(F.lit('{"n": '), F.col("n").cast("string"), F.lit(', "deep": {"a": {"b": {"c": {"d": [1]}}}}, "events": ['), F.col("items"), F.when(F.col("id") % 10 == 0, "]").otherwise("]}"))
    rows = turns.unionByName(groups.select(F.lit("events").alias("kind"), "id", whole.alias("whole")))
    # the text is made once for both columns
    return rows.select("kind", "id", F.inline(F.transform(F.array(bounded(F.col("whole"))), lambda t: F.struct(F.char_length(t).cast("long").alias("n_chars"), F.md5(t).alias("md5")))))


QUERIES = {"bounded_structures": bounded_structures}

ORACLES = {
    "bounded_structures": f"""WITH t AS (SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, '{{"content":' || CAST(to_json(repeat(text, CAST(conv_id % 9 + 1 AS INTEGER))[:{TEXT}]) AS VARCHAR) || ',"{'n' * NAME}":["' || turn || '",null,"true"],"role":' || CAST(to_json(role) AS VARCHAR) || '}}' AS b FROM conversations
 UNION ALL SELECT 'events', id, CASE WHEN id % 10 > 0 THEN '{{"deep":{{"a":{{"b":{{"c":{{"d":"<depth-limited>"}}}}}}}},"events":[' || string_agg('[' || event_id || ',{{"k":' || json_extract(props, '$.k') || '}}]', ',' ORDER BY event_id) FILTER (r <= 25) || '],"n":' || count(*) || '}}' END
 FROM (SELECT event_id // {GROUP} AS id, event_id, props, row_number() OVER (PARTITION BY event_id // {GROUP} ORDER BY event_id) AS r FROM events) GROUP BY id)
SELECT kind, id, length(b) AS n_chars, md5(b) AS md5 FROM t""",
}
