"""Records written with their evidence files, and lines of which some are damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.sources import records
from tabularium.sources.payloads import read
from tabularium.sources.shared import new_folder

#: A record as it is read back.
_RECORD = "id long, answer double, evidence array<struct<variable string, csv_path string>>, _file string"


def submission_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per supplier with a file of its own and one of its nation, written in two steps (the second appends) and read back with the files."""
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    file = lambda variable, name, *lines: F.struct(F.lit(variable).alias("variable"), name.alias("name"), F.concat_ws("\n", *lines).alias("content"))
    own = file("df_1", F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"), F.lit(".csv")), F.lit("name,nation"), F.concat_ws(",", "s_name", F.col("s_nationkey").cast("string")))
    nation = file("df_2", F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit(".csv")), F.lit("name,region"), F.concat_ws(",", "n_name", F.col("n_regionkey").cast("string")))
    out = rows.select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("answer"), F.array(own, nation).alias("files"))
    path = new_folder(spark, "submission")
    records.write(out.where("id % 3 <> 0"), path, "id", files="files", zip="true")
    records.write(out.where("id % 3 = 0"), path, "id", mode="append", files="files")
    back = records.read(spark, path, _RECORD, required="id").select("id", "answer", F.regexp_extract("_file", "/parts/([^/]+)/", 1).alias("part"), F.posexplode("evidence").alias("place", "e"))
    files = records.evidence(spark, path).select("part", "csv_path", F.md5("content").alias("md5"))
    held = back.select("id", "answer", "part", "place", "e.variable", "e.csv_path").join(files, ["part", "csv_path"], "left")
    return held.select("id", "answer", F.col("place").cast("long").alias("place"), "variable", "csv_path", "md5")


_LINE = "event_id long, user_id long, event_type string, _offset long, _reason string, _line string"


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, some damaged in one of six ways, read in ranges of 4 096 bytes: good rows of users above 5, and all that is damaged with its reason."""
    e, key = read(spark, sf_dir, "events"), F.col("event_id")
    whole = F.concat(F.lit('{"event_id": '), key.cast("string"), F.lit(', "user_id": '), F.col("user_id").cast("string"), F.lit(', "event_type": "'), F.col("event_type"), F.lit('"}'))
    line = (
        F.when(key % 17 == 0, F.expr("substring(whole, 1, length(whole) - 3)"))
        .when(key % 19 == 0, F.concat(F.lit("["), key.cast("string"), F.lit("]")))
        .when(key % 23 == 0, F.replace("whole", F.lit('"event_id"'), F.lit('"id"')))
        .when(key % 29 == 0, F.regexp_replace("whole", '"user_id": ([0-9]+)', '"user_id": "$1"'))
        .when(key % 31 == 0, F.concat(F.col("whole"), F.lit(" \r\n \n")))
        .otherwise(F.col("whole"))
    )
    path = new_folder(spark, "lines")
    e.withColumn("whole", whole).select(line.alias("value")).write.text(path)
    found = lambda: records.read(spark, path, _LINE, required="event_id", rangebytes="4096", push="true")
    good = found().where("_reason is null and user_id > 5").select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("line_md5"))
    bad = found().where("_reason is not null").select("event_id", "user_id", "event_type", F.col("_reason").alias("reason"), F.md5("_line").alias("line_md5"))
    return good.unionAll(bad)


QUERIES = {"submission_sink": submission_sink, "damaged_lines": damaged_lines}

_WHOLE = """'{"event_id": ' || event_id || ', "user_id": ' || user_id || ', "event_type": "' || event_type || '"}'"""
ORACLES = {
    "submission_sink": """SELECT id, answer, place, variable, csv_path, md5(content) AS md5 FROM (
 SELECT CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS answer, 0::BIGINT AS place, 'df_1' AS variable, 'data/supplier_' || s_suppkey || '.csv' AS csv_path, 'name,nation' || chr(10) || s_name || ',' || s_nationkey AS content FROM supplier
 UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_acctbal, 1, 'df_2', 'data/nation_' || n_nationkey || '.csv', 'name,region' || chr(10) || n_name || ',' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "damaged_lines": f"""WITH l AS (SELECT *, {_WHOLE} AS w FROM events),
b AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN 'not JSON' WHEN event_id % 19 = 0 THEN 'not an object' WHEN event_id % 23 = 0 THEN 'missing event_id' WHEN event_id % 29 = 0 THEN 'type of user_id' END AS reason,
  CASE WHEN event_id % 17 = 0 THEN w[:len(w) - 3] WHEN event_id % 19 = 0 THEN '[' || event_id || ']' WHEN event_id % 23 = 0 THEN replace(w, '"event_id"', '"id"') ELSE replace(w, '"user_id": ' || user_id, '"user_id": "' || user_id || '"') END AS line FROM l)
SELECT event_id, user_id, event_type, NULL::VARCHAR AS reason, NULL::VARCHAR AS line_md5 FROM b WHERE reason IS NULL AND user_id > 5
UNION ALL SELECT NULL, NULL, NULL, reason, md5(line) FROM b WHERE reason IS NOT NULL""",
}
