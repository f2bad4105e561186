"""The record source: two-phase writes, evidence files, ranges of bytes, damage, and filters."""

import json
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tabularium.sources import records

ROWS = "id long, text string"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_ranges_give_each_line_once(spark):
    path = folder() + "/lines.jsonl"
    lines = ['{"id": %d, "text": "%s"}' % (k, "é" * (k % 40)) for k in range(200)]
    damaged = {50: "[" * 5000, 60: '{"id": "x"}', 70: "{", 80: '{"text": "a"}', 90: '{"id": 1.5}', 100: "3", 110: '{"id": 9223372036854775808}', 120: '{"id": true}'}
    body = "\n".join(damaged.get(k, x) for k, x in enumerate(lines)).encode() + b'\n\xff{"id": 1}\n\n \r\n{"id": 1000, "text": "last"}'
    open(path, "wb").write(body)
    for size in (7, 100, 4096, 1 << 20):
        got = records.read(spark, path, ROWS + ", _offset long, _reason string, _line string", required="id", rangebytes=str(size)).collect()
        assert sorted(r["id"] for r in got if r["_reason"] is None) == [k for k in range(200) if k not in damaged] + [1000]
        bad = {body[: r["_offset"]].count(b"\n"): r["_reason"] for r in got if r["_reason"]}
        assert bad == {50: "not JSON", 60: "type of id", 70: "not JSON", 80: "missing id", 90: "type of id", 100: "not an object", 110: "type of id", 120: "type of id", 200: "not UTF-8"}
        assert all(body[r["_offset"] :].split(b"\n")[0].rstrip(b"\r").decode(errors="replace") == r["_line"] for r in got if r["_reason"])
    assert records.read(spark, path, ROWS).count() == 194  # without a column for it, damage is left out; no id is no damage here


def test_small_ranges_share_a_task(spark):
    path = folder() + "/lines.jsonl"
    open(path, "w").write("".join('{"id": %d}\n' % k for k in range(60_000)))
    for size, most in ((16, 1), (4096, 1), (1 << 18, 1), (1 << 26, 1)):
        df = records.read(spark, path, "id long, _offset long", rangebytes=str(size))
        assert df.rdd.getNumPartitions() == most
        assert df.select(F.count("id"), F.count_distinct("id"), F.count_distinct("_offset")).first() == (60_000, 60_000, 60_000)
    open(path, "w").write("".join('{"id": %d, "text": "%s"}\n' % (k, "x" * 1000) for k in range(20_000)))
    df = records.read(spark, path, "id long", rangebytes="4096")
    assert df.rdd.getNumPartitions() == 3 and sorted(r.id for r in df.collect()) == list(range(20_000))


def test_filters_reach_the_reader(spark):
    path = folder() + "/lines.jsonl"
    open(path, "w").write("\n".join(json.dumps({"id": k, "text": "ab"[k % 2]}) for k in range(50)) + "\n{\n")
    read = lambda: records.read(spark, path, ROWS + ", _reason string", push="true")
    for condition, wanted in (("id > 40 and text = 'a'", 4), ("id in (3, 4, 99)", 2), ("id is not null and id <= 5", 6), ("_reason is not null", 1), ("id >= 10 and id < 12", 2)):
        df = read().where(condition)
        assert df.count() == wanted
        assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert read().where("length(text) = 1 and id <> 7").count() == 49  # not offered, or not taken


def test_round_trip_with_files_and_appends(spark):
    path = folder() + "/out"
    file = lambda x: F.array(F.struct(F.lit("df_1").alias("variable"), F.concat(F.lit("t"), (x % 3).cast("string"), F.lit(".csv")).alias("name"), (x % 3).cast("string").alias("content")))
    rows = spark.range(100).select("id", F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("text"), file(F.col("id")).alias("files"))
    records.write(rows.where("id < 60"), path, "id", files="files", zip="true")
    assert ids(records.read(spark, path, ROWS)) == list(range(60))
    records.write(rows.where("id >= 60"), path, "id", mode="append", files="files")
    back = records.read(spark, path, ROWS + ", evidence array<struct<variable string, csv_path string>>").collect()
    assert sorted((r["id"], r["text"], r["evidence"][0]["csv_path"]) for r in back) == [(k, f"é\n{k}", f"data/t{k % 3}.csv") for k in range(100)]
    assert {(r["csv_path"], r["content"]) for r in records.evidence(spark, path).collect()} == {(f"data/t{k}.csv", str(k)) for k in range(3)}
    parts = json.load(open(f"{path}/_manifest.json"))["parts"]
    first = [p for p in parts if os.path.exists(f"{path}/parts/{p['name']}/bundle.zip")]
    assert [p["first"] for p in first] == sorted(p["first"] for p in first) and sum(p["n"] for p in parts) == 100
    inside = [x for p in first for x in json.loads(zipfile.ZipFile(f"{path}/parts/{p['name']}/bundle.zip").read("submission.json"))]
    assert [x["id"] for x in inside] == list(range(60))
    records.write(rows.where("id < 3"), path, "id", files="files")
    assert ids(records.read(spark, path, ROWS)) == [0, 1, 2] and len(os.listdir(f"{path}/parts")) == len(json.load(open(f"{path}/_manifest.json"))["parts"])
    records.write(rows.where("false"), path, "id", files="files")
    assert ids(records.read(spark, path, ROWS)) == []


def test_a_failed_job_changes_nothing(spark):
    path = folder() + "/out"
    records.write(spark.range(10).selectExpr("id", "'a' as text"), path, "id")
    clash = spark.range(8).selectExpr("id + 100 as id", "'b' as text", "array(struct('df_1' as variable, 'same.csv' as name, cast(id as string) as content)) as files")
    with pytest.raises(Exception, match="differ"):
        records.write(clash.coalesce(1), path, "id", mode="append", files="files")
    assert ids(records.read(spark, path, ROWS)) == list(range(10))
    # a part that a lost task left behind is in no manifest
    os.makedirs(f"{path}/parts/lost")
    open(f"{path}/parts/lost/records.jsonl", "w").write('{"id": 77, "text": "x"}\n')
    assert ids(records.read(spark, path, ROWS)) == list(range(10))
