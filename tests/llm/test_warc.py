import bisect
import gzip
import hashlib
import random
from collections import Counter

import pytest

from tabularium.llm import queries, warc
from tabularium.llm.common import new_path

PAGES = "page_id long, url string, html string"


def plain(rows):
    least = {}
    for page, html in rows:
        least[html] = min(least.get(html, page), page)
    out = []
    for page, html in rows:
        data = html.encode()
        again = len(data) >= 100 and least[html] != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[html] if again else None))
    return sorted(out)


def test_query_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op4_warc(spark, sf_dir).collect()) == plain(pages)


def some_pages(spark, parts):
    body = ["x" * 99, "y" * 100, "z" * 5000, "é" * 60]
    rows = [(i, f"http://e.com/{i} é\r\n", body[i % 4] + ("" if i % 3 else str(i))) for i in range(400)]
    return rows, spark.createDataFrame(rows, PAGES).repartition(parts)


@pytest.mark.parametrize("shard_bytes", [3_000, 50_000])
def test_same_bytes_however_dealt(spark, shard_bytes):
    found = []
    for parts in (1, 7):
        rows, pages = some_pages(spark, parts)
        folder = new_path(spark, "archive")
        files = warc.write(pages, folder, shard_bytes=shard_bytes, file_bytes=2_000).orderBy("file").collect()
        found.append([(r.file, r.records, r.sha256) for r in files])
        got = warc.read_archive(spark, folder)
        assert sorted(tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == plain([(i, h) for i, _, h in rows])
        for r in got.where("record_type = 'response'").collect():
            assert bytes(r.payload).decode() == rows[r.page_id][2]
        assert [r.last_id < s.first_id for r, s in zip(files, files[1:], strict=False)] == [True] * (len(files) - 1)
        for r in files:
            data = open(f"{folder.removeprefix('file://')}/{r.file}", "rb").read()
            assert hashlib.sha256(data).hexdigest() == r.sha256
            assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r.records
    assert found[0] == found[1]
    assert len(found[0]) > 5


def test_odd_rows(spark):
    long, same = "x" * 2_000_000, "s" * 200
    rows = [(1, None, None), (2, "u", ""), (3, "u", same), (3, "u", same), (None, "u", same), (4, "v", same), (5, "w", long), (None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as size", "'a' as shard", "2 as digest", "3 as kind")
    got = warc.round_trip(pages, new_path(spark, "archive")).collect()
    assert len(got) == 8
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted([("1", "response", "None"), ("2", "response", "None"), ("3", "response", "None"), ("3", "revisit", "3"), ("None", "revisit", "3"), ("4", "revisit", "3"), ("5", "response", "None"), ("None", "response", "None")])
    assert warc.round_trip(pages.limit(0), new_path(spark, "archive")).count() == 0


def test_damage_is_found(spark):
    data = bytearray(warc.record(1, 0, "http://a", b"payload" * 30, False, None))
    data[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bytes(data))


def test_bounds_of_skewed_ids(spark):
    """Each shard stays within the limit but for its last id, whatever the layout, and as many jobs are run for many shards as for few."""
    rng = random.Random(5)
    ids = [rng.choice([-(1 << 62), 1 << 61]) + rng.randint(0, 9) if rng.random() < 0.3 else int(rng.expovariate(1 / 5000)) for _ in range(3000)]
    rows = [(i, rng.randint(0, 50)) for i in ids] + [(7, 900)]
    frame = spark.createDataFrame([*rows, (None, 5)], "page_id long, size long")
    bounds = warc.shard_bounds(frame, 400)
    assert bounds == sorted(set(bounds)) == warc.shard_bounds(frame.repartition(5, "size"), 400)
    held = {}
    for i, size in sorted(rows):
        held.setdefault(bisect.bisect_right(bounds, i), Counter())[i] += size
    for own in held.values():
        assert sum(own.values()) - own[max(own)] < 400 or len(own) == 1
    assert len(bounds) > 100
    jobs = []
    for n, limit in ((10, 30), (200_000, 40)):
        spark.sparkContext.setJobGroup(f"bounds {n}", "")
        wide = spark.range(n).selectExpr("id * 1000003 as page_id", "10L as size")
        assert abs(len(warc.shard_bounds(wide, limit)) - n * 10 // limit) <= 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bounds {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 3, jobs  # adaptive plans may run a stage or two by themselves


def test_rows_without_id_are_dealt_by_payload(spark):
    rows = [(None, "u", f"{k % 50:04} " * 100) for k in range(200)] + [(3, "u", "0007 " * 100)]
    folder = new_path(spark, "archive")
    files = warc.write(spark.createDataFrame(rows, PAGES), folder, shard_bytes=10_000).collect()
    assert len({r.shard for r in files}) > 5
    got = warc.read_archive(spark, folder).collect()
    assert Counter(r.record_type for r in got) == {"response": 50, "revisit": 151}
    assert Counter(r.refers_to for r in got if r.record_type == "revisit") == {3: 4, None: 147}
    assert warc.read_archive(spark, folder).rdd.getNumPartitions() > 1
