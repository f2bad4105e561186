"""Shards along the Hilbert curve: the curve, the order, the laws, and files that ranges leave out."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import hilbert
from tabularium.llm.common import new_path
from tabularium.llm.queries import QUERIES

RANDOM = random.Random(11)
DIMS = ["source", "lang", "n_chars", "doc_id"]


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 1), (2, 5), (3, 3), (4, 2), (5, 2)])
def test_the_curve_visits_every_cell_and_steps_to_a_neighbour(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
    at = hilbert.curve_index(list(points), bits)
    assert sorted(at.tolist()) == list(range(1 << dims * bits))
    steps = np.abs(np.diff(points[:, np.argsort(at)], axis=1))
    assert (steps.sum(axis=0) == 1).all()


def test_too_many_bits_are_refused():
    with pytest.raises(ValueError, match="62 bits"):
        hilbert.curve_index([np.zeros(1)] * 13, 5)


def test_query(spark, sf_dir, documents):
    rows = QUERIES["op11_hilbert_shards"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)


def cells_of(values, cells):
    """From the definition, on sorted values without a grid: how many multiples of a cell's share end below the value."""
    known = sorted(v for v in values if v is not None)
    bounds = [known[int(np.ceil(k * len(known) / cells)) - 1] for k in range(1, cells)] if known else []
    return [0 if v is None else sum(b < v for b in bounds) for v in values]


def test_cells_and_order_against_brute_force(spark):
    kinds = [None, "a", "b", "b", "b", "ab", "é", ""]
    data = [(k % 390, RANDOM.choice(kinds), RANDOM.choice([None, 1, 2, 2, 2, 2, 50])) for k in range(400)]
    df = spark.createDataFrame(data, "id long, name string, n int").repartition(6)
    got = hilbert.sharded(df, ["name", "n"], 7, ties=["id"], bits=3).collect()
    at = hilbert.curve_index([np.array(cells_of(c, 8)) for c in ([x[1] for x in data], [x[2] for x in data])], 3)
    assert sorted((r["id"], r["curve"]) for r in got) == sorted(zip((x[0] for x in data), at.tolist(), strict=True))
    keys = [(r["curve"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert keys == sorted(keys) and sorted(r["rank"] for r in got) == list(range(400))


def test_grid_cells_hold_about_equally_many(spark):
    df = spark.range(50_000).select("id", (F.exp(F.rand(3) * 14)).alias("x"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"))
    for bounds in hilbert.boundaries(df, ["id", "x", "at"], 4):
        assert bounds == sorted(bounds) and len(bounds) == 15
    for d in ("id", "x"):
        (bounds,) = hilbert.boundaries(df, [d], 4)
        share = Counter(sum(b < r[0] for b in bounds) for r in df.select(F.col(d).cast("double")).collect())
        assert len(share) == 16 and max(share.values()) < 1.3 * 50_000 / 16


def test_bytes_law(spark):
    data = [(k, RANDOM.choice(["a", "b"]), RANDOM.choice([1, 10, 100, 3000])) for k in range(900)]
    df = spark.createDataFrame(data, "id long, name string, n_bytes long")
    rows = hilbert.sharded(df, ["name", "id"], 5, "bytes", F.col("n_bytes")).collect()
    sums, slots = Counter(), {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        sums[r["shard"]] += r["n_bytes"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(sums.values()) - min(sums.values()) <= 2 * 3000
    assert all(s == list(range(len(s))) for s in slots.values())
    with pytest.raises(ValueError, match="law"):
        hilbert.sharded(df, ["name"], 5, "key")


def test_layout_does_not_matter(spark, sf_dir):
    docs = hilbert.described(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars"))
    one, other = (sorted(hilbert.sharded(x, DIMS, ties=["text_hash", "doc_id"]).select("doc_id", "shard", "slot").collect()) for x in (docs.repartition(1), docs.repartition(7, "n_chars")))
    assert one == other


def test_one_row_many_times_is_split(spark):
    df = spark.range(3000).selectExpr("1 as id", "'a' as name")
    rows = hilbert.sharded(df, ["name", "id"], 8).groupBy("shard").agg(F.count("*"), F.max("slot")).collect()
    assert sorted(tuple(r) for r in rows) == [(s, 375, 374) for s in range(8)]


def test_files_that_ranges_leave_out(spark, sf_dir):
    docs = hilbert.described(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars"))
    path = new_path(spark, "files")
    hilbert.write(hilbert.sharded(docs, DIMS, 24, ties=["text_hash", "doc_id"]), path, DIMS, file_rows=5)
    assert sorted(r[0] for r in spark.read.parquet(f"{path}/data").select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    files, kept = spark.read.parquet(f"{path}/manifest").count(), []
    for ranges in ({"doc_id": (20, 60)}, {"n_chars": (None, 300)}, {"source": ("src1", "src1")}, {"lang": ("de", "de"), "n_chars": (1000, 3000)}):
        wanted = docs
        for d, (low, high) in ranges.items():
            wanted = wanted.where((F.col(d) >= low if low is not None else F.lit(True)) & (F.col(d) <= high if high is not None else F.lit(True)))
        got = hilbert.read_where(spark, path, ranges)
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in wanted.select("doc_id").collect())
        kept.append(hilbert.files_for(spark, path, ranges).count() / files)
    assert max(kept) < 0.75 and sum(kept) / len(kept) < 0.6, kept
    assert "dynamicpruning" in hilbert.read_where(spark, path, {"doc_id": (20, 60)})._jdf.queryExecution().toString()


def test_odd_rows(spark, odd_docs, no_docs):
    docs = hilbert.described(odd_docs)
    rows = hilbert.sharded(docs, DIMS, 24, ties=["text_hash", "doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(r["slot"] == 0 for r in rows)
    assert {"fp", "spans", "kept", "group", "row"} <= set(rows[0].asDict())
    for law in hilbert.LAWS:
        assert hilbert.sharded(hilbert.described(no_docs), DIMS, law=law, size=F.col("size")).collect() == []
    with pytest.raises(ValueError, match="rename"):
        hilbert.sharded(docs.withColumn("Shard", F.lit(1)), DIMS)
    odd = spark.createDataFrame([(float("nan"), True), (None, None), (float("inf"), False), (-1e300, True), (1e300, None)], "x double, b boolean")
    assert hilbert.sharded(odd, ["x", "b"], 2).count() == 5
