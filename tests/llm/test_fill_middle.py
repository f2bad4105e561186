"""Fill-in-the-middle examples: against a character-by-character version, and as an exact round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabularium.llm import fill_middle
from tabularium.llm.queries import QUERIES

RANDOM = random.Random(3)


def expected(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_code_points_are_found_at_any_place():
    for _ in range(200):
        text = "".join(RANDOM.choice("aé中😀 ") for _ in range(RANDOM.choice([1, 7, 8, 9, 64, 200])))
        data = np.frombuffer(text.encode(), np.uint8)
        index, ends = fill_middle.CodePoints(data), np.cumsum([0] + [len(c.encode()) for c in text])
        assert index.after(np.arange(len(text) + 1)).tolist() == ends.tolist()
        assert index.up_to(ends).tolist() == list(range(len(text) + 1))


def test_examples_of_a_batch_in_any_slice_of_a_column():
    for t in range(200):
        texts = ["".join(RANDOM.choice("aé中😀<P>SM \n") for _ in range(RANDOM.choice([0, 1, 2, 5, 9, 40, 100]))) for _ in range(RANDOM.randint(0, 20))]
        ids = [RANDOM.choice([None, RANDOM.randint(-9, 10**12)]) for _ in texts]
        column = pa.array(["é", *texts, "x"], pa.large_string()).slice(1, len(texts))
        got = zip(*(c.to_pylist() for c in fill_middle._examples(ids, column, "1")), strict=True)
        assert list(got) == [expected(*x) for x in zip(ids, texts, strict=True)], t


def test_query_against_brute_force(spark, sf_dir, documents):
    for r in QUERIES["op12_fill_middle"](spark, sf_dir).collect():
        text = next(d["text"] for d in documents if d["doc_id"] == r["doc_id"]) or ""
        *shape, output = expected(r["doc_id"], text)
        assert [r["n"], r["form"], r["prefix_chars"], r["middle_chars"]] == shape
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_forms_have_their_shares(spark, sf_dir):
    forms = dict(fill_middle.examples(spark.range(20_000).selectExpr("id as doc_id", "'some text' as text")).groupBy("form").count().collect())
    assert abs(forms["plain"] / 20_000 - 0.1) < 0.01 and abs(forms["spm"] / (forms["spm"] + forms["psm"]) - 0.2) < 0.015


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = fill_middle.examples(odd_docs.withColumn("form", F.lit("kept")).withColumn("N", F.lit(7)))
    names = fill_middle.new_names(odd_docs.withColumn("form", F.lit("kept")).withColumn("N", F.lit(7)))
    assert names == {"n": "n_", "form": "form_", "prefix_chars": "prefix_chars", "middle_chars": "middle_chars", "output": "output"}
    found = got.withColumn("back", fill_middle.restored("form_", "output")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_"], r["form_"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["form"] == "kept" and r["N"] == 7
    assert fill_middle.examples(no_docs).collect() == []


def test_a_very_long_text_and_markers_at_its_ends(spark):
    texts = ["<" * 9 + "é" * 1_500_000 + "<", "<P", "<S", "<M", "P>", ">", "a<P>b"]
    docs = spark.createDataFrame([(k, x) for x in texts for k in range(30)], "doc_id long, text string")
    for r in fill_middle.examples(docs).withColumn("back", fill_middle.restored("form", "output")).collect():
        assert r["back"] == r["text"] and r["output"] == expected(r["doc_id"], r["text"])[-1]
