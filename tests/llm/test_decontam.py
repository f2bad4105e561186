import hashlib
import math
import pickle
import random
import re
import time
from collections import Counter

import numpy as np

from tabularium.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - size + 1)) if own else ():
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if (w := tuple(own[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out[doc] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def plain_near(docs, items):
    """By document, the items whose rare terms stand near each other in it, exact matches or not."""
    docs = [(i, words(t)) for i, t in docs]
    frequency = Counter(w for _, own in docs for w in own)
    out = {}
    for item, text in items:
        rare = set(sorted({w for w in words(text) if frequency[w]}, key=lambda w: (frequency[w], w.encode()))[:6])
        for doc, own in docs:
            at = [p for p, w in enumerate(own) if w in rare]
            if any(len({own[p] for p in at if a <= p <= a + 25}) >= max(2, math.ceil(2 * len(rare) / 3)) for a in at):
                out.setdefault(doc, set()).add(str(item))
    return out


def test_query_against_brute_force(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op5_decontamination(spark, sf_dir).collect()}
    wanted = plain([(d["doc_id"], d["text"]) for d in documents], items)
    assert got == wanted
    assert any(x[4] for x in wanted.values())


def test_near_items_against_brute_force(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = decontam.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    wanted = plain_near([(d["doc_id"], d["text"]) for d in documents], items)
    assert {r.doc_id: set(r.near) for r in rows} == {r.doc_id: wanted.get(r.doc_id, set()) - set(r["items"]) for r in rows}
    shown = {r.doc_id: r.near_items for r in queries.op5_decontamination(spark, sf_dir).collect()}
    assert shown == {r.doc_id: ",".join(sorted(r.near)) for r in rows}


def test_a_full_block(spark):
    """A benchmark of about BLOCK_CHARS characters: the lookup that is sent stays well below what an executor holds."""
    rng = random.Random(2)
    vocabulary = [f"w{k:05}" for k in range(50_000)]
    items = [(str(k), [w.encode() for w in rng.choices(vocabulary, k=100)]) for k in range(decontam.BLOCK_CHARS // 700)]
    terms = sorted({w for _, own in items for w in own})
    began = time.time()
    lookup = decontam._Lookup(items, terms, np.ones(len(terms), np.int64), 10)
    assert len(pickle.dumps(lookup)) < 200 << 20
    segment = decontam._segment([1, 2], [b" ".join(items[7][1]), b"x " * 1000 + b" ".join(items[8][1][20:31])])
    counts = decontam._unpack(segment[3]).astype(np.int64)
    found = lookup.search(np.array(segment[1], np.int64), decontam._terms(segment[2], len(counts)), counts, segment[4])
    assert found[0][0] == list(range(100)) and found[0][1] == {7}
    assert found[1][0] == list(range(1000, 1011)) and found[1][1] == {8}
    assert time.time() - began < 60


def test_few_words_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 50)
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    items = [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 0, 8, 10, 11, 25])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = plain(docs, items)
    for chars in (1 << 20, 40):
        found = decontam.matches(decontam.build_index(frame), bench, block_chars=chars).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in found} == {k: v[:3] for k, v in wanted.items()}
        near = plain_near(docs, items)
        assert {r.doc_id: set(r.near) for r in found} == {r.doc_id: near.get(r.doc_id, set()) - set(r["items"]) for r in found}


def test_proximity(spark):
    item = " ".join(f"rare{k}" for k in range(12))
    often = " and ".join(f"rare{k}" for k in range(8))
    docs = [(1, "x " * 50 + "rare8 and rare9 then rare10 with rare11 " + "x " * 50), (2, "rare8 " + "x " * 200 + "rare9 rare10 rare11"), (3, item), (4, often), (5, often), (6, often)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id: (r["items"], r.near) for r in decontam.contamination(frame, bench).collect()}
    assert found == {1: ([], ["7"]), 2: ([], []), 3: (["7"], []), 4: ([], []), 5: ([], []), 6: ([], [])}


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (None, "three four"), (3, ""), (4, "TOKEN"), (4, "token")], "item_id long, text string")
    got = decontam.contamination(odd_docs, bench).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 2), (4, 2), (5, 0), (6, 1)]
    assert decontam.contamination(no_docs, bench).count() == 0
    assert decontam.contamination(odd_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontam.keep_clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5]
