"""Lexical search in tries: against scores of all documents for all items."""

import math
import random
import re
from collections import Counter

import numpy as np
import oracle_llm
import pyarrow as pa
import pytest

from tabularium.llm import lexical
from tabularium.llm.queries import QUERIES

RANDOM = random.Random(5)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    """(item_id, rank, doc_id, score), from the definition."""
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := terms_of(t))]
    n, length, df, out = len(held), sum(x for *_, x in held), Counter(), []
    for _, tf, _ in held:
        df.update(tf.keys())
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, tf, size in held:
            m = 25 + 75 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in terms_of(text) if w in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf_dir, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert found(QUERIES["op13_lexical_search"](spark, sf_dir)) == brute_force([(d["doc_id"], d["text"]) for d in documents], items)


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_lexical_search"])
def test_sql(spark, sf_dir, name):
    assert oracle_llm.compare(spark, name, sf_dir) == ""


def random_docs(n):
    common, rare = list("abcdefgh"), [f"w{k}" for k in range(60)]
    word = lambda: RANDOM.choice(common) if RANDOM.random() < 0.7 else RANDOM.choice(rare)
    return [(RANDOM.choice([None, k, k]), " ".join(word() for _ in range(RANDOM.choice([0, 1, 5, 20, 60])))) for k in range(n)]


def test_small_trees_and_blocks_give_the_same(spark):
    docs = random_docs(300)
    docs += docs[:40] + [docs[7]] * 50  # copies
    items = [(k, " ".join(RANDOM.choice(docs)[1].split()[:9] + ["unseen"] * (k % 2))) for k in range(25)] + [(3, "a a a b"), (3, "a a a b"), (90, None), (91, ""), (92, "!!"), (None, "w1 w2 w3")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    wanted = brute_force(docs, [x for x in items if x[1] is not None])
    assert found(lexical.top_documents(d, b)) == wanted
    assert found(lexical.top_documents(d, b, block_chars=100, tree_docs=30)) == wanted


def test_bounds_hold_and_subtrees_are_left_out():
    sizes = np.array([RANDOM.randint(1, 12) for _ in range(3000)])
    places = np.concatenate([np.sort(RANDOM.sample(range(80), n)) for n in sizes])
    counts, m, ids = np.array([RANDOM.randint(1, 9) for _ in places]), np.array([RANDOM.randint(25, 400) for _ in sizes]), np.arange(len(sizes))[::-1].copy()
    tree = lexical.Tree(ids, m, sizes, places, counts, 16)
    assert all(b - a <= 16 or len({tuple(tree.places[tree.begins[d] : tree.begins[d + 1]]) for d in range(a, b)}) == 1 for a, b, f, l in zip(tree.low, tree.high, tree.first, tree.last, strict=True) if f == l)  # noqa: E741
    looked = 0
    for _ in range(30):
        terms = np.array(sorted(RANDOM.sample(range(80), 5)))
        weights = np.array([RANDOM.randint(1, 9000) for _ in terms])
        dense = np.zeros(80, np.int64)
        dense[terms] = weights
        bounds, scores = tree.bounds(terms, weights), tree.scores(0, len(sizes), dense)
        assert all(scores[a:b].max() <= x for a, b, x in zip(tree.low, tree.high, bounds, strict=True))
        best, n = tree.search(terms, weights, dense, [], 10)
        looked += n
        assert best == sorted(zip((-scores).tolist(), tree.ids.tolist(), strict=True))[:10]
    assert looked < 0.7 * 30 * len(sizes)


def test_words_across_slices(monkeypatch):
    for _ in range(200):
        monkeypatch.setattr(lexical, "SLICE", RANDOM.choice([1, 3, 10, 1000]))
        texts = [None if RANDOM.random() < 0.1 else "".join(RANDOM.choice("aAbé 1-") for _ in range(RANDOM.choice([0, 1, 3, 20]))) for _ in range(RANDOM.randint(0, 12))]
        own = [Counter(w.encode() for w in terms_of(x)) for x in texts]
        wanted = sorted({w for c in own for w in c if RANDOM.random() < 0.5} | {b"a"})
        n, sizes, codes, counts = lexical._restricted(pa.array(texts, pa.large_string()), pa.array(wanted, pa.large_binary()))
        kept = [sorted((wanted.index(w), c) for w, c in x.items() if w in wanted) for x in own]
        assert n.tolist() == [sum(x.values()) for x in own] and sizes.tolist() == [len(x) for x in kept]
        assert list(zip(codes.tolist(), counts.tolist(), strict=True)) == [y for x in kept for y in x]


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one four"), (2, "straße"), (3, "absent")], "item_id int, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(lexical.top_documents(odd_docs, items)) == brute_force(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert lexical.top_documents(no_docs, items).collect() == []
    assert lexical.top_documents(odd_docs, items.where("false")).collect() == []
    assert dict(lexical.top_documents(odd_docs, items).dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
