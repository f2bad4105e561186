"""Near copies against all pairs that share a bucket, in buckets of many texts."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tabularium.llm import similar


def classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    held = {}
    for n in nodes:
        held.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, held.values()))


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]

    def changed(words, n):
        out = list(words)
        for k in rng.sample(range(len(out)), n):
            out[k] = f"x{rng.random()}"
        return out

    texts = []
    for _ in range(40):
        one = changed(base, 4)  # groups of about 0.7, a pair of about 0.85 in each
        texts += [" ".join(one), " ".join(changed(one, 3))]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    ids = {r.text: r.t for r in frame.select("text", F.xxhash64("text").alias("t")).collect()}
    own = {t: set(enumerate(similar.bands(t.encode()))) for t in texts}
    wanted = [(ids[a], ids[b]) for a, b in combinations(texts, 2) if own[a] & own[b] and similar.similarity(a.encode(), b.encode()) >= similar.LEAST]
    got = [(r.a, r.b) for r in similar.pairs(frame).collect()]
    assert {frozenset(x) for x in got} <= {frozenset(x) for x in wanted}
    assert len(wanted) >= 35
    assert classes(got, ids.values()) == classes(wanted, ids.values())


def test_a_large_group_of_texts_that_are_not_similar_is_not_compared_pair_by_pair(spark, monkeypatch):
    rng, held, apart = random.Random(6), [], similar._apart
    texts = []
    for _ in range(80):  # each two of similarity 0.6: most share a bucket
        words = [f"w{k}" for k in range(200)]
        for k in rng.sample(range(200), 5):
            words[k] = f"x{rng.random()}"
        texts.append(" ".join(words))
    monkeypatch.setattr(similar, "_apart", lambda *args: held.append(apart(*args)) or held[0])
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert similar.pairs(frame).count() == 0
    assert held[0].count() < 5 * len(texts)
