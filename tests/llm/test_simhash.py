import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tabularium.llm import queries, simhash, similar


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(pairs, tau=2):
    """Least id for each row of (id, fp), by looking at all pairs."""
    fps = sorted({fp for _, fp in pairs})
    up = {fp: fp for fp in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= tau:
                up[find(a)] = find(b)
    least = defaultdict(list)
    for doc, fp in pairs:
        least[find(fp)].append(doc)
    return {fp: min((d for d in least[find(fp)] if d is not None), default=None) for fp in fps}


def test_query_against_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf_dir).collect()}
    pairs = [(d["doc_id"], plain_fingerprint(d["text"])) for d in documents]
    classes = plain_classes(pairs)
    assert got == {doc: (f"{fp:016x}", classes[fp]) for doc, fp in pairs}


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


@pytest.mark.parametrize("dense", [False, True])
def test_links_find_every_class(spark, dense):
    rng = random.Random(3)
    if dense:  # copies around a few centres: most go the other way
        centres = [rng.getrandbits(64) for _ in range(3)]
        fps = {c ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for c in centres for _ in range(600)}
    else:
        base = [rng.getrandbits(64) for _ in range(500)]
        fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(4)}
    frame = spark.createDataFrame([(signed(fp),) for fp in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    classes = plain_classes([(signed(fp), fp) for fp in fps])
    got, wanted = defaultdict(set), defaultdict(set)
    for fp in fps:
        got[roots.get(signed(fp), signed(fp))].add(fp)
        wanted[classes[fp]].add(fp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_allocation_is_least_and_complete():
    rng = np.random.default_rng(0)
    costs = np.cumsum(rng.random((50, 3, 4)), axis=2)
    units, least = simhash.allocate(costs)
    assert (units.sum(axis=1) == 3).all()
    for row in range(50):
        ways = [(a, b, 3 - a - b) for a in range(4) for b in range(4 - a)]
        assert abs(min(sum(costs[row, i, u] for i, u in enumerate(w)) for w in ways) - least[row]) < 1e-9


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == 8
    of = {r.doc_id: r for r in got}
    assert of[1].fingerprint == of[2].fingerprint == of[3].fingerprint == "0" * 16
    assert of[2].component_id == of[3].component_id == 1
    assert of[None].component_id == of[4].component_id == 4
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert simhash.keep_first(no_docs).count() == 0


def changed(rng, words, n):
    """words with n of them replaced, apart from each other."""
    out = list(words)
    for k in rng.sample(range(0, len(words), 10), n):
        out[k] = f"new{rng.getrandbits(40)}"
    return out


def test_copies_with_changed_words_go(spark):
    rng = random.Random(11)
    texts = {}
    for k in range(0, 400, 4):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts[k] = " ".join(words)
        texts[k + 1] = " ".join(changed(rng, words, 2))  # 10 of 196 sequences
        texts[k + 2] = " ".join(changed(rng, words, 15))  # under 0.8
        texts[k + 3] = " ".join(words[:120] + [f"x{rng.getrandbits(40)}" for _ in range(120)])
    wanted = {k for k in texts if not any(j < k and similar.similarity(texts[j].encode(), texts[k].encode()) >= 0.8 for j in range(k - k % 4, k))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_first(frame).collect()}
    assert got == wanted
    assert not any(k % 4 == 1 for k in got) and all(k in got for k in texts if k % 4 != 1)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    frame = spark.createDataFrame([(k, " ".join(changed(rng, words, 2))) for k in range(300)], "doc_id long, text string")
    assert similar.pairs(frame).count() <= 2 * similar.BANDS * 300
    assert [r.doc_id for r in simhash.keep_first(frame).collect()] == [0]


def test_copies_of_one_text_that_are_not_copies_of_each_other(spark):
    """400 texts of similarity 0.8 or more to the first, nearly all less to each other: one class."""
    rng = random.Random(9)
    source = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(source))]
    for k in range(1, 401):
        own = list(source)
        for at in rng.sample(range(0, 400, 5), 8):
            own[at] = f"c{k}x{at}"
        rows.append((k, " ".join(own)))
    assert all(similar.similarity(rows[0][1].encode(), t.encode()) >= 0.8 for _, t in rows)
    near = [similar.similarity(a.encode(), b.encode()) for (_, a), (_, b) in zip(rows[1:], rows[2:], strict=False)]
    assert sum(x >= 0.8 for x in near) < 0.1 * len(near)
    got = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
