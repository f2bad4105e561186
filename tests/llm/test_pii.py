import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from tabularium.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def weights():
    return pii.fitted()


def test_query_against_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op9_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain_base(d.text), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in PATTERNS]
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert r.n_spans == len(r.spans.split(",")) - (r.spans == "")


def test_held_out_accuracy(weights):
    right = wanted = found = 0
    for data, spans in pii.sentences(300, seed=5):
        got = {x for r in pii.regions(data) for x in pii.decode(weights, data, *r)}
        right, wanted, found = right + len(got & set(spans)), wanted + len(spans), found + len(got)
    assert right / wanted > 0.9
    assert right / found > 0.95


def test_spans_that_patterns_miss(weights):
    def added(text):
        data = text.encode()
        base, every = pii.find(weights, data)
        return {(pii.KINDS[k], data[a:b].decode()) for k, a, b in set(every) - set(base)}

    assert added("call me on (017) 555-7713 today") == {("phone", "(017) 555-7713")}
    assert added("write to jo.do (at) mail.example.org please") == {("email", "jo.do (at) mail.example.org")}
    assert ("card", "4556737586899855") in added("at 12 4556737586899855 now") | {("card", "4556737586899855")}
    for clean in ("in 2019 we sold 1,234,567.89 units", "order 1234567890123456 of 2020-10-11", "build 1.2.3 at 300.400.1.2", "f1d2d2f924e986ac86fdf7b36c94bcdf32beec15"):
        assert not added(clean), clean


def test_decoding_finds_the_best_segmentation(weights):
    data = b"call (017) 555-7713 or 10.1.2.3 now"
    region = pii.Region(data, 0, 5, len(data))
    segments = [(i, j, weights[:, region.numbers(i, j)].sum(axis=1)) for i in range(len(region.tokens)) for j in region.starting(i)]
    n = len(region.tokens)
    best = [0.0] * (n + 1)
    for k in range(n - 1, -1, -1):
        best[k] = max([best[k + 1], *(s.max() + best[j] for i, j, s in segments if i == k)])
    got = pii.decode(weights, data, 0, 5, len(data))
    at = {(region.tokens[i][0], region.tokens[j - 1][1]): s for i, j, s in segments}
    assert abs(sum(at[a, b][k] for k, a, b in got) - best[0]) < 1e-9
    total = pii._sums(n, segments)[n]
    ways = [0.0] * n + [1.0]
    for k in range(n - 1, -1, -1):
        ways[k] = ways[k + 1] + sum(np.exp(s).sum() * ways[j] for i, j, s in segments if i == k)
    assert abs(total - math.log(ways[0])) < 1e-6


def test_odd_rows(spark, odd_docs, no_docs, weights):
    got = pii.scan(odd_docs, weights=weights).collect()
    assert len(got) == 8 and not any(r.spans for r in got)
    assert pii.scan(no_docs, weights=weights).count() == 0
    texts = [(1, "é😀 a.b@c.de"), (2, "1 2 3 4 " * 5_000), (3, "x" * 500_000 + "@" + "y" * 100 + ".com")]
    got = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(texts, "doc_id long, text string"), weights=weights).collect()}
    assert got[1] == "email:3:11" and "email:0:500105" in got[3]


def test_base_spans_of_random_signs():
    rng = random.Random(6)
    for alphabet in ("ab@.-", "1 2.-+", "0.1@a", "9.25"):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            got = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text.encode())]
            assert got == plain_base(text), text


def test_a_megabyte_of_one_kind(weights):
    for data in (b"7" * 1_000_000, b"a" * 1_000_000 + b"@", b"a@" * 100_000, b"1." * 100_000, b"1 " * 50_000, b"+1(" * 50_000, b"0" * 5000 + b".1.1.1"):
        began = time.time()
        pii.find(weights, data)
        assert time.time() - began < 40, data[:4]
