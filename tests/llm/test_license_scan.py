import random
import re

from tabularium.llm import license_scan, queries
from tabularium.llm.license_texts import TEMPLATES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_query_finds_each_exact_notice(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    n = 0
    for d in docs:
        body = " " + " ".join(words(d.text or "")) + " "
        wanted = {name for name, t in TEMPLATES if f" {' '.join(words(t))} " in body and len(words(t)) >= license_scan.LEAST_WORDS}
        assert wanted <= set(filter(None, got[d.doc_id].licenses.split(",")))
        if wanted:
            n += 1
            assert got[d.doc_id].coverage == 1.0
        for x in filter(None, got[d.doc_id].spans.split(",")):
            name, a, b = x.rsplit(":", 2)
            own = set(words(d.text[int(a) : int(b)]))
            assert any(t == name and len(own & set(words(w))) >= 0.7 * len(set(words(w))) for t, w in TEMPLATES)
    assert n >= 5


def plain_align(a, b):
    """Best score of a local alignment, without a band."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def plain_band(a, b, diagonal, band):
    """Cell by cell: the best score with j - i within band of the diagonal."""
    best, score = 0, {}
    for i, x in enumerate(a):
        for j in range(max(0, i + diagonal - band), min(len(b), i + diagonal + band + 1)):
            score[i, j] = max(0, score.get((i - 1, j - 1), 0) + (2 if x == b[j] and x else -1), score.get((i - 1, j), 0) - 1, score.get((i, j - 1), 0) - 1)
            best = max(best, score[i, j])
    return best


def test_alignment_within_a_band():
    rng = random.Random(14)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 14))] for _ in range(2))
        diagonal, band = rng.randint(-6, 16), rng.randint(0, 8)
        matched, start, end = license_scan.align(a, b, diagonal, band)
        best = plain_band(a, b, diagonal, band)
        assert (matched > 0) == (best > 0) and 2 * matched >= best and matched <= end - start


def test_whole_table_against_all_alignments(spark, sf_dir, documents):
    """Each document against each template, without fingerprints and bands: the same documents hold enough of the same template."""
    index, wanted = license_scan.Index(), {}
    rows = [d for d in documents if d["text"]]
    rows += [{"doc_id": -1 - k, "text": " ".join(w for i, w in enumerate(t.split()) if i % 11 != 5)} for k, (_, t) in enumerate(TEMPLATES) if len(t.split()) > 30]
    for d in rows:
        ids = [index.words.get(w, 0) for w in d["text"].encode().translate(license_scan._TO_WORDS).split()]
        found = set()
        for name, body in zip(index.names, index.bodies, strict=True):
            if sum(x in ids for x in set(body)) >= 0.8 * len(set(body)) - 1:  # else too few words could match
                matched, _, _ = license_scan.align(body, ids, 0, len(body) + len(ids))
                if matched >= max(min(license_scan.LEAST_WORDS, len(body)), license_scan.COVERAGE * len(body)):
                    found.add(name)
        wanted[d["doc_id"]] = found
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in rows], "doc_id long, text string")
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.scan(frame).collect()}
    both = sum(len(got[k] & wanted[k]) for k in wanted)
    assert all(bool(got[k]) <= bool(wanted[k]) for k in wanted)
    assert sum(bool(got[k]) for k in wanted) >= 0.97 * sum(bool(x) for x in wanted.values())
    assert both == sum(map(len, got.values())) > 10  # of overlapping templates the longest alone is reported


def test_whole_licenses_from_a_folder(tmp_path):
    rng = random.Random(3)
    body = " ".join(f"w{rng.randint(0, 900)}" for _ in range(4000))
    (tmp_path / "LONG-1.0").write_text(body)
    (tmp_path / "SHORT-1.0").write_text("one two three four five six seven eight nine ten")
    index = license_scan.Index(license_scan.templates_in(str(tmp_path)))
    changed = " ".join(w for w in body.split() if rng.random() > 0.08)
    found = index.scan(f"before it {changed} after it".encode())
    assert [x[0] for x in found] == ["LONG-1.0"] and 0.9 < found[0][1] < 0.95


def test_changed_texts_are_found():
    rng, index = random.Random(2), license_scan.Index()
    for name, text in TEMPLATES:
        own = words(text)
        if len(own) < 30:
            continue
        for _ in range(3):
            changed = [w for w in own if rng.random() > 0.05]
            for _ in range(len(own) // 25):
                changed.insert(rng.randrange(len(changed)), "foo")
            data = " ".join(["some", "code"] * 30 + changed + ["é", "end"] * 30)
            found = index.scan(data.encode())
            assert name in {x[0] for x in found}, name
            x = next(x for x in found if x[0] == name)
            assert x[1] >= license_scan.COVERAGE
            assert set(words(data.encode()[x[3] : x[4]].decode())) <= set(own) | {"foo"}
    assert not index.scan(b"the software is not a license and the rest is text " * 50)


def test_band_alignment_is_the_best_one():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(1, 15))]
        matched, start, end = license_scan.align(a, b, 0, 20)
        best = plain_align(a, b)
        assert (matched > 0) == (best > 0)
        assert 2 * matched >= best
        assert not matched or 0 <= start < end <= len(b)


def test_winnowing_keeps_a_place_in_each_window():
    rng = random.Random(6)
    import numpy as np

    for _ in range(100):
        hashes = np.array([rng.randint(0, 9) for _ in range(rng.randint(1, 30))], np.uint64)
        places = license_scan.winnow(hashes, 3)
        for i in range(max(1, len(hashes) - 2)):
            inside = [p for p in places if i <= p < i + 3]
            assert any(hashes[p] == hashes[i : i + 3].min() for p in inside)


def test_odd_rows(spark, odd_docs, no_docs):
    got = license_scan.scan(odd_docs).collect()
    assert len(got) == 8 and not any(r.matches for r in got)
    assert license_scan.scan(no_docs).count() == 0
    text = "é" * 7 + " Released under the MIT License. " + "x " * 200_000 + "Licensed under CC BY-NC 4.0."
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().matches
    assert [(m.license, m.start, m.end) for m in found] == [("MIT", 8, 38), ("CC-BY-NC-4.0", len(text) - 28, len(text) - 1)]


def test_every_template_and_its_adjacent_copies_are_found():
    index = license_scan.Index()
    for name, text in TEMPLATES:
        for n in (1, 2, 3, 7):
            found = index.scan("\n".join(["first line", *[text] * n, "last line"]).encode())
            assert len([x for x in found if x[0] == name and x[1] == 1.0]) == n, (name, n)
