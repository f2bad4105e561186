import re
from collections import Counter, defaultdict

import pytest

from tabularium.llm import line_quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, min_docs, max_share, min_left):
    """(doc_id, measures.., base_failed, kept, n_removed) for rows with doc_id, text, source."""
    holders, texts, spread = defaultdict(dict), defaultdict(set), defaultdict(dict)
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for r in rows:
        text = r["text"] or ""
        texts[r["source"]].add(text)
        for key, n in Counter(" ".join(WORD.findall(lower(line))) for line in text.split("\n")).items():
            if key:
                held = holders[r["source"], key]
                held[text] = min(held.get(text, r["doc_id"]), r["doc_id"])
                spread[r["source"], key][text] = n * len(key.split(" "))
    out = []
    for r in rows:
        text = r["text"] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        removed = 0
        first = min(x["doc_id"] for x in rows if (x["text"] or "") == text and x["source"] == r["source"])
        for line in lines:
            own = WORD.findall(lower(line))
            held = holders[r["source"], " ".join(own)]
            long = min(spread[r["source"], " ".join(own)].values()) >= line_quality.LONG_WORDS and len(held) > line_quality.LONG_DOCS
            if (len(held) > min_docs or len(held) > max(line_quality.SMALL_DOCS, max_share * len(texts[r["source"]])) or long) and min(held.values()) != first:
                removed += len(own)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and len(words) - removed >= min_left * len(words)
        out.append((r["doc_id"], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated), failed, kept, removed))
    return sorted(out)


def test_query_against_brute_force(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in queries.op2_line_quality(spark, sf_dir).collect())
    assert got == plain(documents, line_quality.MIN_DOCS, line_quality.MAX_SHARE, line_quality.MIN_LEFT)


def test_shared_lines_go_and_the_first_page_stays(spark):
    shared = " ".join(f"menu{i}" for i in range(60))
    rows = [{"doc_id": i, "text": f"{shared}\nonly{i} here", "source": "a"} for i in range(20)]
    rows += [{"doc_id": 100 + i, "text": f"{shared.upper()}\n" + " ".join(f"w{i}x{k}" for k in range(80)), "source": "a"} for i in range(5)]
    rows += [{"doc_id": 200, "text": f"{shared}\nonly", "source": "b"}]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string")
    got = sorted(tuple(r) for r in line_quality.verdicts(frame).collect())
    assert got == plain(rows, line_quality.MIN_DOCS, line_quality.MAX_SHARE, line_quality.MIN_LEFT)
    assert {r[0] for r in got if r[7]} == {0, 200, *range(100, 105)}


def test_odd_rows(spark, odd_docs, no_docs):
    got = line_quality.verdicts(odd_docs).collect()
    assert len(got) == 8
    of = {r.doc_id: r for r in got}
    assert of[1].n_words == of[2].n_words == of[3].n_words == 0
    assert of[5].n_repeat_words == 60_000
    assert of[6].word_chars == 40 + 6 + 2 + 1 + 5 + 1 + 12
    assert line_quality.verdicts(no_docs).count() == 0
    assert line_quality.keep_good(odd_docs).columns == odd_docs.columns
    assert [r.doc_id for r in line_quality.keep_good(odd_docs).collect()] == [None]


def plain_clean(rows, either):
    """Texts by id after the removal of lines, for hosts whose documents all have ids and texts of their own."""
    normal = lambda s: " ".join(WORD.findall(s.lower()))
    holders, hosts = defaultdict(set), Counter(r["source"] for r in rows)
    for r in rows:
        for line in r["text"].split("\n"):
            holders[r["source"], normal(line)].add(r["doc_id"])
    out = {}
    for r in rows:
        kept = []
        for line in r["text"].split("\n"):
            held, share = holders[r["source"], normal(line)], line_quality.MAX_SHARE * hosts[r["source"]]
            above = len(held) > 10 and len(held) > share
            if either:
                above = len(held) > 10 or len(held) > 5 and len(held) > share or len(held) > 2 and len(line.split()) >= 50
            if not (above and normal(line) and min(held) != r["doc_id"]):
                kept.append(line)
        out[r["doc_id"]] = "\n".join(kept)
    return out


@pytest.mark.parametrize("either", [False, True])
def test_lines_go_from_the_texts(spark, either):
    own = lambda i: " ".join(f"é{i}x{k}" for k in range(90))
    long = " ".join(f"long{k}" for k in range(50))
    rows = []
    for source, n in (("large", 400), ("small", 30), ("menu", 12)):
        for i in range(n):
            text = own(len(rows)) + "\n\nShare THIS  page" * (i < 12) + "\nfew words" * (i % 5 == 0 and i < 30) + f"\n{long}" * (i in (1, 4, 9)) + "\nlast"
            rows.append({"doc_id": len(rows), "text": text, "source": source, "n_chars": len(text)})
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = line_quality.keep_good(frame, either=either).collect()
    assert {r.doc_id: r.text for r in got} == plain_clean(rows, either)
    assert all(r.n_chars == len(r.text) for r in got) and any(r.text != rows[r.doc_id]["text"] for r in got)
