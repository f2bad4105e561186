from collections import Counter, defaultdict

import corpus_pipeline
import test_decontam
import test_line_quality
import test_packing
import test_secret_scan
import test_simhash
from tabularium.llm import line_quality, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = test_line_quality.WORD


def plain_quality(rows):
    """The texts that are left, by id: boilerplate lines go from all but their first document, and depleted documents go."""
    texts, first, holders, sizes = defaultdict(set), {}, defaultdict(set), {}
    key = lambda line: " ".join(w.encode().lower().decode() for w in WORD.findall(line))
    for r in rows:
        text = r["text"] or ""
        texts[r["source"]].add(text)
        first[r["source"], text] = min(first.get((r["source"], text), r["doc_id"]), r["doc_id"])
    for source, own in texts.items():
        for text in own:
            times = Counter(map(key, text.split("\n")))
            for line, n in times.items():
                if line:
                    holders[source, line].add(first[source, text])
                    sizes[source, line] = min(sizes.get((source, line), n * len(line.split())), n * len(line.split()))
    judged = {x[0]: x for x in test_line_quality.plain(rows, line_quality.MIN_DOCS, line_quality.MAX_SHARE, line_quality.MIN_LEFT)}
    out = {}
    for r in rows:
        source, text, gone = r["source"], r["text"] or "", 0
        left = []
        for line in text.split("\n"):
            held = holders.get((source, key(line)), set())
            share = len(held) > len(texts[source]) * line_quality.MAX_SHARE
            above = len(held) > line_quality.MIN_DOCS or share and len(held) > line_quality.SMALL_DOCS or len(held) > line_quality.LONG_DOCS and sizes[source, key(line)] >= line_quality.LONG_WORDS
            if above and min(held) != first[source, text]:
                gone += len(WORD.findall(line))
            else:
                left.append(line)
        n_words = judged[r["doc_id"]][1]
        if not judged[r["doc_id"]][6] and n_words - gone >= n_words * line_quality.MIN_LEFT:
            out[r["doc_id"]] = "\n".join(left)
    return out


def plain_near(texts):
    """The least id of each class: fingerprints within 2 bits, or 5-word similarity of 0.8 or more."""
    own = {}
    for k, t in texts.items():
        words = [w.encode().lower().decode() for w in WORD.findall(t)]
        own[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    prints = {k: test_simhash.plain_fingerprint(t) for k, t in texts.items()}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(own[a] & own[b])
            if bin(prints[a] ^ prints[b]).count("1") <= 2 or own[a] and both >= 0.8 * len(own[a] | own[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in keys if find(k) == k}


def test_stages_against_brute_force(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == COLUMNS
        out[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    left = plain_quality(documents)
    assert out["quality"] == left
    kept = plain_near(left)
    left = {k: t for k, t in left.items() if k in kept}
    assert out["near_duplicates"] == left
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = test_decontam.plain(left.items(), items)
    left = {k: t for k, t in left.items() if not hits[k][4]}
    assert out["decontamination"] == left
    for k, t in out["secrets"].items():
        assert (t == left[k]) == (test_secret_scan.plain(left[k])[4] == "")
        assert t.count(secret_scan.MARK) >= (t != left[k])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    test_packing.check(rows, corpus_pipeline.packing.LENGTHS)
    assert {r.doc_id for r in rows} == set(left)


def test_empty_table(spark, no_docs, sf_dir):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
