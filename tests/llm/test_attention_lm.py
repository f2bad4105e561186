import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabularium.llm import attention_lm, queries, subwords


def plain(rows):
    """doc_id: held_out, n_tokens, n_known, train_tokens, base score."""
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) for i, own in tokens.items()}


def test_query_against_brute_force(spark, sf_dir, documents, monkeypatch):
    wanted, scores = plain([(d["doc_id"], d["text"]) for d in documents]), []
    for sent in (attention_lm.SENT, 100):  # all counts sent, and most of them joined
        monkeypatch.setattr(attention_lm, "SENT", sent)
        got = {r.doc_id: r for r in queries.op6_attention_lm(spark, sf_dir).collect()}
        assert got.keys() == wanted.keys()
        for i, r in got.items():
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == wanted[i][:4]
            assert abs(r.base_score - wanted[i][4]) < 1e-6 * abs(wanted[i][4])
            assert r.score < 0
        scores.append(got)
    assert all(abs(scores[0][i].score - scores[1][i].score) < 1e-5 * abs(scores[0][i].score) for i in wanted)


def test_words():
    texts = ["", None, " \t\n", "One TWO\x0bé\x0cÉ  straße\r\n\u00a0x 中文", "one", "a\x00b \x1fc\x85d"]
    for low in range(len(texts) + 1):
        places, words, n_words = attention_lm.words_in(pa.array(texts * 2, pa.string()).slice(low, len(texts)))
        wanted = [(t or "").encode().lower().split() for t in (texts * 2)[low : low + len(texts)]]
        assert n_words.tolist() == [len(x) for x in wanted]
        assert [words[int(k)].as_py() for k in places] == [w for x in wanted for w in x]


def test_subwords_of_many_words(documents):
    words = [w for d in documents for w in (d["text"] or "").encode().lower().split()][:30_000] + ["a\u00a0".encode(), "\u00a0b".encode(), "it's".encode(), b"x" * 3000]
    each = [subwords.ids_of()(w) for w in words]
    ids, sizes = subwords.splitter()(words)
    assert sizes.tolist() == [len(x) for x in each] and np.array_equal(ids, np.concatenate(each))
    assert [len(x) for x in subwords.splitter()([])] == [0, 0]


def test_the_layout_of_the_rows_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = ({r.doc_id: r.score for r in attention_lm.scored(x).collect()} for x in (docs, docs.repartition(5, F.rand(3))))
    assert one.keys() == two.keys()
    assert all(abs(one[i] - two[i]) < 1e-4 * abs(one[i]) for i in one)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_better_than_the_base_and_than_without_attention(spark, monkeypatch, size):
    """On held-out documents: with the fitted weights; and with what attention takes set to nothing."""
    docs, fit, held = spark.read.parquet(f"/root/testdata/{size}/documents.parquet"), attention_lm.fit, []
    monkeypatch.setattr(attention_lm, "fit", lambda *args: held.append(fit(*args)) or held[0])
    sums = lambda: attention_lm.scored(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    score, base = sums()
    assert score > base
    without = held[0].copy()
    attention_lm.unflat(without)["take"][:] = 0
    monkeypatch.setattr(attention_lm, "fit", lambda *args: without)
    assert score > sums()[0] * 0.99


def small_model(monkeypatch):
    for name, value in {"CLASSES": 6, "SHARED": 2, "ROWS": 10, "ROWS_SHARED": 3, "NEXT": 5, "NEXT_SHARED": 2, "LAST": 5, "LAST_SHARED": 2, "WIDTH": 4}.items():
        monkeypatch.setattr(attention_lm, name, value)
    shapes = {"embed": (11, 4), "place": (attention_lm.WINDOW, 4), "look": (4, 4), "take": (4, 4), "out": (4, 6)}
    monkeypatch.setattr(attention_lm, "SHAPES", shapes)
    monkeypatch.setattr(attention_lm, "N_WEIGHTS", sum(int(np.prod(s)) for s in shapes.values()))
    rng = np.random.default_rng(1)
    firsts = rng.integers(0, 50, 30)
    classes = attention_lm.Classes(firsts, np.minimum(firsts, 7), rng.integers(0, 90, 30))
    classes.fit_chain(rng.integers(0, 20, (5, 6)).astype(float))
    return rng, classes, rng.normal(0, 0.5, attention_lm.N_WEIGHTS).astype(np.float32)


def test_gradient(monkeypatch):
    rng, classes, flat = small_model(monkeypatch)
    rows, targets = rng.integers(0, 11, (3, attention_lm.WINDOW)), rng.integers(0, 6, (3, attention_lm.SCORED))
    weight = rng.integers(0, 3, (3, attention_lm.SCORED)).astype(np.float32)
    _, grads = attention_lm.gradient(flat, classes.log_class, rows, targets, weight)
    wide, base = flat.astype(np.float64), classes.log_class.astype(np.float64)
    for k in rng.choice(len(flat), 60, replace=False):
        up, down = wide.copy(), wide.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (attention_lm.gradient(up, base, rows, targets, weight)[0] - attention_lm.gradient(down, base, rows, targets, weight)[0]) / 2e-5
        assert abs(slope - grads[k]) < 1e-3 * max(1, abs(slope))


def test_each_word_is_scored_once_as_one_position_at_a_time(monkeypatch):
    rng, classes, flat = small_model(monkeypatch)
    w, sizes = attention_lm.unflat(flat), [1, 5, 16, 17, 100]
    rows = rng.integers(0, 10, sum(sizes))
    got = attention_lm.Scorer(flat, classes).scores(rows, np.array(sizes), step=3)
    at = 0
    for k, size in enumerate(sizes):
        own, total = rows[at : at + size], 0.0
        at += size
        for p in range(size):
            window = p // attention_lm.SCORED * attention_lm.SCORED - attention_lm.CONTEXT - 1
            seen = [own[j] if j >= 0 else -1 for j in range(window, p)]
            x = np.array([w["embed"][i] + w["place"][j] for j, i in enumerate(seen)])
            a = np.exp(x @ (x[-1] @ w["look"]))
            logits = (x[-1] + (a / a.sum()) @ x @ w["take"]) @ w["out"] + classes.log_class
            total += logits[classes.of_row[own[p]]] - np.log(np.exp(logits).sum())
        assert abs(total - got[k]) < 1e-3


def test_chunks_give_the_windows_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(attention_lm, "CHUNK", 32)
    for size in (1, 31, 32, 33, 100):
        rows = np.arange(size)
        seen = []
        for part in map(lambda x: np.frombuffer(x, np.int16), attention_lm.chunks_of(rows)):
            lead, words = int(part[0]), np.append(part[1:], -1)
            inputs, targets, _ = attention_lm.windows_of(np.array([lead]), np.array([len(part) - 1 - lead]), np.array([lead]))
            seen += [(words[i].tolist(), words[t].tolist()) for i, t in zip(inputs, targets, strict=True)]
        inputs, targets, _ = attention_lm.windows_of(np.array([0]), np.array([size]), np.array([0]))
        assert seen == [(i.tolist(), t.tolist()) for i, t in zip(inputs, targets, strict=True)]
        assert sorted(x for _, t in seen for x in t if x >= 0) == rows.tolist()


def test_training_helps_on_other_text(monkeypatch):
    rng, classes, flat = small_model(monkeypatch)
    base, of_row = np.zeros(6, np.float32), np.append(np.arange(10) % 6, 0)
    rows = [np.repeat(rng.integers(0, 10, 50), 2) for _ in range(400)]  # each word comes twice
    chunks = [(x, 1) for r in rows for x in attention_lm.chunks_of(r)]
    better, seen = attention_lm.improve(flat, base, of_row, chunks[:350], 0, 0.05)
    assert seen == 350 * -(-100 // attention_lm.SCORED)

    def loss(weights):
        words = np.append(np.concatenate(rows[350:]), attention_lm.ROWS)
        inputs, targets, _ = attention_lm.windows_of(np.arange(50) * 100, np.full(50, 100), np.zeros(50, int))
        return attention_lm.gradient(weights, base, words[inputs], of_row[words[targets]], (targets >= 0).astype(np.float32))[0]

    assert loss(better) < 0.9 * min(loss(flat), math.log(6))


def test_shares_sum_to_one(monkeypatch):
    """Of the classes; of the words of a class: what the discount leaves is the chain's part, and the chain's words sum to one."""
    monkeypatch.setattr(attention_lm, "NEXT", 3)
    monkeypatch.setattr(attention_lm, "NEXT_SHARED", 1)
    monkeypatch.setattr(attention_lm, "LAST", 3)
    monkeypatch.setattr(attention_lm, "LAST_SHARED", 1)
    monkeypatch.setattr(attention_lm, "CLASSES", 3)
    monkeypatch.setattr(attention_lm, "SHARED", 1)
    words = {(0,): 5, (0, 1): 2, (1, 2): 1, (2,): 4, (3, 0, 1): 1, (3,): 2}
    firsts, types, found = np.zeros(5), np.zeros(5), np.zeros(5)
    for w, n in words.items():
        firsts[w[0]] += n
        types[w[0]] += 1
        np.add.at(found, list(w), n)
    firsts[4], types[4] = 6, 1
    classes = attention_lm.Classes(firsts, types, found)
    classes.fit_chain(np.array([[1.0, 2, 0, 9], [0, 1, 1, 9], [1, 0, 0, 9]]))
    assert abs(np.exp(classes.log_class).sum() - 1) < 1e-5
    totals = Counter()
    for length in range(1, 8):
        for w in itertools.product(range(4), repeat=length):
            k = classes.of[w[0]]
            share = math.exp(classes.log_chain(np.array(w), np.array([length]))[0])
            totals[k] += max(words.get(w, 0) - attention_lm.DISCOUNT, 0) * classes.per_word[k] + math.exp(classes.log_for_chain[k]) * share
    end = classes.of[4]
    assert all(abs(t - 1) < 0.02 for k, t in totals.items() if k != end)


def test_odd_rows(spark, odd_docs, no_docs):
    got = attention_lm.scored(odd_docs).collect()
    assert len(got) == 8
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 5, 5, 5, 8, 60_001]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert attention_lm.scored(no_docs).count() == 0
    held = next(i for i in range(100) if attention_lm.is_held_out(i))
    only = attention_lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in only] == [(True, 3, 0, 0)]
    assert abs(only[0].base_score) < 1e-9


def with_table(monkeypatch):
    """A small model that predicts rows too: six classes of ten rows of thirty subwords."""
    rng, classes, _ = small_model(monkeypatch)
    monkeypatch.setitem(attention_lm.SHAPES, "inner", (10, 4))
    monkeypatch.setattr(attention_lm, "N_WEIGHTS", sum(int(np.prod(s)) for s in attention_lm.SHAPES.values()))
    table = classes.table(rng.integers(0, 50, 30), rng.integers(0, 90, 30))
    return rng, classes, table, rng.normal(0, 0.5, attention_lm.N_WEIGHTS).astype(np.float32)


def test_texts_are_all_their_subwords():
    texts = ["", "strawberry internationalization a strawberry", None, "übermäßig zzqxv中文 a"]
    places, words, n_words = attention_lm.words_in(pa.array(texts, pa.string()))
    encode, size = subwords.ids_of(), subwords.vocabulary_size() + 1
    ids = [[*(int(k) for w in (t or "").encode().lower().split() for k in encode(w)), size - 1] for t in texts]
    counts = np.bincount(np.concatenate(ids), minlength=size)
    classes = attention_lm.Classes(counts, counts, counts)
    for sent in ([], [b"a", attention_lm.END, b"strawberry"], words.to_pylist()):
        lexicon = attention_lm.Lexicon(sent, list(range(1, len(sent) + 1)), classes, subwords.TOKENIZER)
        rows, sizes, share, n = lexicon.texts(places, words, n_words, subwords.splitter())
        assert sizes.tolist() == [len(x) for x in ids] and sum(sizes) > len(places) + len(texts)
        assert rows.tolist() == classes.row[np.concatenate(ids)].tolist()
        assert np.allclose(share, [classes.log_share[encode(w)].sum() for w in words.to_pylist()])
        kept = [w for w in sent if w != attention_lm.END]
        assert n.tolist() == [sent.index(w) + 1 if w in kept else -1 for w in words.to_pylist()]
    assert [len(x) for x in lexicon.texts(*attention_lm.words_in(pa.array([], pa.string())), subwords.splitter())] == [0, 0, 0, 0]


def test_each_subword_before_a_position_counts(monkeypatch):
    """Not the first of a word alone: a change anywhere in the window changes what is said of the last."""
    rng, classes, table, flat = with_table(monkeypatch)
    scorer, rows = attention_lm.Scorer(flat, classes, table), rng.integers(0, 9, 12)

    def last(own):
        return np.diff(scorer.scores(np.append(own[:-1], own), np.array([11, 12])))[0]

    for k in range(11):
        other = rows.copy()
        other[k] += 1
        assert abs(last(other) - last(rows)) > 1e-5


def test_rows_shares_sum_to_one(monkeypatch):
    rng, classes, table, flat = with_table(monkeypatch)
    assert np.allclose(np.exp(table.classes).sum(axis=1), 1, atol=1e-5) and all(np.allclose(np.exp(x).sum(axis=1), 1, atol=1e-5) for x in table.rows.values())
    assert len(table.several) > 1
    scorer = attention_lm.Scorer(flat, classes, table)
    for size in (0, 1, 20, 40):
        rows = rng.integers(0, 10, size)
        every = np.concatenate([np.append(rows, k) for k in range(10)])
        before = scorer.scores(rows, np.array([size]))[0] if size else 0.0
        assert abs(np.exp(scorer.scores(every, np.full(10, size + 1), step=3) - before).sum() - 1) < 1e-3
    share = np.bincount(classes.row, weights=np.exp(classes.log_share), minlength=10)
    assert np.allclose(share[np.unique(classes.row)], 1)


def test_table_is_the_chain_and_the_beginnings(monkeypatch):
    """Against sums over single subwords."""
    rng, classes, _, _ = with_table(monkeypatch)
    firsts, found = rng.integers(0, 50, 30), rng.integers(0, 90, 30)
    table, chain = classes.table(firsts, found), np.exp(classes.chain.astype(float))
    for row in range(11):
        held = [s for s in range(29) if row < 10 and classes.row[s] == row]
        wanted = np.zeros(10)
        for s, part in [(s, (found[s] + 0.1) / sum(found[x] + 0.1 for x in held)) for s in held] or [(None, 1.0)]:
            over = 1.0 if s is None else chain[classes.last[s], 5]
            for t in range(30):
                wanted[classes.row[t]] += part * over * (firsts[t] + 0.1) / (firsts + 0.1).sum()
                if s is not None and t < 29:
                    wanted[classes.row[t]] += part * chain[classes.last[s], classes.next[t]] * math.exp(classes.log_next[t])
        got = np.array([table.classes[row, k] + (table.rows[k][row, r - table.low[k]] if k in table.rows else 0) for r, k in enumerate(classes.of_row[:10])])
        assert np.allclose(np.exp(got), wanted, atol=1e-5)


def test_gradient_with_rows(monkeypatch):
    rng, classes, table, flat = with_table(monkeypatch)
    rows, exact = rng.integers(0, 11, (3, attention_lm.WINDOW)), rng.integers(0, 10, (3, attention_lm.SCORED))
    weight, targets = rng.integers(0, 3, (3, attention_lm.SCORED)).astype(np.float32), classes.of_row[exact]
    table.classes, table.rows = table.classes.astype(float), {k: x.astype(float) for k, x in table.rows.items()}
    wide, loss = flat.astype(np.float64), lambda f: attention_lm.gradient(f, None, rows, targets, weight, table, exact)[0]
    _, grads = attention_lm.gradient(wide, None, rows, targets, weight, table, exact)
    for k in [*rng.choice(len(flat), 60, replace=False), *range(len(flat) - 40, len(flat))]:
        up, down = wide.copy(), wide.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert abs(slope - grads[k]) < 1e-5 * max(1, abs(slope))


def test_better_than_the_table_and_than_a_model_without_attention(spark, monkeypatch):
    """On held-out documents: the fitted model; one that was fitted with attention taking nothing; the table alone."""
    docs, fit, attention, sums = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), attention_lm.fit, attention_lm._attention, []

    def alone(w, rows):
        x, last, query, a, z, _ = attention(w, rows)
        return x, last, query, a * 0, z * 0, last

    def total():
        sums.append(attention_lm.scored(docs).where("held_out").agg(F.sum("score")).first()[0])

    total()
    monkeypatch.setattr(attention_lm, "fit", lambda *args: np.zeros_like(fit(*args)))
    total()
    assert sums[0] > 0.98 * sums[1]
    # in this process, where the patch is seen: the rows of all texts
    rows = docs.where("text is not null").select("doc_id", "text").toArrow()
    training = [not attention_lm.is_held_out(i) for i in rows["doc_id"].to_pylist()]
    texts, split = rows["text"].combine_chunks(), subwords.splitter()
    places, words, n_words = attention_lm.words_in(texts.filter(pa.array(training)))
    n, (ids, sizes) = np.bincount(places, minlength=len(words)), split(words.to_pylist())
    size = subwords.vocabulary_size() + 1
    firsts, found = np.bincount(ids[np.cumsum(sizes) - sizes], weights=n, minlength=size), np.bincount(ids, weights=np.repeat(n, sizes), minlength=size)
    firsts[-1] = found[-1] = len(n_words)
    classes = attention_lm.Classes(found, found, found)
    end = np.zeros(len(ids), bool)
    end[np.cumsum(sizes) - 1] = True
    after = np.where(end, attention_lm.NEXT, classes.next[np.append(ids[1:], 0)])
    classes.fit_chain(np.bincount(classes.last[ids].astype(np.int64) * (attention_lm.NEXT + 1) + after, weights=np.repeat(n, sizes), minlength=attention_lm.LAST * (attention_lm.NEXT + 1)).reshape(attention_lm.LAST, -1))
    table, lexicon = classes.table(firsts, found), attention_lm.Lexicon([], [], classes, subwords.TOKENIZER)
    own, sizes, *_ = lexicon.texts(places, words, n_words, split)
    chunks = [(x, 1) for part in np.split(own, np.cumsum(sizes)[:-1]) for x in attention_lm.chunks_of(part)]
    held, sizes, *_ = lexicon.texts(*attention_lm.words_in(texts.filter(pa.array([not x for x in training]))), split)
    got = []
    for way in (attention, alone):
        monkeypatch.setattr(attention_lm, "_attention", way)
        flat, _ = attention_lm.improve(attention_lm.first_weights(), classes.log_class, classes.of_row, chunks, 0, attention_lm.RATE, table)
        got.append(attention_lm.Scorer(flat, classes, table).scores(held, sizes).sum())
    assert got[0] > 0.99 * got[1]


def test_steps_use_memory_again(monkeypatch):
    """A step in a space gives what one by itself gives, of any size, and takes little new memory."""
    rng, classes, table, flat = with_table(monkeypatch)

    def step(n, space):
        rows, exact = rng.integers(0, 11, (n, attention_lm.WINDOW)), rng.integers(0, 10, (n, attention_lm.SCORED))
        weight = rng.integers(0, 3, (n, attention_lm.SCORED)).astype(np.float32)
        own = lambda *x: attention_lm.gradient(flat, None, rows, classes.of_row[exact], weight, table, exact, *x)
        alone = own()
        tracemalloc.start()
        loss, grads = own(space)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert loss == alone[0] and np.array_equal(grads, alone[1])
        return peak

    space = attention_lm.Space()
    first = step(128, space)
    assert step(128, space) < first / 2
    step(3, space)


def test_texts_are_cut_once(spark, monkeypatch):
    """Training takes the rows that are scored, and not the texts again."""
    docs, fit, held = spark.createDataFrame([(i, None if i == 3 else f"strawberry number{i} a") for i in range(20)], "doc_id long, text string"), attention_lm.fit, []
    monkeypatch.setattr(attention_lm, "fit", lambda *args: held.append(args) or fit(*args))
    scores = {r.doc_id: r.score for r in attention_lm.scored(docs).collect()}
    texts, lexicon, table = held[0]
    own = {r.doc_id: (r.held_out, np.frombuffer(r.rows, np.int16), r.share) for r in texts.collect()}
    assert own.keys() == scores.keys() == set(range(20))
    encode, classes = subwords.ids_of(), lexicon.classes
    for i, (held_out, rows, share) in own.items():
        ids = [k for w in ([] if i == 3 else [b"strawberry", f"number{i}".encode(), b"a"]) for k in encode(w)]
        assert held_out == attention_lm.is_held_out(i) and rows.tolist() == classes.row[[*ids, -1]].tolist()
        assert abs(share - classes.log_share[ids].sum()) < 1e-9
