"""Language-model scores: a causal self-attention model over subword ids, trained here in numpy.

The model. A text is the subwords of its words and one end. Each is predicted
from all that stand before it in its window: one head of causal self-attention
runs over every subword, and its logits are added to the logarithms of a table
of what follows the last subword. The table is counted over all training words:
within words by the chain (what follows a subword, or the end of the word),
after words by the shares of words' beginnings. Frequent subwords have a row of
their own, the others share ROWS_SHARED rows of about equal weight. A row is
predicted in two steps: its class, then the row among those of the class (most
classes are one row). A subword's share of its row comes from its count.

A text is cut into overlapping windows: the last SCORED positions of a window
are predicted, those before them are context, so each subword is scored once,
with at least CONTEXT subwords before it where the text has them. Windows are
scored in batches under one mask. There is one head, so the matrices of queries
and keys are held as their product, and so are those of values and output.

Training. Documents whose crc32(id) mod 10 is 0 are held out. All others are
counted, and the weights of the attention are fitted on all their windows:
texts become chunks of subwords' rows, equal chunks become one with its number as
weight, and each chunk goes to the task that a hash of it names, so the
weights depend neither on files nor on partitions. Each round takes its part of
all chunks; each task improves the weights on its own by Adam, and the mean of
all tasks, weighted by their windows, goes on to the next round.

Texts are cut into subwords once; their rows are written for training and scoring.
Base scores take each word's count. Counts of frequent words are sent to the
executors (at most SENT words); tokens of all other words go through a join.

Defined results: null and empty texts are the end token alone; null ids are
training documents; repeated rows count and are scored once each; without any
training text all counts are zero and the model is even over its classes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import batches, discard, staged
from tabularium.llm.subwords import TOKENIZER, splitter, vocabulary_size

#: Words hold no white space, so this stands for the end token.
END = b"\n"
ADD = 0.1
HELD_OUT_OF = 10
#: Frequent words sent to the executors, and bytes of text whose words are counted or looked up, or scored together.
SENT, TOGETHER, SCORED_TOGETHER = 100_000, 1 << 23, 1 << 22

CONTEXT, SCORED, WIDTH = 16, 32, 16
WINDOW = CONTEXT + SCORED
#: Classes of rows, and how many of them are of several rows; rows of subwords, and how many of them are of several subwords.
CLASSES, SHARED, ROWS, ROWS_SHARED = 48, 24, 1024, 64
#: The same for the chain: what comes next, and what it depends on.
NEXT, NEXT_SHARED, LAST, LAST_SHARED = 1024, 64, 2048, 64
#: What each word's count loses to the chain, and what a row of the chain counts as seen of the shares of all subwords.
DISCOUNT, PRIOR = 0.75, 50.0
#: Subwords of a chunk of training text, of a task, and chunks that a task mixes before it cuts batches.
CHUNK, TASK_SUBWORDS, MIXED = 1024, 8_000_000, 64
ROUNDS, BATCH, RATE, SLOWER, DECAY = 2, 128, 0.02, 100.0, 0.002
#: Values of a weight array that are averaged together.
PART = 4096
LN10 = float(np.log(10.0))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == 0


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts one after the other, as places in a list of different words; that list; and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))  # of large strings this is wrong where an array is a slice
    flat, full = lists.flatten(), pc.greater(pc.binary_length(lists.flatten()), 0)
    n_words = np.diff(np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()), n_words


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents, with END for their ends."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TOGETHER):
            training = pa.array([not is_held_out(i) for i in batch.column(0).to_pylist()], pa.bool_())
            places, words, n_words = words_in(batch.column(1).filter(training))
            counts = np.append(np.bincount(places, minlength=len(words)), len(n_words))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.large_binary())]).cast(pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def _sums(counts: DataFrame, cells: int, of_words) -> np.ndarray:  # noqa: ANN001
    """Sums over all words into so many cells; of_words(words, n, total) adds those of a batch, without the end, to total."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, add = np.zeros(cells, np.int64), of_words()
        for batch in rows:
            kept = batch.filter(pc.not_equal(batch.column(0), pa.scalar(END, batch.column(0).type)))
            if kept.num_rows:
                add(kept.column(0).to_pylist(), kept.column(1).to_numpy(), total)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])

    sums = counts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # as many rows as cells, whatever the corpus holds
    out = np.zeros(cells, np.int64)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def subword_counts(counts: DataFrame, ends: int, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By subword id (the last is the end): words that begin with it, different words that do, and how often it is found."""
    size = vocabulary_size(tokenizer) + 1

    def of_words():  # noqa: ANN202
        split = splitter(tokenizer)

        def add(words: list[bytes], n: np.ndarray, total: np.ndarray) -> None:
            ids, sizes = split(words)
            first = ids[np.cumsum(sizes) - sizes]
            np.add.at(total, first, n)
            np.add.at(total, size + first, 1)
            np.add.at(total, 2 * size + ids, np.repeat(n, sizes))

        return add

    out = _sums(counts, 3 * size, of_words).reshape(3, size)
    out[:, -1] = ends, ends > 0, ends
    return tuple(out)


def ranked(weight: np.ndarray, classes: int, shared: int, order: np.ndarray | None = None) -> np.ndarray:
    """A class for each id: the heaviest (first in order) have one of their own, the others share classes of about equal weight."""
    order, single = np.argsort(-weight, kind="stable") if order is None else order, classes - shared
    out = np.empty(len(weight), np.int32)
    out[order[:single]] = np.arange(min(single, len(order)))
    rest = order[single:]
    if len(rest):
        at = np.cumsum(weight[rest]) / weight[rest].sum()
        out[rest] = single + np.minimum((at * shared).astype(int), shared - 1)
    return out


class Classes:
    """Of each subword: its row, the row's class, and its place in the chain.

    own is by what rows and classes are ranked; the model takes how often each subword is found, as the third.
    """

    def __init__(self, own: np.ndarray, types: np.ndarray, found: np.ndarray):
        weight = own + ADD
        alone = weight.copy()
        alone[-1] = weight.max() + 1  # the end is a class of its own
        self.row = ranked(alone, ROWS, ROWS_SHARED)
        of_row = ranked(np.bincount(self.row, weights=weight, minlength=ROWS), CLASSES, SHARED, np.arange(ROWS))
        self.of, self.of_row = of_row[self.row], np.append(of_row, 0)  # the last row is before the text
        total = np.bincount(self.of, weights=weight, minlength=CLASSES)
        self.log_first = np.log(weight / total[self.of])
        self.log_share = np.log(weight / np.bincount(self.row, weights=weight, minlength=ROWS)[self.row])
        self.log_class = np.log(np.maximum(total, ADD) / np.maximum(total, ADD).sum()).astype(np.float32)
        seen, kinds = (np.bincount(self.of, weights=x, minlength=CLASSES) for x in (own, types))
        # a word of class k has max(count - DISCOUNT, 0) * per_word[k] + exp(log_for_chain[k] + log_chain())
        self.per_word = np.where(seen > 0, 1 / np.maximum(seen, 1), 0.0)
        self.log_for_chain = np.log(np.where(kinds * seen > 0, DISCOUNT * kinds * self.per_word, 1.0))
        # the end takes no part in the chain
        body = found[:-1] + ADD
        self.next, self.last = ranked(body, NEXT, NEXT_SHARED), ranked(body, LAST, LAST_SHARED)
        self.log_next = np.log(body / np.bincount(self.next, weights=body, minlength=NEXT)[self.next])
        self.chain: np.ndarray | None = None

    def fit_chain(self, pairs: np.ndarray) -> None:
        """From pairs[row, class]: how often each class, or at last the end of the word, follows a row."""
        shares = (pairs.sum(axis=0) + ADD) / (pairs.sum() + ADD * pairs.shape[1])
        self.chain = np.log((pairs + PRIOR * shares) / (pairs.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)

    def log_chain(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The logarithm of each word's share of its class by the chain alone; words as a splitter() has them."""
        if not len(sizes):
            return np.zeros(0)
        stop = np.cumsum(sizes)
        first, end = stop - sizes, np.zeros(len(ids), bool)
        end[stop - 1] = True
        following = np.append(ids[1:], 0)
        step = self.chain[self.last[ids], np.where(end, NEXT, self.next[following])] + np.where(end, 0.0, self.log_next[following])
        return np.add.reduceat(step.astype(float), first) + self.log_first[ids[first]]

    def table(self, firsts: np.ndarray, found: np.ndarray) -> Table:
        """From the fitted chain and words' beginnings (and ends of texts, at last): the share of each row after each row, and before a text."""
        body, start = found[:-1] + ADD, np.bincount(self.row, weights=firsts + ADD, minlength=ROWS)
        into, after = np.zeros((NEXT, ROWS)), np.zeros((ROWS + 1, LAST))
        np.add.at(into, (self.next, self.row[:-1]), np.exp(self.log_next))  # a class of the chain is of these rows
        np.add.at(after, (self.row[:-1], self.last), body)
        after /= np.maximum(after.sum(axis=1, keepdims=True), ADD)
        chain = after @ np.exp(self.chain.astype(float))
        over = np.where(after.any(axis=1), chain[:, NEXT], 1.0)  # after the end of a text, and before it, a word begins
        return Table(chain[:, :NEXT] @ into + over[:, None] * (start / start.sum()), self.of_row[:ROWS])


class Table:
    """Logarithms of the shares of classes after each row, and of the rows of a class within it; the rows of a class stand together."""

    def __init__(self, shares: np.ndarray, of_row: np.ndarray):
        self.low = np.searchsorted(of_row, np.arange(CLASSES + 1))
        self.several = np.flatnonzero(np.diff(self.low) > 1)
        shares = np.maximum(shares, 1e-12)
        total = np.stack([shares[:, low:high].sum(axis=1) for low, high in zip(self.low, self.low[1:], strict=False)], axis=1)
        self.classes = np.log(np.maximum(total, 1e-12) / total.sum(axis=1, keepdims=True)).astype(np.float32)
        self.rows = {k: np.log(shares[:, self.low[k] : self.low[k + 1]] / total[:, k, None]).astype(np.float32) for k in self.several}


class Space(dict):
    """Arrays that are used again and again: a task's steps are alike, and new memory for each costs more than the step."""

    def __call__(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        """An array of that name, shape and kind; it holds what its last user left."""
        size, flat = math.prod(shape), self.get(name)
        if flat is None or len(flat) < size or flat.dtype != kind:
            flat = self[name] = np.empty(size, kind)
        return flat[:size].reshape(shape)


class Within:
    """Of the targets in use whose class has several rows: the share of the row in its class. They stand by class, their logits one after the other."""

    def __init__(self, table: Table, inner: np.ndarray, h: np.ndarray, before: np.ndarray, classes: np.ndarray, exact: np.ndarray, use: np.ndarray, space: Space | None = None):
        width, self.space = np.diff(table.low), Space() if space is None else space
        at = np.flatnonzero((width > 1).take(classes) & use)
        at = self.at = at.take(np.argsort(classes.take(at).astype(np.int16), kind="stable"))
        classes, before = classes.take(at), before.take(at)
        own_width = width.take(classes)
        self.inner, self.h = inner, h.take(at, axis=0, out=self.space("own_h", (len(at), h.shape[1]), h.dtype), mode="clip")
        stop = np.cumsum(own_width)
        start = stop - own_width
        self.logits = self.space("within", (int(stop[-1]) if len(at) else 0,), h.dtype)
        added = self.space("added", self.logits.shape, h.dtype)
        bounds = np.searchsorted(classes, np.append(table.several, CLASSES)).tolist()
        #: Of each class its rows, its places in at, and its logits.
        self.parts = []
        for k, low, high in zip(table.several.tolist(), bounds, bounds[1:], strict=False):
            if high > low:
                rows, own, cells = slice(table.low[k], table.low[k + 1]), slice(low, high), slice(start[low], stop[high - 1])
                logits = self.logits[cells].reshape(high - low, -1)
                np.matmul(self.h[own], inner[rows].T, out=logits)
                table.rows[k].take(before[own], axis=0, out=added[cells].reshape(logits.shape), mode="clip")
                self.parts.append((rows, own, logits))
        self.logits += added
        np.clip(self.logits, -60, 60, out=self.logits)
        self.own = start + exact.take(at) - table.low.take(classes)
        self.right = self.logits.take(self.own)
        np.exp(self.logits, out=self.logits)
        self.total = np.empty_like(self.right)
        for _, own, logits in self.parts:
            np.matmul(logits, np.ones(logits.shape[1], h.dtype), out=self.total[own])
        self.right -= np.log(self.total)

    def add_gradient(self, use: np.ndarray, by_inner: np.ndarray, by_h: np.ndarray) -> None:
        use = use.take(self.at)
        scale = (use / self.total)[:, None]
        for _, own, logits in self.parts:
            logits *= scale[own]
        self.logits[self.own] -= use
        own_h = self.space("by_own_h", self.h.shape, self.h.dtype)
        for rows, own, logits in self.parts:
            np.matmul(logits.T, self.h[own], out=by_inner[rows])
            np.matmul(logits, self.inner[rows], out=own_h[own])
        by_h[self.at] += own_h


def chain_pairs(counts: DataFrame, classes: Classes, tokenizer: str) -> np.ndarray:
    """What fit_chain() takes, from all training words."""
    width = NEXT + 1

    def of_words():  # noqa: ANN202
        split = splitter(tokenizer)

        def add(words: list[bytes], n: np.ndarray, total: np.ndarray) -> None:
            ids, sizes = split(words)
            end = np.zeros(len(ids), bool)
            end[np.cumsum(sizes) - 1] = True
            after = np.where(end, NEXT, classes.next[np.append(ids[1:], 0)])
            np.add.at(total, classes.last[ids].astype(np.int64) * width + after, np.repeat(n, sizes))

        return add

    return _sums(counts, LAST * width, of_words).astype(float).reshape(LAST, width)


class Lexicon:
    """What executors know of words: those that are sent, with their counts, and how others are looked up."""

    def __init__(self, words: list[bytes], n: list[int], classes: Classes, tokenizer: str):
        self.classes = classes
        self.words, self.n = pa.array([w for w in words if w != END], pa.large_binary()), np.array([x for w, x in zip(words, n, strict=True) if w != END], np.int64)
        self.ends = dict(zip(words, n, strict=True)).get(END)
        self.rows, self.sizes, self.share = self._looked_up(self.words.to_pylist(), splitter(tokenizer))
        self.start = np.cumsum(self.sizes) - self.sizes

    def _looked_up(self, words: list[bytes], split) -> tuple[np.ndarray, ...]:  # noqa: ANN001
        """The rows of all subwords of the words, one after the other; of each word how many, and the sum of their shares' logarithms."""
        ids, sizes = split(words)
        share = np.add.reduceat(self.classes.log_share[ids], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)
        return self.classes.row[ids].astype(np.int16), sizes, share

    def texts(self, places: np.ndarray, words: pa.Array, n_words: np.ndarray, split) -> tuple[np.ndarray, ...]:  # noqa: ANN001
        """Texts as words_in() has them: the rows of all their subwords and ends; of each text how many; of each word of the list
        the sum of its shares' logarithms, and the count if it was sent (else -1)."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        other, n = at < 0, len(words)
        rows, sizes, share = self._looked_up(words.filter(pa.array(other)).to_pylist(), split)
        # of the list's words, and at last the end: where the rows begin, and how many
        start, size, shares = (np.append(np.append(x, 0)[at], last) for x, last in ((self.start, len(self.rows) + len(rows)), (self.sizes, 1), (self.share, 0.0)))
        start[:n][other], size[:n][other], shares[:n][other] = len(self.rows) + np.cumsum(sizes) - sizes, sizes, share
        rows = np.concatenate([self.rows, rows, self.classes.row[-1:].astype(np.int16)])
        own = np.insert(places.astype(np.int32), np.cumsum(n_words), n)
        sizes = size[own]
        stop = np.cumsum(sizes)
        every = rows[np.repeat((start[own] - stop + sizes).astype(np.int32), sizes) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)]
        return every, np.diff(stop[np.cumsum(n_words + 1) - 1], prepend=0), shares[:n], np.append(self.n, -1)[at]


#: The weights, by name, with their shapes; they travel as one flat array. The last row of embeddings is what stands before a text.
SHAPES = {"embed": (ROWS + 1, WIDTH), "place": (WINDOW, WIDTH), "look": (WIDTH, WIDTH), "take": (WIDTH, WIDTH), "out": (WIDTH, CLASSES), "inner": (ROWS, WIDTH)}
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())


class Weights(dict):
    """Weights by name, and the space that steps with them work in."""

    space: Space


def unflat(flat: np.ndarray, space: Space | None = None) -> Weights:
    out, at = Weights(), 0
    out.space = Space() if space is None else space
    for name, shape in SHAPES.items():
        size = math.prod(shape)
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def first_weights(seed: int = 7) -> np.ndarray:
    flat = np.random.default_rng(seed).normal(0, 0.1, N_WEIGHTS).astype(np.float32)
    w = unflat(flat)
    w["take"] += np.eye(WIDTH, dtype=np.float32)
    w["out"] *= 0.1
    w["inner"] *= 0.1
    return flat


#: What a scored position may look at: the word before the one it predicts, and what is before that.
MASK = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)


def windows_of(start: np.ndarray, sizes: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs[w, WINDOW], targets[w, SCORED], window's text): places of texts in one array, -1 for none.

    Of a text, sizes words from start on are predicted, and lead words before them are known.
    """
    parts = -(-sizes // SCORED)
    text = np.repeat(np.arange(len(sizes)), parts)
    first = ((np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * SCORED)[:, None]
    begin, size, known = start[text][:, None], sizes[text][:, None], lead[text][:, None]
    place, before = first + np.arange(SCORED), first + np.arange(-CONTEXT - 1, SCORED - 1)
    return np.where((before >= -known) & (before < size), begin + before, -1), np.where(place < size, begin + place, -1), text


def _attention(w: Weights, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, the scored positions of x, their queries, the attention, what it took, and the hidden states; all are in the space of the weights."""
    n, kind = len(rows), w["embed"].dtype
    x, last, query, z, h = (w.space(name, (n, size, WIDTH), kind) for name, size in (("x", WINDOW), ("last", SCORED), ("query", SCORED), ("z", SCORED), ("h", SCORED)))
    a, flat = w.space("a", (n, SCORED, WINDOW), kind), (-1, WIDTH)
    w["embed"].take(rows, axis=0, out=x, mode="clip")
    x += w["place"]
    last[:] = x[:, CONTEXT:]
    np.matmul(last.reshape(flat), w["look"], out=query.reshape(flat))
    np.matmul(query, x.transpose(0, 2, 1), out=a)
    np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= MASK
    a *= (1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, kind))).reshape(n, SCORED, 1)
    np.matmul(a, x, out=z)
    np.matmul(z.reshape(flat), w["take"], out=h.reshape(flat))
    h += last
    return x, last, query, a, z, h


def _softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In place of the logits their exponentials; their sums; and the logarithm of the share at each one's own place."""
    np.clip(logits, -60, 60, out=logits)
    right = logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, total, right - np.log(total)


def _class_logits(w: Weights, h: np.ndarray, base: np.ndarray, before: np.ndarray, table: Table | None) -> np.ndarray:
    """What the hidden states say of the classes, added to the table's row for what stands before, or without a table to base."""
    logits = np.matmul(h, w["out"], out=w.space("logits", (len(h), CLASSES), h.dtype))
    logits += base if table is None else table.classes.take(before, axis=0, out=w.space("table", logits.shape, table.classes.dtype), mode="clip")
    return logits


def gradient(flat: np.ndarray, base: np.ndarray, rows: np.ndarray, targets: np.ndarray, weight: np.ndarray, table: Table | None = None, exact: np.ndarray | None = None, space: Space | None = None) -> tuple[float, np.ndarray]:
    """Mean loss, and its gradient, over windows: rows[b, WINDOW], classes targets and weight[b, SCORED]; base: logits without attention.

    With a table, it takes the place of base, and of classes of several rows the row itself, exact[b, SCORED], is predicted too.
    """
    w, grads = unflat(flat, space), np.zeros_like(flat)
    space, kind = w.space, flat.dtype
    g, own = unflat(grads, space), targets.ravel()
    x, last, query, a, z, h = _attention(w, rows)
    flat_h, flat_last, flat_z = (y.reshape(-1, WIDTH) for y in (h, last, z))
    before = rows[:, CONTEXT:].ravel()
    n = max(float(weight.sum()), 1.0)
    use = weight.ravel().astype(kind) / kind.type(n)
    p, total, right = _softmax(_class_logits(w, flat_h, base, before, table), own)
    loss = -float((right * use).sum())
    p *= (use / total)[:, None]
    p[np.arange(len(own)), own] -= use

    np.matmul(flat_h.T, p, out=g["out"])
    dh, dz, dq, added = (space(name, flat_h.shape, kind) for name in ("dh", "dz", "dq", "added_dx"))
    np.matmul(p, w["out"].T, out=dh)
    if table is not None:
        within = Within(table, w["inner"], flat_h, before, own, exact.ravel(), use > 0, space)
        loss -= float((within.right * use.take(within.at)).sum())
        within.add_gradient(use, g["inner"], dh)
    np.matmul(flat_z.T, dh, out=g["take"])
    np.matmul(dh, w["take"].T, out=dz)
    ds, dx = space("ds", a.shape, kind), space("dx", x.shape, kind)
    np.matmul(dz.reshape(z.shape), x.transpose(0, 2, 1), out=ds)
    ds -= np.einsum("ij,ij->i", dz, flat_z).reshape(*z.shape[:2], 1)
    ds *= a
    np.matmul(ds, x, out=dq.reshape(z.shape))
    np.matmul(a.transpose(0, 2, 1), dz.reshape(z.shape), out=dx)
    dx += np.matmul(ds.transpose(0, 2, 1), query, out=space("by_query", x.shape, kind))
    np.matmul(flat_last.T, dq, out=g["look"])
    np.matmul(dq, w["look"].T, out=added)
    added += dh
    dx[:, CONTEXT:] += added.reshape(z.shape)
    np.sum(dx, axis=0, out=g["place"])
    places = rows.ravel()
    order = np.argsort(places.astype(np.int16 if len(g["embed"]) < 1 << 15 else np.int64), kind="stable")
    sorted_rows = places.take(order)
    begins = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
    by_row = dx.reshape(-1, WIDTH).take(order, axis=0, out=space("by_query", (len(order), WIDTH), kind), mode="clip")
    g["embed"][sorted_rows[begins]] = np.add.reduceat(by_row, begins, axis=0)
    return loss, grads


class Adam:
    """Steps of falling length with decaying weights."""

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.t = flat.copy(), rate, 0
        self.m, self.v = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        rate = self.rate / np.sqrt(1 + self.t / SLOWER)
        self.flat -= np.float32(rate) * ((self.m / np.float32(1 - 0.9**self.t)) / (np.sqrt(self.v / np.float32(1 - 0.99**self.t)) + np.float32(1e-8)) + np.float32(DECAY) * self.flat)


def improve(flat: np.ndarray, base: np.ndarray, of_row: np.ndarray, chunks: Iterable[tuple[bytes, int]], seed: int, rate: float, table: Table | None = None) -> tuple[np.ndarray, int]:
    """The weights after a pass over chunks (see chunk()), each so many times, and the number of windows."""
    adam, rng, held, seen, space = Adam(flat, rate), np.random.default_rng(seed), [], 0, Space()

    def learn() -> int:
        rows = [np.frombuffer(x, np.int16) for x, _ in held]
        lead = np.array([int(x[0]) for x in rows])
        sizes = np.array([len(x) - 1 for x in rows]) - lead
        words = np.concatenate([*(x[1:] for x in rows), [ROWS]]).astype(np.int64)  # the last stands for what is before a text
        inputs, targets, text = windows_of(np.cumsum(sizes + lead) - sizes, sizes, lead)
        times = np.array([n for _, n in held], np.float32)[text]
        order = rng.permutation(len(text))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            own = targets[part]
            exact = words[own]
            adam.step(gradient(adam.flat, base, words[inputs[part]], of_row[exact], (own >= 0) * times[part, None], table, exact, space)[1])
        return len(order)

    for one in chunks:
        held.append(one)
        if len(held) == MIXED:
            seen += learn()
            held.clear()
    if held:
        seen += learn()
    return adam.flat, seen


def chunks_of(rows: np.ndarray) -> list[bytes]:
    """A text's rows in parts: how many are known before the part, these, and at most CHUNK to predict."""
    out = []
    for low in range(0, len(rows), CHUNK):
        lead = min(low, CONTEXT + 1)
        out.append(np.concatenate([[lead], rows[low - lead : low + CHUNK]]).astype(np.int16).tobytes())
    return out


def fit(texts: DataFrame, lexicon: Lexicon, table: Table) -> np.ndarray:
    """The weights, after some rounds of improving them in all tasks and averaging; a round has its part of all rows. texts: see prepared()."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((lexicon.classes.log_class, lexicon.classes.of_row, table))

    def cut(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array([x for part in batch.column(0).to_pylist() for x in chunks_of(np.frombuffer(part, np.int16))], pa.binary())], ["chunk"])

    chunks = staged(texts.where("not held_out").select("rows").mapInArrow(cut, "chunk binary").groupBy("chunk").agg(F.count(F.lit(1)).alias("times")), "chunks")
    n_subwords = chunks.agg(F.coalesce(F.sum(F.octet_length("chunk") / 2), F.lit(0))).first()[0]
    flat = first_weights()
    if not n_subwords:
        return flat
    tasks = max(1, -(-int(n_subwords) // TASK_SUBWORDS))
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(flat)

        def run(rows: Iterable[pa.RecordBatch], now=now, k=k) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = (x for batch in rows for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            base, of_row, table = sent.value
            flat, seen = improve(now.value, base, of_row, own, k, RATE / (1 + k), table)
            if seen:
                parts = [(flat[i : i + PART].astype(np.float64) * seen).tobytes() for i in range(0, len(flat), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "seen", "weights"])

        def mean(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in table["weights"].to_pylist())
            return pa.table({"part": table["part"][:1], "weights": [(total / sum(table["seen"].to_pylist())).tobytes()]})

        key = F.xxhash64("chunk")
        own = chunks.where(F.pmod(F.shiftright(key, 32), F.lit(ROUNDS)) == k).withColumn("task", F.pmod(key, F.lit(tasks)).cast("int"))
        dealt = own.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", F.xxhash64("chunk", F.lit(k)), "chunk").select("chunk", "times")
        parts = dealt.mapInArrow(run, "part int, seen long, weights binary").groupBy("part").applyInArrow(mean, "part int, weights binary").collect()  # the weights, whatever the corpus holds
        if parts:
            flat = np.concatenate([np.frombuffer(r.weights, np.float64) for r in sorted(parts, key=lambda r: r.part)]).astype(np.float32)
    discard(chunks)
    return flat


class Scorer:
    """Log probabilities of texts' rows of subwords; without a table, of the rows' classes."""

    def __init__(self, flat: np.ndarray, classes: Classes, table: Table | None = None):
        self.weights, self.base, self.of_row, self.table = unflat(flat), classes.log_class, classes.of_row, table

    def scores(self, rows: np.ndarray, sizes: np.ndarray, step: int = 256) -> np.ndarray:
        """For each text the natural logarithm; rows are those of all texts one after the other."""
        inputs, targets, text = windows_of(np.cumsum(sizes) - sizes, sizes, np.zeros_like(sizes))
        words, out = np.append(rows, ROWS).astype(np.int64), np.zeros(len(text))
        for low in range(0, len(text), step):
            own = targets[low : low + step]
            use, exact, before = own.ravel() >= 0, words[own.ravel()], words[inputs[low : low + step]]
            h = _attention(self.weights, before)[-1].reshape(-1, WIDTH)
            before, classes = before[:, CONTEXT:].ravel(), self.of_row.take(exact)
            right = _softmax(_class_logits(self.weights, h, self.base, before, self.table), classes)[2]
            if self.table is not None:
                within = Within(self.table, self.weights["inner"], h, before, classes, exact, use, self.weights.space)
                right[within.at] += within.right
            out[low : low + step] = np.where(use, right, 0).reshape(own.shape).sum(axis=1)
        return np.bincount(text, weights=out, minlength=len(sizes))


_PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, rows binary, word binary, times long"


def prepared(docs: DataFrame, lexicon: Lexicon, tokenizer: str, everything: bool, bottom: float) -> DataFrame:
    """Of each text the rows of its subwords and what is known of its words; and a row for each of its words that was not sent, with how often."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, split = sent.value, splitter(tokenizer)
        row = TaskContext.get().partitionId() << 33
        end_count = lexicon.ends if lexicon.ends is not None else 0 if everything else -1
        names, kinds = zip(*(x.split() for x in _PARTS.split(", ")), strict=True)
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}[x] for x in kinds]
        for batch in batches(rows, TOGETHER):
            places, words, n_words = words_in(batch.column(1))
            k, (rows_of, sizes, share, n) = len(n_words), lexicon.texts(places, words, n_words, split)
            text, n = np.repeat(np.arange(k), n_words), n[places]
            if everything:
                n = np.maximum(n, 0)
            sure = n >= 0
            base = np.bincount(text[sure], weights=np.log10(n[sure] + ADD) - bottom, minlength=k)
            known = np.bincount(text[sure & (n > 0)], minlength=k)
            if end_count >= 0:
                base, known = base + np.log10(end_count + ADD) - bottom, known + (end_count > 0)
            held = [is_held_out(i) for i in batch.column(0).to_pylist()]
            offsets = pa.array(np.append(0, np.cumsum(sizes) * 2), pa.int32())
            own = pa.Array.from_buffers(pa.binary(), k, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows_of))])
            shares = np.bincount(text, weights=share[places], minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(k)), batch.column(0), pa.array(held, pa.bool_()), pa.array(n_words + 1), pa.array(known), pa.array(base, pa.float64()), pa.array(shares, pa.float64()), own, *(pa.nulls(k, x) for x in kinds[8:])], names)
            # words that were not sent: each of a text's once, with how often
            unsure = np.flatnonzero(~sure)
            pairs, first, times = np.unique(text[unsure] * len(words) + places[unsure], return_index=True, return_counts=True)
            rest = [row + text[unsure[first]], words.take(pa.array(pairs % max(1, len(words)))).cast(pa.binary()), times]
            if end_count < 0:
                rest = [np.append(rest[0], row + np.arange(k)), pa.concat_arrays([rest[1], pa.array([END] * k, pa.binary())]), np.append(times, np.ones(k, int))]
            m = len(rest[0])
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(rest[0]), *(pa.nulls(m, x) for x in kinds[1:8]), rest[1], pa.array(rest[2])], names)
            row += k

    return docs.mapInArrow(run, _PARTS)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, docs = docs.sparkSession, _prepared(docs, doc_id, text)
    counts = staged(word_counts(docs), "words")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    firsts, types, found = subword_counts(counts, ends, tokenizer)
    classes = Classes(found, types, found)
    classes.fit_chain(chain_pairs(counts, classes, tokenizer))
    table = classes.table(firsts, found)

    level, held = 0, 0
    for bits, n in sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect(), reverse=True):  # 64 rows at most
        held += n
        if held > SENT:
            level = bits + 1
            break
    frequent = counts.where(F.col("n") >= 1 << level).toArrow()  # SENT rows at most
    everything = level == 0
    lexicon = Lexicon(frequent["word"].to_pylist(), frequent["n"].to_pylist(), classes, tokenizer)
    bottom = float(np.log10(total + ADD * (distinct + 1)))
    parts = staged(prepared(docs, lexicon, tokenizer, everything, bottom), "parts")
    texts = parts.where("rows is not null")
    flat = fit(texts, lexicon, table)
    sent = spark.sparkContext.broadcast((flat, classes, table))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches(rows, SCORED_TOGETHER):
            own = batch.column(6).to_pylist()
            every, sizes = np.frombuffer(b"".join(own), np.int16), np.array([len(x) // 2 for x in own])
            score = (scorer.scores(every, sizes) + batch.column(5).to_numpy()) / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], ["row", "doc_id", "n_tokens", "n_known", "base", "score"])

    out = texts.select("row", "doc_id", "n_tokens", "n_known", "base", "share", "rows").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double")
    if not everything:
        rare = parts.where("word is not null").select("row", "word", "times").join(counts.where(F.col("n") < 1 << level), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        added = rare.select("row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * (F.log10(F.col("n") + ADD) - bottom)).alias("base"))
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        both = out.unionByName(added.select("row", none("doc_id", "long"), none("n_tokens", "long"), "n_known", "base", none("score", "double")))
        out = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.max("score").alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
