"""The best documents of each benchmark item by a lexical score, found in tries of restricted term vectors.

Of each document only the terms that items hold are kept, with how often it
has them. A task puts its documents, some ten thousand at a time, into a tree: the terms of
a vector stand in one order, by their frequency in the corpus, so that documents with the same first
terms share a path. A node knows for its whole subtree the greatest count of
each term and the least length norm m, and so a bound on any score in
it. For an item the tree is searched depth first, the child of the greatest bound first, and
a subtree is left out if its bound can't enter the item's best k so far; these
are kept from tree to tree of a task. Small subtrees are leaves, whose documents are scored exactly.
The best of each task, k rows an item at most, are then ranked together.

The score: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), a document's
m is 25 + (75 n N) div L, and the score sums w ((10^9 tf) div (1000 tf + 8 m)) over
the item's terms, repeats included. N counts documents with a term, L
all their terms, n a document's own, df the documents with a term.

Vectors are computed once and written; frequencies are counted from them in each task
before they are added up. Items are sent in blocks of a bounded number of characters, of
which there may be any number. Nothing but the best rows of each task is shuffled.

Defined results: null and empty texts have no terms and are never found; null
and empty items have no rows; a row counts as a document, so repeated rows are
each ranked; equal scores by ascending id, null ids last; repeated items count
once, two texts of one item id are ranked each by itself; with empty tables there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabularium.llm.common import batches, staged
from tabularium.llm.decontam import _TO_WORDS, words_of

TOP = 10
#: Characters of item text in a block; documents and vector entries in a tree; documents in a leaf.
BLOCK_CHARS, TREE_DOCS, TREE_ENTRIES, LEAF = 1 << 22, 1 << 15, 1 << 23, 32
#: Bytes of texts whose words are split at once.
SLICE = 1 << 21
#: Stands for a null id, after all others.
_LAST = np.iinfo(np.int64).max

_VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"


def _restricted(texts: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text how many terms it has and how many wanted ones; then, text by text, the numbers of these, ascending, and their counts."""
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    flat = body[ends[0] : ends[-1]].to_pybytes().translate(_TO_WORDS) if body is not None and ends[-1] > ends[0] else b""
    ends = ends - ends[0]
    n, keys, start = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], 0
    while start < len(flat):
        # a slice ends before a space, or with a text
        end = flat.find(b" ", start + SLICE)
        end = len(flat) if end < 0 else end
        border = np.searchsorted(ends, start + SLICE)
        end = min(end, int(ends[border])) if border < len(ends) else end
        part = np.frombuffer(flat, np.uint8)[start:end]
        inside = part != 32
        begins = inside & np.append(True, ~inside[:-1])
        own = ends[(ends >= start) & (ends < end)] - start
        begins[own] = inside[own]  # a word ends with its text
        at = np.flatnonzero(begins)
        if len(at):
            letters = part[inside]
            offsets = np.append(np.cumsum(inside)[at] - 1, len(letters)).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
            text = np.searchsorted(ends, at + start, side="right") - 1
            n += np.bincount(text, minlength=len(n))
            found = pc.index_in(words, value_set=wanted)
            some = found.is_valid().to_numpy(zero_copy_only=False)
            keys.append(text[some] * len(wanted) + found.drop_null().to_numpy())
        start = end
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    return n, np.bincount(keys // max(1, len(wanted)), minlength=len(n)), keys % max(1, len(wanted)), counts


def vectors(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with a term: its id, how many terms it has, and which of the given ones how often; written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.large_binary())
        for batch in batches(rows):
            n, sizes, codes, counts = _restricted(batch.column(1).cast(pa.large_string()), wanted)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (codes, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return staged(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _VECTOR), "vectors")


def _frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term is."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in rows:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for term, n in found.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # as many rows as terms of a block
        out[term] = n
    return out


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in an item adds, before its weight; it rises with tf and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Documents in the order of their vectors, and the nodes over them."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, leaf: int = LEAF):
        """places: the terms' places in the order of frequency, ascending in each document; all documents one after the other."""
        begins = np.cumsum(sizes) - sizes
        wide = places.astype(">u4")
        keys = [wide[a : a + n].tobytes() for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
        order = np.array(sorted(range(len(keys)), key=lambda d: (keys[d], m[d], ids[d])), np.int64)
        self.ids, self.m, self.sizes = ids[order], m[order], sizes[order]
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)
        take = np.arange(int(sizes.sum())) + np.repeat(begins[order] - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        self.places, self.counts = places[take], counts[take]
        self.begins = np.append(0, np.cumsum(self.sizes))
        self._nodes(leaf)
        self._limits()

    def _nodes(self, leaf: int) -> None:
        """low, high: the documents of a node; first, last: its children, none for a leaf; children come after their parent."""
        low, high, depth, first, last = [0], [len(self.ids)], [0], [], []
        for node, (a, b) in enumerate(zip(low, high, strict=True)):  # the lists grow meanwhile
            start = len(low)
            while b - a > leaf:
                # the next term of each document; those whose vector ends here come first
                at = self.begins[a:b] + depth[node]
                following = np.where(at < self.begins[a + 1 : b + 1], self.places[np.minimum(at, len(self.places) - 1)], -1)
                cuts = np.flatnonzero(np.diff(following)) + 1
                if len(cuts):
                    ends = np.append(cuts, b - a) + a
                    begin = a
                    for k, end in enumerate(ends.tolist()):
                        # small neighbours share a node, whose path is that of their parent
                        small = k + 1 < len(ends) and ends[k + 1] - begin <= leaf
                        if not small:
                            low.append(begin)
                            high.append(end)
                            depth.append(depth[node])
                            begin = end
                    break
                if following[0] < 0:  # equal vectors can't be told apart by further terms
                    break
                depth[node] += 1  # all share the next term
            first.append(start)
            last.append(len(low))
        self.low, self.high, self.first, self.last = (np.array(x, np.int64) for x in (low, high, first, last))

    def _limits(self) -> None:
        """For each term the nodes that hold it, with its greatest count there; least m and least id of each node."""
        n, least = len(self.low), lambda x: np.array([x[a:b].min() for a, b in zip(self.low, self.high, strict=True)], np.int64)
        self.least_m, self.least_id = least(self.m), least(self.ids)
        parent = np.zeros(n, np.int64)
        for node in range(n):
            parent[self.first[node] : self.last[node]] = node
        # the greatest counts of the nodes without children, then those of parents, from the last to the first
        held: list[tuple[np.ndarray, np.ndarray]] = [None] * n
        waiting: dict[int, list] = {}
        for node in range(n - 1, -1, -1):
            if self.first[node] == self.last[node]:
                a, b = self.begins[self.low[node]], self.begins[self.high[node]]
                terms, counts = self.places[a:b], self.counts[a:b]
            else:
                parts = waiting.pop(node)
                terms, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.lexsort((-counts, terms))
            terms, counts = terms[by], counts[by]
            new = np.append(True, terms[1:] != terms[:-1])[: len(terms)]
            held[node] = terms[new], counts[new]
            if node:
                waiting.setdefault(int(parent[node]), []).append(held[node])
        terms = np.concatenate([t for t, _ in held])
        by = np.argsort(terms, kind="stable")
        self.limit_terms, self.limit_counts = terms[by], np.concatenate([c for _, c in held])[by]
        self.limit_nodes = np.repeat(np.arange(n), [len(t) for t, _ in held])[by]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a score that none of its documents exceeds."""
        out = np.zeros(len(self.low), np.int64)
        for a, b, w in zip(np.searchsorted(self.limit_terms, terms, "left").tolist(), np.searchsorted(self.limit_terms, terms, "right").tolist(), weights.tolist(), strict=True):
            nodes = self.limit_nodes[a:b]  # each once
            out[nodes] += w * gain(self.limit_counts[a:b], self.least_m[nodes])
        return out

    def scores(self, low: int, high: int, weight_of: np.ndarray) -> np.ndarray:
        """The exact scores of the documents from low to high."""
        a, b = self.begins[low], self.begins[high]
        weights = weight_of[self.places[a:b]]
        own = np.flatnonzero(weights)
        docs = self.owner[a:b][own]
        out = np.zeros(high - low, np.int64)
        np.add.at(out, docs - low, weights[own] * gain(self.counts[a:b][own], self.m[docs]))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, weight_of: np.ndarray, best: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
        """The best k (negative score, id), ascending, of those given and of this tree; how many documents were scored."""
        bounds, looked = self.bounds(terms, weights), 0
        stack = [0]
        while stack:
            node = stack.pop()
            if not bounds[node] or len(best) == k and (-int(bounds[node]), int(self.least_id[node])) >= best[-1]:
                continue
            if self.first[node] < self.last[node]:
                children = np.arange(self.first[node], self.last[node])
                stack += children[np.argsort(bounds[children], kind="stable")].tolist()
                continue
            low, high = int(self.low[node]), int(self.high[node])
            scores = self.scores(low, high, weight_of)
            looked += high - low
            least = -best[-1][0] if len(best) == k else 1
            some = np.flatnonzero(scores >= max(1, least))
            if len(some) > k:  # of many copies only the first ones by score and id can stay
                some = some[np.lexsort((self.ids[low:high][some], -scores[some]))[:k]]
            best = sorted(best + list(zip((-scores[some]).tolist(), self.ids[low:high][some].tolist(), strict=True)))[:k]
        return best, looked


def top_documents(docs: DataFrame, benchmark: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, tree_docs: int = TREE_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item with a score above 0."""
    spark, kind = docs.sparkSession, benchmark.schema[item_id].dataType
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        asked = [(i, words_of(t.encode())) for i, t in own.collect()]  # block_chars or so
        asked = sorted(((i, w) for i, w in asked if w), key=repr)
        terms = sorted({w for _, words in asked for w in words})
        found = vectors(docs, terms, doc_id, text)
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        parts.append(_best(found, asked, terms, n_docs, n_terms or 0, k, kind, tree_docs).withColumn("_block", F.lit(block)))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    first = Window.partitionBy("_block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _best(found: DataFrame, asked: list, terms: list[bytes], n_docs: int, n_terms: int, k: int, kind: T.DataType, tree_docs: int) -> DataFrame:
    """The k best of each item in each task."""
    number = {t: j for j, t in enumerate(terms)}
    df = _frequencies(found, len(terms))
    frequent = np.argsort(-df, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[frequent] = np.arange(len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    wanted = []
    for i, words in asked:
        own, times = np.unique(np.array([number[w] for w in words], np.int64), return_counts=True)
        some = (df[own] > 0) & (weight[own] > 0)
        wanted.append((i, place[own[some]], (times * weight[own])[some]))
    sent = found.sparkSession.sparkContext.broadcast((place, wanted))
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    kinds = [pa.int32(), to_arrow_type(kind), pa.int64(), pa.int64()]

    def norms(n: np.ndarray) -> np.ndarray:
        if 75 * int(n.max(initial=0)) * n_docs < 1 << 63:
            return 25 + 75 * n * n_docs // n_terms
        return np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, wanted = sent.value
        best: list[list] = [[] for _ in wanted]
        weight_of = np.zeros(len(place), np.int64)
        held, n_held, n_entries = [], 0, 0

        def searched() -> None:
            ids, n, sizes, codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            places = place[codes]
            by = np.lexsort((places, np.repeat(np.arange(len(sizes)), sizes)))
            tree = Tree(ids, norms(n), sizes, places[by], counts[by])
            for j, (_, own, weights) in enumerate(wanted):
                weight_of[own] = weights
                best[j], _ = tree.search(own, weights, weight_of, best[j], k)
                weight_of[own] = 0

        for batch in rows:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes = part.column(2).value_lengths().fill_null(0).to_numpy().astype(np.int64)
                arrays = [part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3)]
                held.append((part.column(0).fill_null(_LAST).to_numpy(), part.column(1).to_numpy(), sizes, *arrays))
                n_held, n_entries = n_held + part.num_rows, n_entries + len(arrays[0])
                if n_held >= tree_docs or n_entries >= TREE_ENTRIES:
                    searched()
                    held, n_held, n_entries = [], 0, 0
        if held:
            searched()
        out = [(j, wanted[j][0], None if i == _LAST else i, -s) for j, own in enumerate(best) for s, i in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    # documents that hold none of the terms are counted, and never found
    return found.where(F.size("terms") > 0).mapInArrow(run, schema)
