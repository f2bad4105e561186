"""Benchmark decontamination on a positional inverted index of the training tokens.

The index is a table of segments. A segment holds the postings of all tokens
of some documents: its terms, how often each is found, and for each term the
ascending positions, as differences in blocks that are unpacked one by one.
Windows of a benchmark item are looked up in each segment by themselves, so
nothing is shuffled: the postings of a window's rarest term (by its frequency
in the whole corpus) give the starts that are possible; from rare to frequent
the sorted list of each further term, shifted by the term's offset, is
intersected with them; what is left are exact matches. The list of a term is
read only when a window that holds the term still has a possible start.

Proximity matches are documents without exact match of an item in which at
least near_least() of the item's NEAR_TERMS rarest terms stand within NEAR_WORDS
words after one of them. Terms that the corpus lacks don't count, and items
with a single term have none.

The benchmark is looked up in blocks of bounded size, each sent to the
executors as a whole; there is no limit on the number of blocks.

Defined results: null and empty texts have no words; documents without words
give a row with zeros; null ids of documents are kept; items with a null id
hit words like others, but no list of items names them; repeated items count
once, and so do windows that items share or repeat; empty tables give no rows
or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import byte_values, fresh, staged

WINDOW = 10
#: Words of a segment, and characters of benchmark text in a block.
SEGMENT_WORDS, BLOCK_CHARS = 1 << 18, 1 << 22
#: For proximity: how many of an item's rarest terms are looked at, and within how many words.
NEAR_TERMS, NEAR_WORDS = 6, 25
#: Possible starts that are looked at together, and postings that are packed together.
STARTS, PACKED = 1 << 20, 1 << 12

#: Letters in lower case, other word bytes as they are, the rest as a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEGMENT = "segment long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, steps array<binary>"


def near_least(n: int) -> int:
    """Of so many terms, how many must stand near each other: two thirds, and two at least."""
    return max(2, (2 * n + 2) // 3)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TO_WORDS).split()


def _pack(values: np.ndarray) -> bytes:
    """uint32 as four planes of bytes, compressed: most upper bytes are zero."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _segment(ids: list, texts: list[bytes]) -> list:
    """The columns of one segment."""
    words = [x.translate(_TO_WORDS).split() for x in texts]
    n_words = np.array([len(x) for x in words], np.int32)
    flat = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    counts = np.bincount(codes, minlength=len(flat.dictionary))
    positions = np.argsort(codes, kind="stable").astype(np.int64)  # by term, then ascending
    steps = np.diff(positions, prepend=0)
    first = np.append(0, np.cumsum(counts)[:-1]).astype(np.int64)[: len(counts)]
    steps[first] = positions[first]
    terms = b"\n".join(flat.dictionary.to_pylist())
    blocks = [_pack(steps[k : k + PACKED]) for k in range(0, len(steps), PACKED)]
    return [ids, n_words.tolist(), len(terms).to_bytes(8, "little") + pa.compress(terms, codec="zstd", asbytes=True), _pack(counts), blocks]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table of segments over all documents, written to the shared folder."""
    names, kinds = [x.split()[0] for x in _SEGMENT.split(", ")], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.binary())]

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        numbers = count(TaskContext.get().partitionId() << 32)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([next(numbers), *_segment(ids, texts)], kinds, strict=True)], names)

        for batch in rows:
            for i, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(data or b"")
                size += len(texts[-1])
                if size >= SEGMENT_WORDS * 6:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return staged(columns.mapInArrow(run, _SEGMENT), "segments", "none")


def _terms(blob: bytes, n: int) -> pa.Array:
    if not n:
        return pa.array([], pa.binary())
    size = int.from_bytes(blob[:8], "little")
    return pa.array(pa.decompress(blob[8:], size, codec="zstd", asbytes=True).split(b"\n"), pa.binary())


def _frequencies(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """How often each of the terms is found in the whole corpus."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(sent.value, pa.binary()), np.zeros(len(sent.value), np.int64)
        for batch in rows:
            for blob, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _unpack(counts)
                at = pc.index_in(_terms(blob, len(counts)), value_set=wanted)
                own = at.is_valid().to_numpy(zero_copy_only=False)
                total[at.drop_null().to_numpy()] += counts[own]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # as many rows as terms of a block
        out[term] = n
    return out


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _parts(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Places cut into runs whose sizes sum to about most, one at least in each."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1) if len(sizes) else []


class _Postings:
    """The lists of one segment, unpacked as they are asked for; terms have the numbers of the lookup."""

    def __init__(self, n_terms: int, terms: pa.Array, numbers: pa.Array, counts: np.ndarray, blocks: list[bytes]):
        at = pc.index_in(terms, value_set=numbers).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.full(n_terms + 1, -1, np.int64)  # the last is for -1
        place[at] = np.arange(len(at))
        place[-1] = -1
        begin = np.cumsum(counts) - counts
        self.sizes, self.first = np.where(place >= 0, counts[place], 0)[:-1], np.where(place >= 0, begin[place], 0)[:-1]
        self.blocks, self.span = blocks, int(counts.sum()) + 1
        self.steps, self.open = np.zeros(self.span, np.int64), np.zeros(len(blocks), bool)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions of each of the terms one after the other, and how many each has."""
        first, sizes = self.first[terms], self.sizes[terms]
        low, high = first // PACKED, np.where(sizes > 0, (first + sizes - 1) // PACKED, first // PACKED - 1)
        for k in np.unique(_spread(low, high - low + 1)):
            if not self.open[k]:
                own = _unpack(self.blocks[k])
                self.steps[k * PACKED : k * PACKED + len(own)], self.open[k] = own, True
        summed = np.cumsum(self.steps[_spread(first, sizes)])
        before = np.append(0, summed)[np.cumsum(sizes) - sizes]
        return summed - np.repeat(before, sizes), sizes

    def keys(self, terms: np.ndarray) -> np.ndarray:
        """The positions of distinct ascending terms as one ascending list of term * span + position."""
        positions, sizes = self.lists(terms)
        return np.repeat(terms, sizes) * self.span + positions


class _Lookup:
    """The windows of a block of items, ready to be looked up in segments."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], terms: list[bytes], frequency: np.ndarray, window: int):
        number = {t: k for k, t in enumerate(terms)}
        self.terms, self.names = pa.array(terms, pa.binary()), [x for x, _ in items]
        codes = np.fromiter((number[w] for _, words in items for w in words), np.int64)
        sizes = np.array([len(words) for _, words in items], np.int64)
        n = np.maximum(1, sizes - window + 1)
        item = np.repeat(np.arange(len(items)), n)
        first = _spread(np.cumsum(sizes) - sizes, n)
        inside = np.arange(window) < np.minimum(sizes, window)[item][:, None]
        # places beyond a short window hold -1
        whole = np.where(inside, codes[np.minimum(first[:, None] + np.arange(window), len(codes) - 1)], -1) if len(items) else np.zeros((0, window), np.int64)
        self.codes, which = np.unique(whole, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
        self.item, self.item_first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.codes) + 1))
        self.sizes = (self.codes >= 0).sum(axis=1)
        # offsets from the rarest term on; places beyond a short window come last
        self.order = np.argsort(np.where(self.codes >= 0, np.append(frequency, 0)[self.codes], np.iinfo(np.int64).max), axis=1, kind="stable")
        self.rarest = np.take_along_axis(self.codes, self.order[:, :1], axis=1)[:, 0]
        self.near, self.least = np.full((len(items), NEAR_TERMS), -1, np.int64), np.zeros(len(items), np.int64)
        for k, (_, words) in enumerate(items):
            rare = sorted({t for t in map(number.__getitem__, words) if frequency[t] > 0}, key=lambda t: (frequency[t], t))[:NEAR_TERMS]
            self.near[k, : len(rare)], self.least[k] = rare, near_least(len(rare))

    def search(self, n_words: np.ndarray, terms: pa.Array, counts: np.ndarray, blocks: list[bytes]) -> dict[int, tuple[list[int], set[int], set[int]]]:
        """By number of the document in the segment: places of words hit, items with exact matches, items with near ones only."""
        postings, doc_end = _Postings(len(self.terms), terms, self.terms, counts, blocks), np.cumsum(n_words)
        doc_of = lambda at: np.searchsorted(doc_end, at, side="right")
        cover, exact, near = np.zeros(postings.span + 1, np.int64), {}, {}
        known = np.flatnonzero(postings.sizes[self.rarest] > 0) if len(self.codes) else np.zeros(0, np.int64)
        for part in _parts(postings.sizes[self.rarest[known]], STARTS):
            own = known[part]
            positions, sizes = postings.lists(self.rarest[own])
            w, start = np.repeat(own, sizes), positions - np.repeat(self.order[own, 0], sizes)
            fits = start >= 0
            w, start = w[fits], start[fits]
            for k in range(1, self.codes.shape[1]):
                offset = self.order[w, k]
                term = self.codes[w, offset]
                keys = postings.keys(np.unique(term[term >= 0]))
                wanted = term * postings.span + start + offset
                at = np.searchsorted(keys, wanted)
                fits = (term < 0) | ((np.append(keys, -1)[at] == wanted) & (start + offset < postings.span))
                w, start = w[fits], start[fits]
                if not len(w):
                    break
            doc = doc_of(start)
            fits = start + self.sizes[w] <= np.append(doc_end, 0)[doc]
            for k, s, d in zip(w[fits].tolist(), start[fits].tolist(), doc[fits].tolist(), strict=True):
                cover[s] += 1
                cover[s + self.sizes[k]] -= 1
                exact.setdefault(d, set()).update(self.item[self.item_first[k] : self.item_first[k + 1]].tolist())
        hit: dict[int, list[int]] = {}
        places = np.flatnonzero(np.cumsum(cover) > 0)
        for d, at in zip(doc_of(places).tolist(), places.tolist(), strict=True):
            hit.setdefault(d, []).append(at - int(doc_end[d] - n_words[d]))

        held = np.where(self.near >= 0, postings.sizes[self.near], 0) if len(self.near) else self.near
        likely = np.flatnonzero(((held > 0).sum(axis=1) >= self.least) & (self.least > 0)) if len(held) else []
        for part in _parts(held[likely].sum(axis=1), STARTS) if len(likely) else []:
            own = likely[part]
            keys = postings.keys(np.unique(self.near[own][held[own] > 0]))
            row, rank = np.nonzero(held[own] > 0)
            at, sizes = postings.lists(self.near[own[row], rank])
            item = np.repeat(own[row], sizes)
            end = np.minimum(doc_end[doc_of(at)], at + NEAR_WORDS + 1)
            n = np.zeros(len(at), np.int64)
            for j in range(NEAR_TERMS):
                term = self.near[item, j]
                low = np.searchsorted(keys, term * postings.span + at)
                following = np.append(keys, -1)[low]
                n += (term >= 0) & (following >= 0) & (following < term * postings.span + end)
            fits = n >= self.least[item]
            for d, k in np.unique(np.stack([doc_of(at[fits]), item[fits]], axis=1), axis=0).tolist():
                near.setdefault(d, set()).add(k)
        return {d: (hit.get(d, []), exact.get(d, set()), near.get(d, set()) - exact.get(d, set())) for d in exact.keys() | near.keys()}


_FOUND = "segment long, place int, doc_id long, n_words long, hit array<int>, items array<string>, near array<string>"


def _searching(sent, every: bool):  # noqa: ANN001, ANN202
    """Looks a block up: a row per document with matches (or for every document), with the places of its hit words."""
    strings = pa.list_(pa.string())

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for segment, ids, n_words, terms, counts, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = _unpack(counts).astype(np.int64)
                found = sent.value.search(np.array(n_words, np.int64), _terms(terms, len(counts)), counts, steps) if len(counts) else {}
                own = list(range(len(ids))) if every else sorted(found)
                got = [found.get(d, ((), (), ())) for d in own]
                hit = pa.array([x[0] for x in got], pa.list_(pa.int32()))
                named = [[{sent.value.names[k] for k in x[c]} - {None} for c in (1, 2)] for x in got]
                items, near = (pa.array([sorted(x) for x in c], strings) for c in ([a for a, _ in named], [b - a for a, b in named]))
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array([ids[d] for d in own], pa.int64()), pa.array([n_words[d] for d in own], pa.int64()), hit, items, near], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def matches(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, block_chars: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (with exact matches), near (with proximity matches only)."""
    spark, block_chars = index.sparkSession, block_chars or BLOCK_CHARS
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, parts = -(-chars // block_chars) or 1, []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        held = [(x, words_of(t.encode())) for x, t in own.collect()]  # block_chars or so
        held = [x for x in held if x[1]]
        terms = sorted({w for _, words in held for w in words})
        sent = spark.sparkContext.broadcast(_Lookup(held, terms, _frequencies(index, terms), window))
        parts.append(index.mapInArrow(_searching(sent, blocks == 1), _FOUND))
    found = parts[0]
    if blocks > 1:
        # blocks give the documents with matches alone; every document has its row from the index
        docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
        none = [F.array().cast(kind).alias(c) for c, kind in (("hit", "array<int>"), ("items", "array<string>"), ("near", "array<string>"))]
        found = docs.select("segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"), *none)
        for part in parts:
            found = found.unionByName(part)
        whole = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        found = found.groupBy("segment", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), whole("hit").alias("hit"), F.array_sort(whole("items")).alias("items"), whole("near").alias("near"))
        found = found.withColumn("near", F.array_sort(F.array_except("near", "items")))
    return found.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "near")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """matches() over an index built from docs."""
    return matches(build_index(docs, doc_id, text), benchmark, window=window)


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a window of an item, all columns as they are; rows with a null id stay, for no match names them."""
    bad = fresh(docs, "hit_id")
    hits = contamination(docs, benchmark, doc_id, text).where("n_hit > 0").select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(hits, F.col(doc_id).cast("long") == F.col(bad), "left_anti")
