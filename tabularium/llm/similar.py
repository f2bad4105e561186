"""Near copies by the Jaccard similarity of their word sequences: min-hash bands find candidates, the texts decide.

Each distinct text gets least hashes of its sequences of SHINGLE words, in BANDS bands of BAND_ROWS. Texts that
share a band meet in a bucket, and each is compared with three texts of the bucket: the two that come first in two
orders by hash, and the one whose buckets hold most texts in all, which is the text that the others are copies of, if
there is one; so a bucket of n texts gives 3 n pairs at most at first. Each pair is decided by the exact similarity
of its texts. What these links leave in different classes then meets by its rarest sequences (a prefix filter with places, which
loses no similar pair); pairs of one class need no comparison. So every pair that shares a bucket
is linked or joined by a chain if it is similar. Two texts of similarity 0.8 share a bucket with probability 0.99997.

Defined results: texts without words have no bands; those of fewer than SHINGLE words are one sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import byte_values, components, staged

SHINGLE = 5
#: Texts are near copies from this similarity on.
LEAST = 0.8
BANDS, BAND_ROWS = 20, 4
#: Sequences hashed at once, and texts with a sequence that meet as many in a task.
CHUNK, MET = 1 << 12, 1 << 10

_RNG = np.random.default_rng(7)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingles(data: bytes | None, size: int = SHINGLE) -> set[bytes]:
    words = (data or b"").lower().split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def bands(data: bytes | None) -> list[int]:
    """A hash of each band of the text's least hashes; none if it has no words."""
    return _bands(shingles(data))


def _bands(own: set[bytes]) -> list[int]:
    if not own:
        return []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for low in range(0, len(hashes), CHUNK):
            mixed = hashes[low : low + CHUNK, None] * _TIMES + _PLUS
            least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def similarity(a: bytes | None, b: bytes | None) -> float:
    one, two = shingles(a), shingles(b)
    both = len(one & two)
    return both / max(1, len(one) + len(two) - both)


def pairs(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(a, b): links among distinct texts by their xxhash64, each of similarity least or more."""

    def sketch(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [(len(own), _bands(own)) for own in map(shingles, byte_values(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["t", "size", "bands"])

    def decide(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            near = [similarity(x, y) >= least for x, y in zip(byte_values(batch.column(2)), byte_values(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    whole = docs.select(F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    sketches = whole.mapInArrow(sketch, "t long, size int, bands array<long>").groupBy("t").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    held = staged(sketches.select("t", "size", F.posexplode("bands").alias("band", "key")), "bands")
    sizes = held.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(held.join(sizes, ["band", "key"]).select("t", "size", "band", "key", "n"), "members")
    weighed = members.join(members.groupBy("t").agg(F.sum("n").alias("weight")), "t")
    first = [F.min(F.struct(F.xxhash64("t", F.lit(k)).alias("rank"), "t")).getField("t").alias(f"c{k}") for k in (0, 1)]
    centres = weighed.groupBy("band", "key").agg(*first, F.max(F.struct("weight", "t")).getField("t").alias("c2"))
    met = members.join(centres, ["band", "key"]).select("t", F.explode(F.array("c0", "c1", "c2")).alias("c")).where("t <> c")
    wanted = staged(met.select(F.least("t", "c").alias("a"), F.greatest("t", "c").alias("b")).distinct(), "candidates")
    ends = wanted.select(F.explode(F.array("a", "b")).alias("t")).distinct()
    # copies are cut to one before the shuffle, so that a large group of them is a few rows
    texts = staged(whole.groupBy("t").agg(F.first("text").alias("text")).join(ends, "t", "left_semi"), "texts")
    sides = [texts.select(F.col("t").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]

    def decided(some: DataFrame) -> DataFrame:
        return some.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(decide, "a long, b long")

    found = staged(decided(wanted), "centre_links")
    rest = staged(_apart(members, components(found), texts, least).join(wanted, ["a", "b"], "left_anti"), "rest")
    return found.unionByName(decided(rest))


def _apart(members: DataFrame, classes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of texts of different classes (node, root) that could be similar, among those whose buckets hold several classes.

    A text's sequences stand in one order, rare ones first. The first one that two similar texts share is in the prefix of both
    (as many as may be missing from the other, and one), and behind it enough must be left of both. So texts meet by the sequences of
    their prefixes, and a sequence of many texts is cut into parts, of which each two meet by themselves.
    """
    rooted = members.join(classes.select(F.col("node").alias("t"), "root"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    mixed = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", "key")
    own = rooted.join(mixed, ["band", "key"], "left_semi").groupBy("t").agg(F.first("root").alias("root"), F.first("size").alias("size"))

    def cut(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [list({xxhash.xxh64_intdigest(x) - (1 << 63) for x in shingles(data)}) for data in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["t", "own"])

    held = staged(texts.join(own, "t", "left_semi").select("t", "text").mapInArrow(cut, "t long, own array<long>").select("t", F.explode("own").alias("s")), "sequences")
    shared = held.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # sequences of one text alone stand before all others, and no text meets by them
    ranked = held.join(shared, "s").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("own")).join(own, "t")
    prefix = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
    alone = F.col("size") - F.size("own")
    each = ranked.select("t", "root", "size", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))).alias("at", "x"))
    parts = F.ceil(F.col("x.n") / MET).cast("int")
    rows = staged(each.select("t", "root", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), F.col("x.s").alias("s"), F.pmod(F.xxhash64("t", F.lit(2)), parts).cast("int").alias("own"), parts.alias("parts")), "prefixes")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda x, i, j: rows.select("s", F.col("t").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "size", "left")), i.alias("i"), j.alias("j"))
    met = side("a", F.col("own"), every).join(side("b", every, F.col("own")), ["s", "i", "j"])
    could = F.least("left_a", "left_b") >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9
    return met.where((F.col("root_a") < F.col("root_b")) & could).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
