"""Best-fit packing of token sequences into bins of several permitted lengths.

Documents longer than the longest permitted length are cut into pieces. Pieces
are dealt evenly to groups of bounded size by a hash; pieces that are equal in
all that is returned are counted first and numbered, so no key makes a group
large, and neither files nor partitions decide. Each group is packed by
itself, longest piece first:

* a piece goes to the open bin in which it leaves least room;
* if it fits none, a bin is opened in the permitted length that is cheapest
  for each token that the pieces left would put into it, largest first, when
  cut to them (the cost of a length is linear plus quadratic, as attention is);
* at the end each bin is cut down to the shortest permitted length that holds
  its contents.

The group is also packed for each permitted length with no bin opened below
it, and of all these the cheapest is taken, so the lengths are chosen together.

Defined results: null and empty texts have no tokens and are not packed, for
there is nothing to train on; they have a row with a null bin. Repeated rows
are packed once each; null ids are kept; of equal sizes the smaller id (null
last) and the earlier piece go first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import byte_values, staged
from tabularium.llm.subwords import TOKENIZER, counter

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin of n tokens: n * (1 + n / QUADRATIC).
QUADRATIC = 65536
#: Pieces of a group, about, and equal pieces that one row stands for while they are dealt.
GROUP, EQUAL = 20_000, 10_000


def bin_cost(length: int) -> float:
    return length * (1 + length / QUADRATIC)


class _Left:
    """How many pieces of each size are left."""

    def __init__(self, sizes: Sequence[int]):
        self.counts = Counter(sizes)
        self.present = 0  # bit s is set if a piece of size s is left
        for s in self.counts:
            self.present |= 1 << s

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.present ^= 1 << size

    def fill(self, size: int, length: int) -> int:
        """The tokens of a bin that is opened for a piece of that size, not taken yet, and then filled largest first."""
        used, first = size, size
        while room := min(length - used, size):
            room = (self.present & ((1 << (room + 1)) - 1)).bit_length() - 1
            if room < 1:
                break
            n = min(self.counts[room] - (room == first), (length - used) // room)
            used += n * room
            if room == 1:
                break
            size = room - 1
        return used


def cheapest(left: _Left, size: int, lengths: Sequence[int]) -> int:
    """The length to open for a piece of that size: that of least cost for each token it will hold, after it is cut."""

    def cost(length: int) -> tuple[float, int]:
        used = left.fill(size, length)
        return bin_cost(min(x for x in lengths if x >= used)) / used, length

    return min((x for x in lengths if x >= size), key=cost)


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, ahead: bool = False, floor: int = 0) -> list[tuple[int, int, int]]:
    """(bin, offset, bin's final length) for each size, in the given order; sizes are at most the longest length.

    With ahead, bins are opened by cheapest(); without, in the smallest length of floor or more that holds the piece.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    left = _Left(sizes)
    room: list[int] = []  # by bin
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    free = 0  # bit r is set if a bin has room r
    place = [(0, 0)] * len(sizes)
    for k in order:
        size = sizes[k]
        above = free >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = heapq.heappop(by_room[r])
            if not by_room[r]:
                free &= ~(1 << r)
        else:
            length = cheapest(left, size, lengths) if ahead else min(x for x in lengths if x >= max(size, floor))
            b, r = len(room), length
            room.append(r)
            opened.append(length)
        place[k] = (b, opened[b] - r)
        room[b] = r - size
        left.take(size)
        if room[b]:
            heapq.heappush(by_room.setdefault(room[b], []), b)
            free |= 1 << room[b]
    final = [min(x for x in lengths if x >= opened[b] - room[b]) for b in range(len(room))]
    return [(b, offset, final[b]) for b, offset in place]


def cost_of(found: Sequence[tuple[int, int, int]]) -> float:
    return sum(map(bin_cost, {b: final for b, _, final in found}.values()))


def cheapest_pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> list[tuple[int, int, int]]:
    """The cheapest of pack() with a look ahead, and with no bin opened below each of the lengths; what is opened is cut in all."""
    return min((pack(sizes, lengths, ahead=True), *(pack(sizes, lengths, floor=x) for x in sorted(lengths))), key=cost_of)


_PIECE = "doc_id long, piece int, start long, n_tokens long"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = max(LENGTHS), tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, n_tokens): the pieces of each document."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in rows:
            total = np.array([count(x or b"") for x in byte_values(batch.column(1))], np.int64)
            parts = np.maximum(1, -(-total // longest))
            at = np.repeat(np.arange(len(total)), parts)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * longest
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.minimum(longest, total[at] - start))], [x.split()[0] for x in _PIECE.split(", ")])

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(run, _PIECE)


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: Sequence[int] = LENGTHS, tokenizer: str = TOKENIZER, group: int = GROUP) -> DataFrame:
    """A row per piece: doc_id, piece, start (its first token in the document), n_tokens, bin_id, bin_length, bin_offset."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    cut = staged(pieces(docs, doc_id, text, max(lengths), tokenizer).groupBy(*names).agg(F.count(F.lit(1)).alias("times")), "pieces")
    groups = max(1, -(-(cut.agg(F.sum("times")).first()[0] or 0) // group))
    runs = cut.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(EQUAL).cast("long"))))
    each = runs.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + EQUAL, F.col("times")) - 1)))
    number = F.pmod(F.xxhash64(*names, "copy"), F.lit(groups))
    dealt = each.select(*names, "copy", F.when(F.col("n_tokens") > 0, number).otherwise(-1 - number).alias("group"))
    schema = f"{_PIECE}, bin_id string, bin_length int, bin_offset int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "n_tokens", "copy")]).combine_chunks()
        base, own = table.select(names), table["group"][0].as_py()
        found = cheapest_pack(table["n_tokens"].to_pylist(), lengths) if own >= 0 else []
        bins = [[f"{own}-{b}" for b, _, _ in found], [x for _, _, x in found], [x for _, x, _ in found]] if found else [[None] * len(table)] * 3
        for name, values, kind in zip(("bin_id", "bin_length", "bin_offset"), bins, (pa.string(), pa.int32(), pa.int32()), strict=True):
            base = base.append_column(name, pa.array(values, kind))
        return base

    return dealt.groupBy("group").applyInArrow(run, schema)
