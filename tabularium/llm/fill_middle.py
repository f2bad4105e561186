"""Fill-in-the-middle examples: texts cut at two code points and put together anew.

Where a text is cut is found on whole columns: the UTF-8 bytes of a batch are
viewed as words of 64 bits. In each word the bytes that end a code point are
marked by shifts and masks (a byte ends one if the next byte does not go on
with it), and counted by the number of bits that are set. A running sum over
words gives the code points up to each word, so that the end of the k-th is
found by a search for its word, and then by a select among the word's eight
bytes. No character of a text is looked at by itself.

The draws come from the SHA-256 of seed and id, so they don't depend on the layout
of the rows, and rows of one id are cut by the same draws. restored() takes an
example apart again, without the text it came from, by column functions alone.

Defined results: a null text is as an empty one, and gives the plain form; texts
that hold a marker are plain, since an example of theirs could not be taken
apart; a null id draws as the empty string; repeated rows give equal rows;
a text is never cut short, however long; an empty table gives no rows;
all columns of the input stay, and the new ones give way to names that it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import batches, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many are cut; of 100 that are cut, how many put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
SEED = "1"

_HIGH, _LOW = np.uint64(0x8080808080808080), np.uint64(0x0101010101010101)


def end_marks(data: np.ndarray) -> np.ndarray:
    """The bytes (uint8, a multiple of 8) as words of 64 bits, with the lowest bit of each byte set that ends a code point."""
    words = data.view("<u8")
    # 10xxxxxx goes on: the highest bit is set, the next one is not
    starts = ((~words | words << np.uint64(1)) & _HIGH) >> np.uint64(7)
    # a byte ends a code point if the next one starts another; what follows the last word starts one
    after = np.append(starts[1:], np.uint64(1))
    return starts >> np.uint64(8) | after << np.uint64(56)


class CodePoints:
    """Finds code points in a buffer of UTF-8."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8 - len(data) % 8, np.uint8)
        padded[: len(data)] = data
        self.marks = end_marks(padded)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def up_to(self, at: np.ndarray) -> np.ndarray:
        """How many code points end in the bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th code point of the buffer, counted from 1; 0 for k = 0."""
        word = np.maximum(np.searchsorted(self.before, k, side="left") - 1, 0)
        rank = (k - self.before[word]).astype(np.uint64)
        # byte i of the product holds the marks of bytes 0 to i; the bytes with fewer than rank of them come before the place
        sums = self.marks[word] * _LOW
        less = ((sums | _HIGH) - np.minimum(rank, np.uint64(9)) * _LOW) & _HIGH ^ _HIGH
        return np.where(k > 0, (word << 3) + np.bitwise_count(less).astype(np.int64) + 1, 0)


def draws(ids: list, seed: str = SEED) -> np.ndarray:
    """Four numbers of 32 bits for each id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def _examples(ids: list, texts: pa.Array, seed: str) -> list[pa.Array]:
    """Units, form, code points of prefix and middle, and the example of each text."""
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    index, h = CodePoints(data), draws(ids, seed)
    known = index.up_to(ends)
    n = np.diff(known)
    low, high = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    cut = np.stack([ends[:-1], index.after(known[:-1] + low), index.after(known[:-1] + high), ends[1:]], axis=1)
    cut[:, 1] = np.where(low > 0, cut[:, 1], cut[:, 0])
    cut[:, 2] = np.where(high > 0, cut[:, 2], cut[:, 0])
    whole, marks, made, forms = data.tobytes(), [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)], [], []
    plain = (n == 0) | (h[:, 2] % 100 >= CUT)
    spm = h[:, 3] % 100 < SUFFIX_FIRST
    for k, (a, b, c, d) in enumerate(cut.tolist()):
        if plain[k] or any(whole.find(m, a, d) >= 0 for m in marks):
            forms.append("plain")
            made.append(whole[a:d])
        elif spm[k]:
            forms.append("spm")
            made.append(b"".join((marks[1], whole[c:d], marks[0], whole[a:b], marks[2], whole[b:c])))
        else:
            forms.append("psm")
            made.append(b"".join((marks[0], whole[a:b], marks[1], whole[c:d], marks[2], whole[b:c])))
    form = np.array(forms, object)
    none = form == "plain"
    return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=none), pa.array(high - low, pa.int64(), mask=none), pa.array(made, pa.large_binary()).cast(pa.large_string())]


NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def new_names(docs: DataFrame) -> dict[str, str]:
    """The new columns by the names that docs leaves free."""
    return {x: fresh(docs, x) for x in NEW}


def examples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """docs with n (code points), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, named by new_names()."""
    names = new_names(docs)
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[x], kinds[x]) for x in NEW)])
    at_id, at_text = docs.columns.index(doc_id), docs.columns.index(text)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = batch.column(at_text).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *_examples(batch.column(at_id).to_pylist(), texts, seed)], [*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, schema)


def restored(form: str | Column, output: str | Column) -> Column:
    """The text that an example was made from."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind each of the three markers."""
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
