"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are cut into words; of each window of consecutive word sequences the
one with the least hash becomes a fingerprint, and an inverted index leads from
fingerprints to their places in templates. A document's sequences are looked
up in the index. Hits of a template that lie near one diagonal are a
candidate; the template and that part of the document are aligned in a band
around the diagonal (match +2, other word -1, gap -1), and a candidate whose
matched words cover enough of the template is reported with its coverage and
its span, and what is left around it is aligned again. Where reports overlap,
the one with most matched words stays; of equals the one that starts first, then the earlier template.

Templates are a parameter and small: notices and short licenses are built in,
and templates_in() reads whole licenses from a folder. Documents are looked at
one by one, so nothing is shuffled.

Defined results: null and empty texts have no licenses; repeated rows have a
row each; null ids are kept; an empty table gives no rows; other columns are
ignored. Texts are scanned as a whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import byte_values
from tabularium.llm.license_texts import TEMPLATES

#: Words of a sequence, and sequences of a window: each run of GRAM + WINDOW - 1 words that is shared is found.
GRAM, WINDOW = 4, 3
#: Least share of a template's words that must match, and least number of them (all, if the template has fewer).
COVERAGE, LEAST_WORDS = 0.8, 5
#: Half the width of the band: a share of the template's words, and so many at least.
BAND_SHARE, LEAST_BAND = 0.15, 6

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of each sequence of GRAM word numbers; zero where a word is unknown."""
    if len(ids) < GRAM:
        return np.zeros(0, np.uint64)
    parts = np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint64), GRAM)
    with np.errstate(over="ignore"):
        value = np.zeros(len(parts), np.uint64)
        for k in range(GRAM):
            value = (value + parts[:, k]) * _MIX[0]
            value ^= value >> np.uint64(29)
        value *= _MIX[1]
    return np.where(parts.min(axis=1) > 0, value | np.uint64(1), np.uint64(0))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """The places of the least hash of each window (the last of equals), each once."""
    if len(hashes) <= window:
        return [int(len(hashes) - 1 - np.argmin(hashes[::-1]))] if len(hashes) else []
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return sorted(set((np.arange(len(views)) + window - 1 - views.argmin(axis=1)).tolist()))


def align(a: Sequence[int], b: Sequence[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, start, end in b) of the best local alignment with j - i within band of the diagonal.

    A row of scores is computed at once: gaps along the row are a running maximum.
    """
    width = 2 * band + 1
    # b with room to both sides, where nothing matches
    own = np.zeros(len(a) + len(b) + 2 * width + 2 * abs(diagonal), np.int64)
    shift = width + abs(diagonal)
    own[shift : shift + len(b)] = b
    inside = np.zeros(len(own), bool)
    inside[shift : shift + len(b)] = True
    rows = np.zeros((len(a) + 1, width + 2), np.int32)
    steps, best, at = np.arange(width, dtype=np.int32), 0, (0, 0)
    for i, word in enumerate(a):
        low = i + diagonal - band + shift
        if low >= len(own) or low + width <= 0:
            continue
        part = slice(max(low, 0), min(low + width, len(own)))
        first = part.start - low
        n, above = part.stop - part.start, rows[i]
        same = (own[part] == word) & (word != 0)
        scores = np.maximum(above[1 + first : 1 + first + n] + np.where(same, 2, -1), above[2 + first : 2 + first + n] - 1)
        scores[~inside[part]] = 0
        np.maximum(scores, 0, out=scores)
        row = np.maximum.accumulate(scores + steps[:n]) - steps[:n]
        row[~inside[part]] = 0
        rows[i + 1, 1 + first : 1 + first + n] = row
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), (i, 1 + first + top)
    if not best:
        return 0, 0, 0
    i, c = at
    matched, end, start = 0, 0, 0
    while i >= 0 and rows[i + 1, c] > 0:
        j, score, up = i + diagonal - band + c - 1, rows[i + 1, c], rows[i]
        same = bool(a[i]) and a[i] == b[j]
        if score == up[c] + (2 if same else -1):
            if same:
                matched, start, end = matched + 1, j, max(end, j + 1)
            i -= 1
        elif score == up[c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return matched, start, end


def templates_in(folder: str) -> tuple[tuple[str, str], ...]:
    """The files of a folder of license texts as templates, each under its name."""
    return tuple((p.name, p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink())


class Index:
    """The templates' fingerprints."""

    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.names = [n for n, _ in templates]
        self.words: dict[bytes, int] = {}
        self.bodies = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(templates):
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in text.encode().translate(_TO_WORDS).split()]
            self.bodies.append(ids)
            hashes = _grams(np.array(ids, np.int64))
            for p in winnow(hashes):
                self.places[int(hashes[p])].append((k, p))
        self.known = np.array(sorted(self.places), np.uint64)

    def scan(self, data: bytes) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end in bytes) by start."""
        flat = data.translate(_TO_WORDS)
        ids = np.fromiter(map(self.words.get, words := flat.split(), [0] * len(words)), np.int64, len(words))
        hashes = _grams(ids)
        hits = np.flatnonzero(np.isin(hashes, self.known)) if hashes.any() else []
        if not len(hits):
            return []
        by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in hits.tolist():
            for k, q in self.places[int(hashes[p])]:
                by_template[k].append((p, q))
        found = []
        for k, pairs in by_template.items():
            body = self.bodies[k]
            band = max(LEAST_BAND, int(BAND_SHARE * len(body)))
            least = min(LEAST_WORDS, len(body))
            group: list[int] = []
            for d in [*sorted(p - q for p, q in pairs), None]:
                if group and (d is None or d - group[0] > band):
                    middle = group[len(group) // 2]
                    low, high = max(0, middle - band), min(len(ids), group[-1] + len(body) + band)
                    part = ids[low:high].tolist()
                    while True:
                        matched, a, b = align(body, part, middle - low, band)
                        if matched < least or matched < COVERAGE * len(body):
                            break
                        found.append((matched, k, low + a, low + b))
                        part[a:b] = [0] * (b - a)  # no word of a template: align again on what is left
                    group = []
                if d is not None:
                    group.append(d)
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
            if all(x[3] <= y[2] or y[3] <= x[2] for y in kept):
                kept.append(x)
        places = [m.span() for m in _WORD.finditer(flat)] if kept else []
        return [(self.names[k], matched / len(self.bodies[k]), matched, places[a][0], places[b - 1][1]) for matched, k, a, b in sorted(kept, key=lambda x: x[2])]


_SCHEMA = "doc_id long, matches array<struct<license:string,coverage:double,words:int,start:int,end:int>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, matches): a row per document; start and end are in code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(Index(templates))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def one(data: bytes | None) -> list[dict]:
        found = sent.value.scan(data or b"")
        if not found:
            return []
        starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        return [{"license": n, "coverage": c, "words": w, "start": int(starts[a - 1]) if a else 0, "end": int(starts[b - 1])} for n, c, w, a, b in found]

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in byte_values(batch.column(1))], kind)], ["doc_id", "matches"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
