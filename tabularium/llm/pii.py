"""Personal data by patterns and by a semi-Markov conditional random field.

Four patterns give base spans: e-mail and network addresses, card and phone
numbers. The model adds spans that the patterns miss, such as phone numbers
without a country code or addresses with "(at)". It looks at regions: runs of
chunks (what white space separates) that hold a digit or a sign of an address.
A region is cut into tokens; each run of at most MAX_TOKENS tokens is a
candidate segment, whose features are of the span as a whole: its shape, its
digits, check sums, signs, and the words before it. Dynamic programming over
the ends of segments chooses boundaries and types together; a token outside
any entity is a segment of its own.

The weights are fitted here, by gradient ascent on the likelihood of a fixed
number of sentences that are generated by rule (forward and backward sums over
all segmentations).

Defined results: null and empty texts have no spans; repeated rows have a row
each; null ids are kept; an empty table gives no rows; other columns are
ignored. Base spans of different kinds may overlap and all stay; added spans
overlap none. Of segmentations that score alike that whose last entity starts
first is taken, and of kinds the first listed. Texts are looked at as a whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import byte_values

KINDS = ("email", "ip", "card", "phone")
#: Patterns of base spans. That of e-mail addresses is what follows the sign; see emails(). A network address starts where its
#: first number starts: what fails there fails within the number as well, and is not tried again at each of its digits.
PATTERNS = {
    "email": re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(rb"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What may stand before the sign of an e-mail address.
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGIT = re.compile(rb"[0-9]")

#: Longest segment in tokens and in bytes; candidates have so many digits, or a sign of an address, and no more digits than that.
MAX_TOKENS, MAX_BYTES, LEAST_DIGITS, MAX_DIGITS = 24, 64, 7, 24
#: Segments whose best kind is remembered while a text is decoded.
REMEMBERED = 50_000
#: Hashed features, sentences generated to fit the weights, passes over them.
FEATURES, SENTENCES, PASSES = 1 << 14, 700, 6

#: What a region grows from.
TRIGGER = re.compile(rb"[0-9@]|[(\[]at[)\]]")
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]")
AT = re.compile(rb"@|[(\[]at[)\]]")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(data: bytes) -> bytes:
    return b"".join(DIGIT.findall(data))


def valid(kind: str, data: bytes) -> bool:
    if kind == "ip":
        return all(len(x) <= 3 and int(x or b"0") <= 255 for x in (part.lstrip(b"0") for part in data.split(b".")))
    digits = _only_digits(data)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def emails(data: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: outward from each sign, so that each character is looked at a few times only."""
    done, sign = 0, data.find(b"@")
    while sign >= 0:
        # what may stand before this sign lies behind the last match and the last sign
        start = done + len(data[done:sign].rstrip(LOCAL))
        match = PATTERNS["email"].match(data, sign + 1) if start < sign else None
        done = sign + 1
        if match:
            done = match.end()
            yield start, done
        sign = data.find(b"@", done)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end) in bytes."""
    out = []
    digits = DIGIT.search(data) is not None
    for rank, kind in enumerate(KINDS):
        if kind == "email":
            out += [(rank, a, b) for a, b in emails(data)]
        elif digits:
            out += [(rank, m.start(), m.end()) for m in PATTERNS[kind].finditer(data) if valid(kind, m[0])]
    return out


def regions(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start of the two chunks before, start, end): runs of chunks with a trigger, joined over a single space or bracket."""
    start = end = -1
    for m in TRIGGER.finditer(data):
        if m.start() < end:
            continue
        a, b = _chunk(data, m.start(), m.end())
        if AT.fullmatch(data[a:b]):  # a sign by itself stands between two parts
            a, b = max(_chunk(data, a - 1, a - 1)[0], end, 0) if a else a, _chunk(data, min(b + 1, len(data)), min(b + 1, len(data)))[1]
        if end >= 0 and a - end <= 1 and a > 0 and data[a - 1 : a] == b" ":
            end = b
            continue
        if end >= 0:
            yield _before(data, start), start, end
        start, end = a, b
    if end >= 0:
        yield _before(data, start), start, end


WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _chunk(data: bytes, at: int, end: int) -> tuple[int, int]:
    """The stretch without white space around a place; a chunk is at most MAX_BYTES to either side."""
    low = max(0, at - MAX_BYTES)
    left = max(data.rfind(c, low, at) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    right = WHITE.search(data, end, end + MAX_BYTES)
    return (left + 1 if left >= 0 else low), (right.start() if right else min(len(data), end + MAX_BYTES))


def _before(data: bytes, at: int) -> int:
    """Where the two words before a place begin; a word is at most 24 bytes."""
    for _ in range(2):
        at = max(at - 1, 0)
        low = max(0, at - 24)
        gap = max(data.rfind(b" ", low, at), data.rfind(b"\n", low, at))
        at = gap + 1 if gap >= 0 else low
    return at


def _kind_of(c: bytes) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() or c >= b"\x80" else "space" if c.isspace() else c.decode("latin1")


def shape(tokens: list[bytes]) -> str:
    return "".join("d" if t.isdigit() else "a" if t[:1].isalpha() or t[0] >= 128 else t.decode("latin1") for t in tokens)


def features(data: bytes, tokens: list[tuple[int, int]], i: int, j: int, before: list[bytes]) -> list[str]:
    """Of the segment of tokens i to j - 1, as a whole."""
    start, end = tokens[i][0], tokens[j - 1][1]
    own = [data[a:b] for a, b in tokens[i:j]]
    digits, text = b"".join(t for t in own if t.isdigit()), data[start:end]
    n, signs = len(digits), sorted({t.decode("latin1") for t in own if not t.isalnum() and t[0] < 128})
    parts = [int(t) for t in own if t.isdigit()] if n <= 12 else []
    dotted = text.count(b".") == 3 and len(own) == 7 and own[0].isdigit() and all(t == b"." for t in own[1::2]) and all(t.isdigit() for t in own[::2])
    at = AT.search(text)
    out = [
        "bias",
        f"digits={min(n, 20)}",
        f"tokens={min(j - i, 12)}",
        f"shape={shape(own)[:24]}",
        f"signs={''.join(signs)}",
        f"letters={any(t[:1].isalpha() for t in own)}",
        f"quad={dotted and max(parts, default=999) <= 255}",
        f"luhn={13 <= n <= 19 and luhn(digits)}{13 <= n <= 19}",
        f"at={at is not None and at.start() > 0}{b'.' in text[at.end():] if at else False}",
        f"groups={'-'.join(str(len(t)) for t in own if t.isdigit())[:16]}",
        f"first={_kind_of(text[:1])}",
        f"last={_kind_of(text[-1:])}",
        f"left={_kind_of(data[start - 1 : start])}",
        f"right={_kind_of(data[end : end + 1])}",
        f"goes on={at is not None and data[end : end + 1] in (b'.', b'-', b'_') and data[end + 1 : end + 2].isalnum()}",
    ]
    return out + [f"before={w.decode('latin1')}" for w in before]


class Region:
    """The tokens of a region, and its candidate segments by their first token."""

    def __init__(self, data: bytes, begin: int, start: int, end: int):
        self.data, self.tokens = data, [m.span() for m in TOKEN.finditer(data, start, end)]
        self.before = [w.lower() for w in re.findall(rb"[A-Za-z]+", data[begin:start])[-2:]]
        sizes = [(b - a) * data[a : a + 1].isdigit() for a, b in self.tokens]
        signs = [data[a:b] == b"@" or data[max(a - 1, 0) : b + 1].lower() in (b"(at)", b"[at]") for a, b in self.tokens]
        self.digits, self.signs = (np.concatenate([[0], np.cumsum(x)]).astype(int).tolist() for x in (sizes, signs))

    def starting(self, i: int) -> Iterator[int]:
        """The ends of the candidates that start at token i."""
        data, a = self.data, self.tokens[i][0]
        opening = data[a : a + 1]
        if not (opening.isalnum() or opening in (b"+", b"(") or opening >= b"\x80"):
            return
        for j in range(i + 1, min(len(self.tokens), i + MAX_TOKENS) + 1):
            b, digits = self.tokens[j - 1][1], self.digits[j] - self.digits[i]
            if b - a > MAX_BYTES or digits > MAX_DIGITS:
                return
            if data[b - 1 : b].isalnum() and (digits >= LEAST_DIGITS or self.signs[j] > self.signs[i]):
                yield j

    def numbers(self, i: int, j: int) -> list[int]:
        return [zlib.crc32(f.encode()) % FEATURES for f in features(self.data, self.tokens, i, j, self.before)]

    def surroundings(self, i: int, j: int) -> tuple:
        """All that the features depend on."""
        a, b = self.tokens[i][0], self.tokens[j - 1][1]
        return self.data[a:b], self.data[max(a - 1, 0) : a], self.data[b : b + 2], *self.before


def _sums(n: int, segments: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Logarithms of the sums over all segmentations of the first 0, 1, .. n tokens; segments: (i, j, score by kind)."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _) in enumerate(segments):
        ends[j].append(k)
    alpha = np.zeros(n + 1)
    for j in range(1, n + 1):
        values = [alpha[j - 1], *(alpha[segments[k][0]] + s for k in ends[j] for s in segments[k][2])]
        top = max(values)
        alpha[j] = top + math.log(sum(math.exp(v - top) for v in values))
    return alpha


def decode(weights: np.ndarray, data: bytes, begin: int, start: int, end: int) -> list[tuple[int, int, int]]:
    """The entities of a region: (rank, start, end). Candidates are made as they are needed, so a long region takes little memory."""
    region = Region(data, begin, start, end)
    n = len(region.tokens)
    best: list[float] = [0.0] + [-math.inf] * n
    back: list[tuple[int, int] | None] = [None] * (n + 1)
    known: dict[tuple, tuple[int, float]] = {}
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1] = best[i], None
        for j in region.starting(i):
            key = region.surroundings(i, j)
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                scores = weights[:, region.numbers(i, j)].sum(axis=1)
                known[key] = int(scores.argmax()), float(scores.max())
            kind, score = known[key]
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, region.tokens[i][0], region.tokens[j - 1][1]))
            j = i
    return out[::-1]


def sentences(n: int, seed: int = 11) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Generated text with its entities (rank, start, end)."""
    rng = random.Random(seed)
    syllables = "an ber cor del en fi gra hol in jo ka lem mor nu ost pra qui ra sel tur un vel wi xo yan zet".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        while True:
            size = rng.choice([13, 14, 15, 16, 16, 16, 19])
            digits = number(size)
            if luhn(digits.encode()) == good:
                mark = rng.choice(["", " ", "-", ".", "/"])
                return digits if not mark else mark.join(digits[k : k + 4] for k in range(0, size, 4))

    def email() -> str:
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{number(2)}", f"{word()}_{number(3)}", f"{word()}-{word()}"])
        host = rng.choice(["", f"{word()}.", f"{word()}{rng.randint(0, 9)}."]) + f"{word()}." + rng.choice(["com", "org", "net", "de", "fr", "es"])
        sign = rng.choice(["@", "@", "@", "(at)", "[at]", " @ ", " (at) ", " [at] "])
        return f"{name}{sign}{host}"

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)}{a}{b}{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"00{rng.randint(1, 99)} {a} {b} {c}"])

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)) + rng.choice(["", "", f":{number(4)}"])

    def other() -> str:
        return rng.choice(
            [
                lambda: card(False),
                lambda: number(rng.randint(7, 22)),
                lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
                lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
                lambda: f"{number(1)},{number(3)},{number(3)}.{number(2)}",
                lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}",
                lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}",
                lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40]))),
                lambda: f"{word()}{number(8)}{word()}",
                lambda: f"{number(3)}-{rng.randint(0, 9)}-{number(2)}-{number(6)}-{rng.randint(0, 9)}",
                lambda: f"@{word()}{number(2)}",
                lambda: f"{number(2)} {number(3)} {number(2)} {number(4)}",
                lambda: f"https://{word()}.org/{number(8)}?id={number(5)}",
            ]
        )()

    hints = {0: ["mail", "contact", "write to"], 1: ["host", "server", "from"], 2: ["card", "paid with"], 3: ["call", "phone", "tel"]}
    out = []
    for _ in range(n):
        parts, spans, size = [], [], 0

        def add(text: str) -> None:
            nonlocal size
            parts.append(text)
            size += len(text)

        for _ in range(rng.randint(1, 3)):
            add(" ".join(word() for _ in range(rng.randint(2, 5))) + " ")
            kind = rng.choice([0, 1, 2, 3, None, None, None])
            if kind is not None and rng.random() < 0.3:
                add(rng.choice(hints[kind]) + rng.choice([" ", ": "]))
            add(rng.choice(["", "", "", "(", '"']))
            text = other() if kind is None else [email, ip, lambda: card(True), phone][kind]()
            if kind is not None:
                own = text.split(":")[0] if kind == 1 else text
                spans.append((kind, size, size + len(own)))
            add(text)
            add(rng.choice([" ", ". ", ", ", ") ", "\n"]))
        out.append(("".join(parts).encode(), spans))
    return out


def fitted(n: int = SENTENCES, passes: int = PASSES) -> np.ndarray:
    """The weights by kind and feature."""
    problems = []
    for data, spans in sentences(n):
        for begin, start, end in regions(data):
            region = Region(data, begin, start, end)
            tokens = region.tokens
            found = [(i, j, region.numbers(i, j)) for i in range(len(tokens)) for j in region.starting(i)]
            if found:
                gold = {(a, b): k for k, a, b in spans}
                own = [gold.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j, _ in found]
                problems.append((len(tokens), [(i, j) for i, j, _ in found], np.array([f + [-1] * (max(len(x[2]) for x in found) - len(f)) for _, _, f in found]), np.array(own)))
    weights, squares, rng = np.zeros((len(KINDS), FEATURES + 1)), np.full((len(KINDS), FEATURES + 1), 0.1), random.Random(3)
    weights[:, zlib.crc32(b"bias") % FEATURES] = -1.0
    for _ in range(passes):
        rng.shuffle(problems)
        for n_tokens, ends, numbers, own in problems:
            scores = weights[:, numbers].sum(axis=2).T
            forward = _sums(n_tokens, [(i, j, s) for (i, j), s in zip(ends, scores, strict=True)])
            mirrored = _sums(n_tokens, [(n_tokens - j, n_tokens - i, s) for (i, j), s in zip(ends, scores, strict=True)])
            i, j = np.array(ends).T
            expected = np.exp(forward[i][:, None] + scores + mirrored[n_tokens - j][:, None] - forward[n_tokens])
            wrong = -expected
            wrong[np.flatnonzero(own >= 0), own[own >= 0]] += 1
            for kind in range(len(KINDS)):
                step = np.bincount(numbers.ravel() % (FEATURES + 1), weights=np.repeat(wrong[:, kind], numbers.shape[1]), minlength=FEATURES + 1)
                used = np.flatnonzero(step)
                squares[kind, used] += step[used] ** 2
                weights[kind, used] += 0.3 * step[used] / np.sqrt(squares[kind, used]) - 1e-4 * weights[kind, used]
            weights[:, FEATURES] = 0  # where a segment has fewer features
    return weights[:, :FEATURES].copy()


def find(weights: np.ndarray, data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, both by kind and start."""
    base = base_spans(data)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for begin, start, end in regions(data):
        part = data[start:end]
        if len(_only_digits(part)) >= LEAST_DIGITS or AT.search(part):
            for rank, a, b in decode(weights, data, begin, start, end):
                if all(b <= x or y <= a for x, y in taken):
                    added.append((rank, a, b))
    return sorted(base), sorted(base + added)


def _said(data: bytes, spans: list[tuple[int, int, int]], ascii_only: bool) -> str:
    if ascii_only:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if spans else None
    at = lambda p: int(starts[p - 1]) if p else 0
    return ",".join(f"{KINDS[k]}:{at(a)}:{at(b)}" for k, a, b in spans)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """A row per document: doc_id, the number of base spans by kind, the digest of the base spans, all spans and their number."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted() if weights is None else weights)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in rows:
            out = []
            for data in byte_values(batch.column(1)):
                if not data or not TRIGGER.search(data):
                    out.append((0, 0, 0, 0, nothing, "", 0))
                    continue
                base, every = find(sent.value, data)
                plain = data.isascii()
                counts = [sum(k == x[0] for x in base) for k in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(_said(data, base, plain).encode()).hexdigest(), _said(data, every, plain), len(every)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
