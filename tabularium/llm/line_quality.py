"""Quality rules from the lines that documents of a host share.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed. For
each host the distinct documents that hold a line are counted; documents of a
host with the same text count once. A line above the limits is boilerplate:
it is removed from all documents of the host but the first that holds it, so
that a page which a host repeats with small changes is kept once. A document
that loses more than a share of its words is rejected, and so is one that
fails the base rules.

Defined results: null and empty texts have no words and fail the base rules;
null hosts are a host of their own; repeated rows count once and get the same
verdict; null ids are kept as they are, and a line whose holders all have null
ids is removed from all of them; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import WHITE, byte_values, fresh, staged

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Base rules: fewest words, and the largest share of words (percent) in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: A line is boilerplate in more documents of a host than this many, or than this share of the host's documents.
MIN_DOCS, MAX_SHARE = 10, 0.05
#: Either limit does: more documents than MIN_DOCS, whatever the host holds; or the share, in more than SMALL_DOCS
#: documents; a line of LONG_WORDS words or more is boilerplate in more than LONG_DOCS. (Both limits at once can be asked for.)
SMALL_DOCS, LONG_WORDS, LONG_DOCS = 5, 50, 2
#: A document with a smaller share of its words left is depleted.
MIN_LEFT = 0.3

_SCHEMA = "doc_id long, host long, body binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<int>"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of so many words that are found twice or more."""
    if len(words) <= size:
        return 0
    grams = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, end, total = Counter(grams), 0, 0
    for start, gram in enumerate(grams):
        if counts[gram] > 1:
            total += start + size - max(start, end)
            end = start + size
    return total


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    value = xxhash.xxh64_intdigest(line, 7)
    return value - (1 << 64) if value >> 63 else value


def measures(data: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the hashes and word counts of the distinct lines."""
    words = data.split()
    code_points = len(data.decode("utf-8", "replace"))
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    sizes: dict[int, int] = {}
    for line in lines:
        own = line.lower().split()
        key = line_hash(b" ".join(own))
        sizes[key] = sizes.get(key, 0) + len(own)
    return (
        len(words),
        code_points - sum(data.count(x) for x in WHITE),
        sum(data.count(x) for x in SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        list(sizes),
        list(sizes.values()),
    )


def _host(host: str) -> Column:
    return F.xxhash64(F.col(host))


def _measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [x or b"" for x in byte_values(batch.column(2))]
            found = list(zip(*map(measures, texts), strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])

    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _host(host).alias("host"), F.col(text).cast("string").alias("text"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("body"))
    return columns.mapInArrow(run, _SCHEMA)


def boilerplate(classes: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, either: bool = False) -> DataFrame:
    """(host, line, keeper): the lines above the limits (above both, or either of them), and the first document that holds each."""
    held = classes.select("host", "first_doc", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x"))
    # a line that a document repeats has its words counted each time; the least count of its holders comes nearest
    counts = held.groupBy("host", F.col("x.line_hashes").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min("first_doc").alias("keeper"), F.min("x.line_words").alias("words"))
    counts = counts.where(F.col("n") > (min(min_docs, SMALL_DOCS, LONG_DOCS) if either else min_docs))
    hosts = classes.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    share = F.col("n") > F.col("n_docs") * max_share
    if either:
        share = (F.col("n") > min_docs) | (share & (F.col("n") > SMALL_DOCS)) | ((F.col("words") >= LONG_WORDS) & (F.col("n") > LONG_DOCS))
    return counts.join(hosts, "host").where(share).select("host", "line", "keeper")


def _judged(docs: DataFrame, doc_id: str, text: str, host: str, min_docs: int, max_share: float, min_left: float, either: bool) -> tuple[DataFrame, DataFrame]:
    """The verdicts with host and body, and the removed lines: host, body, line, words."""
    rows = staged(_measured(docs, doc_id, text, host), "measures")
    classes = rows.groupBy("host", "body").agg(F.min("doc_id").alias("first_doc"), F.first("line_hashes").alias("line_hashes"), F.first("line_words").alias("line_words"))
    above = boilerplate(classes, min_docs, max_share, either)
    lines = classes.select("host", "body", "first_doc", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x")).select("host", "body", "first_doc", F.col("x.line_hashes").alias("line"), F.col("x.line_words").alias("words"))
    gone = lines.join(above, ["host", "line"]).where(~F.col("first_doc").eqNullSafe(F.col("keeper")) | F.col("keeper").isNull())
    removed = gone.groupBy("host", "body").agg(F.sum("words").alias("n_removed"))
    judged = rows.drop("line_hashes", "line_words").join(removed, ["host", "body"], "left").withColumn("n_removed", F.coalesce(F.col("n_removed"), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed") >= F.col("n_words") * min_left
    return judged.withColumns({"base_failed": failed, "kept": ~failed & left}), gone.select("host", "body", "line", "words")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, either: bool = True) -> DataFrame:
    """A row per document: its measures, base_failed, n_removed (words in removed lines) and kept."""
    judged, _ = _judged(docs, doc_id, text, host, min_docs, max_share, min_left, either)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def without_lines(data: bytes, lines: set[int]) -> bytes:
    """The text without the lines of these hashes."""
    return b"\n".join(x for x in data.split(b"\n") if not x.strip(WHITE) or line_hash(normal_line(x)) not in lines)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", either: bool = True) -> DataFrame:
    """docs without the rejected ones and without the removed lines, the number of characters put right.

    All other columns are as they are. Rows with a null id stay, for no verdict names them; their lines go as those of others do.
    """
    judged, gone = _judged(docs, doc_id, text, host, MIN_DOCS, MAX_SHARE, MIN_LEFT, either)
    judged, gone = staged(judged.where(~F.col("kept")).select("doc_id").distinct(), "rejected"), staged(gone.groupBy("host", "body").agg(F.collect_set("line").alias("lines")), "removed")
    bad = fresh(docs, "rejected_id")
    good = docs.join(judged.select(F.col("doc_id").alias(bad)), F.col(doc_id).cast("long") == F.col(bad), "left_anti")
    own_host, own_body, lines = (fresh(docs, x) for x in ("line_host", "line_body", "lines_gone"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = good.withColumns({own_host: _host(host), own_body: F.unhex(F.md5(body))})
    sides = gone.select(F.col("host").alias(own_host), F.col("body").alias(own_body), F.col("lines").alias(lines))
    joined = keyed.join(sides, [own_host, own_body], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or r is None else without_lines(t.encode(), set(r)).decode() for t, r in zip(texts, removed, strict=True)], dtype=object)

    out = joined.withColumn(text, cut(F.col(text), F.col(lines)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(lines).isNotNull() & F.col(text).isNotNull(), F.char_length(text).cast("long")).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
