"""Folding, tokens, scores and rules on texts, as Columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in lexical search; fixed values, accents folded.
STOP_WORDS = ("bao", "bang", "cac", "cho", "co", "cong", "cua", "cuoi", "den", "dong", "giua", "la", "nam", "ngay", "nhieu", "so", "theo", "trong", "trieu", "ty", "vao", "va")
#: Words that carry no meaning where a question meets labels; fixed values, with accents.
QUESTION_STOP_WORDS = ("bao", "bằng", "các", "có", "công", "của", "cuối", "đến", "đồng", "là", "năm", "ngày", "nhiêu", "số", "tháng", "theo", "trong", "triệu", "ty", "tỷ", "vào", "và")
#: What may stand before a company's name, longer before shorter; fixed values.
COMPANY_PREFIXES = ("ngân hàng thương mại cổ phần", "ngân hàng tmcp", "ngân hàng", "tổng công ty cổ phần", "tổng công ty", "tập đoàn", "công ty cổ phần", "công ty tnhh", "công ty", "ctcp")
#: Words of names that many companies bear; fixed values, accents folded.
COLLISION_STOP_WORDS = ("bao", "co", "cong", "ctcp", "dau", "doan", "hang", "ngan", "phan", "phat", "tap", "thuong", "tong", "trien", "ty", "viet", "nam", "tmcp", "tnhh")
#: Factors between units that a program may multiply or divide by; fixed values.
KNOWN_SCALES = (1e3, 1e5, 1e6, 1e9, 1e11, 1e12)
#: Letters, digits and the underscore of any script.
LETTER = r"[\p{L}\p{N}_]"
WORD = f"{LETTER}+"
#: Units in questions with their factors, the first that is found counts; fixed values.
UNITS = (("trăm tỷ đồng", 1e11), ("nghìn tỷ đồng", 1e12), ("triệu cổ phiếu", 1e6), ("triệu đồng", 1e6), ("tỷ đồng", 1e9))


def _fold_map() -> tuple[str, str]:
    """Each character that is a letter with marks, and that letter."""
    pairs = {"đ": "d"}
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]) and chr(code).lower() == chr(code):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _fold_map()


def _fold(text: str) -> str:
    return text.lower().translate(str.maketrans(_FROM, _TO))


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _FROM, _TO)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Folded words of two characters or more without stop words; if nothing is left, with them.

    The words of a text are folded together, for folding one by one costs far more.
    """
    words = F.array_join(F.regexp_extract_all(text, F.lit(rf"({LETTER}{{2,}})"), F.lit(1)), " ")
    # many texts are ASCII, and to look up each letter for its marks costs more than the rest
    folded = let(words, lambda w: F.filter(F.split(F.when(w.rlike(r"[^\x00-\x7F]"), fold(w)).otherwise(F.lower(w)), " "), lambda x: x != ""))
    meaning = lambda w: F.filter(w, lambda x: ~x.isin(*STOP_WORDS))
    return let(folded, lambda w: let(meaning(w), lambda k: F.when(F.size(k) > 0, k).otherwise(w)))


def counted(terms: Column) -> Column:
    """array<struct<term, tf>>: the different terms, sorted, and how often each is there; null stays null."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s: let(starts(s), lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))))
    # sequence() would count down for an empty array
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<term: string, tf: bigint>>")).otherwise(runs(s)))


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def question_tokens(text: Column) -> Column:
    """The different words of two characters or more that carry meaning."""
    return F.filter(F.array_distinct(words(text)), lambda w: (F.char_length(w) > 1) & ~w.isin(*QUESTION_STOP_WORDS))


def is_phrase(label: Column, asked: Column) -> Column:
    """Is the label, in words, within a question's words, joined? It must have two words, or be an acronym in capitals."""
    acronym = F.trim(label).rlike("^[A-Z][A-Z0-9/.-]{2,9}$")
    return let(words(label), lambda w: (F.size(w) > 0) & ((F.size(w) >= 2) | acronym) & F.contains(asked, F.array_join(w, " ")))


def without_company_form(name: Column) -> Column:
    """A company's name without the words for its form before it, as many as there are, and without "- CTCP" behind it."""
    folded = [_fold(p) for p in COMPANY_PREFIXES]
    before = lambda n: F.regexp_extract(fold(n), f"^((?:(?:{'|'.join(folded)}) )+)", 1)
    rest = let(collapse(name), lambda n: F.array_join(F.slice(F.split(n, " "), F.size(F.split(before(n), " ")), F.size(F.split(n, " "))), " "))
    return collapse(F.regexp_replace(rest, r"(?iu)\s*[-–—]\s*(?:CTCP|Công ty cổ phần)\s*$", ""))


def explicit_tickers(question: Column) -> Column:
    """Codes in brackets or behind the word for a code, in capitals."""
    return F.array_distinct(F.regexp_extract_all(F.upper(question), F.lit(r"(?iuU)(?:\(\s*|\bmã(?:\s+cổ\s+phiếu)?\s+)([A-Za-z0-9]+)(?:\s*\)|\b)"), F.lit(1)))


def bare_tickers(question: Column) -> Column:
    """Words of 2 to 8 ASCII letters and digits that are written in capitals."""
    found = F.regexp_extract_all(question, F.lit(r"(?<![A-Za-z0-9])([A-Za-z0-9]{2,8})(?![A-Za-z0-9])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: t.rlike("[A-Z]") & ~t.rlike("[a-z]")))


def names_word(text: Column, word: Column) -> Column:
    """Does the text hold the word, ASCII letters and digits apart, in any case?"""
    return F.contains(F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "[^a-z0-9]+", "  "), F.concat(F.lit(" "), F.lower(word), F.lit(" ")))


def known_scale(value: Column) -> Column:
    """struct<scale, reciprocal>: the known factor that a number, or one over it, is within 1e-5 of; null for others."""
    out = F.when(F.lit(False), F.struct(F.lit(0.0).alias("scale"), F.lit(False).alias("reciprocal")))
    near = lambda a: F.abs(value - a) <= 1e-5 * F.greatest(F.abs(value), F.lit(a))
    for scale in KNOWN_SCALES:
        for reciprocal, factor in ((False, scale), (True, 1 / scale)):
            out = out.when(near(factor), F.struct(F.lit(scale).alias("scale"), F.lit(reciprocal).alias("reciprocal")))
    return F.when(is_number(value) & (value > 0), out)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0b]+", " "))


def bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """What a term adds to the score of a document."""
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_factor(question: Column) -> Column:
    """The factor of the first unit that a question names; null if it names none."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, factor in UNITS:
        out = out.when(F.contains(F.lower(question), F.lit(name)), F.lit(factor))
    return out


def raw_scale(largest: Column) -> Column:
    """The unit of stored values by the largest of them: 1 from 1e10 on, a million up to 1e9, unknown between."""
    return F.when(largest >= 1e10, 1.0).when(largest <= 1e9, 1e6)


def is_close(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def is_number(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
