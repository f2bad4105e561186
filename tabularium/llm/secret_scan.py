"""Secret scans with DataFrame functions alone.

Three patterns give base spans: assignments to names such as password, access
keys, and long hexadecimal runs. The method adds stretches of key characters whose
entropy is high: a window slides over each candidate, the counts of its
characters are kept up to date (one comes in, one goes out), and so is the sum
of c * log2(c) over the counts, from which Shannon's entropy follows. The
threshold depends on the character class: hexadecimal candidates, windows with
digits and letters, and windows of letters of both cases.

Candidates are runs of key characters outside of base spans; these, and words such as
"example" that stand by themselves in a path, part them. Hot windows that overlap or touch are one stretch, so a
run can hold several secrets. The allow-list has two kinds: shapes that a whole candidate may have (UUIDs, slugs,
published digests), and words that may not stand in a stretch or within a window's length of it.

Everything is computed within a row; nothing is shuffled. Spans are summed,
merged and cut in blocks, so that no step goes over the whole text for each span.

Defined results: null and empty texts have no spans; repeated rows have a row
each; null ids are kept; an empty table gives no rows; other columns are
ignored by scan() and kept by redact(). Base spans of different kinds may
overlap and all stay, by start, then kind; redact() marks what overlaps once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A cheaper pattern that each assignment holds.
MAY_ASSIGN = r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""
#: Greedy runs that are too short fail as a whole, so their minimum can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Bits a character above which a window is random: in hexadecimal candidates, with digits and letters, and of letters in both cases alone.
HEX_BITS, OTHER_BITS, LETTER_BITS = 2.9, 3.7, 4.0
#: Shapes of candidates that are not secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?[A-Za-z]+([-_/=+][A-Za-z]*|[-_/][0-9]{1,4})+$",
    r"^sha(1|256|384|512)[-_:=]",
)
#: What stands in or beside stretches that are not secrets.
HARMLESS = r"(?i)example|placeholder|your[-_]|x{6}|0123456789|1234567890|abcdefgh|deadbeef"
#: Words that part candidates where they stand by themselves, next to a separator.
PARTING, SEPARATOR = ("example", "placeholder"), "[+/_=-]"
MARK = "[SECRET]"
#: Matches that are summed in one fold; counts in a word, and bits of a count.
BLOCK, PACKED, COUNT_BITS = 256, 11, 5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(size: Column) -> Column:
    """The first places, from 1, of the blocks of so many values; one at least."""
    return F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(BLOCK))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the leftmost matches that don't overlap, in code points.

    Running sums of lengths are folded in two steps, within blocks of matches and over blocks, for each step of a fold
    copies what it has gathered.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = lambda x: F.transform(x, F.char_length)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def within(both: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + x["gap"]
            b = a + x["size"]
            return F.struct(b.alias("at"), F.array_append(acc["all"], F.struct(a.alias("start"), b.alias("end"))).alias("all"))

        return F.aggregate(both, F.struct(start.alias("at"), none.alias("all")), step, lambda acc: acc["all"])

    def summed(both: Column) -> Column:
        part = lambda first: F.slice(both, first, F.lit(BLOCK))
        totals = F.transform(_blocks(F.size(both)), lambda first: F.aggregate(part(first), F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        return F.flatten(F.transform(F.arrays_zip(_blocks(F.size(both)).alias("first"), F.slice(starts, 1, F.size(starts) - 1).alias("start")), lambda b: within(part(b["first"]), b["start"])))

    both = _let(sizes(found), lambda own: F.arrays_zip(own.alias("size"), F.slice(sizes(between), 1, F.greatest(F.size(own), F.lit(1))).alias("gap")))
    return _let(F.filter(both, lambda x: x["size"].isNotNull()), summed)


def _highest(values: Column) -> Column:
    """The greatest value up to each place, folded within blocks and over blocks."""
    part = lambda first: F.slice(values, first, F.lit(BLOCK))
    grown = lambda x, start: F.aggregate(x, F.array(start), lambda acc, v: F.array_append(acc, F.greatest(F.element_at(acc, -1), v)), lambda acc: F.slice(acc, F.lit(2), F.size(acc) - 1))
    starts = F.aggregate(F.transform(_blocks(F.size(values)), lambda first: F.array_max(part(first))), F.array(F.lit(0)), lambda acc, v: F.array_append(acc, F.greatest(F.element_at(acc, -1), F.coalesce(v, F.lit(0)))))
    return F.flatten(F.transform(F.arrays_zip(_blocks(F.size(values)).alias("first"), F.slice(starts, 1, F.size(starts) - 1).alias("start")), lambda b: grown(part(b["first"]), b["start"])))


def _merged(spans: Column) -> Column:
    """Sorted spans as array<struct<start, end>> that don't overlap; those that touch stay apart."""

    def with_ends(own: Column, ends: Column) -> Column:
        # a span begins a group if none before it reaches over its start, and ends one if the next begins one
        starts = F.filter(own, lambda x, i: (i == 0) | (x["start"] >= F.get(ends, i - 1)))
        lasts = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | (F.get(own, i + 1)["start"] >= e))
        return F.transform(F.arrays_zip(starts.alias("s"), lasts.alias("end")), lambda x: F.struct(x["s"]["start"].alias("start"), x["end"].alias("end")))

    return _let(spans, lambda own: _let(_highest(F.transform(own, lambda x: x["end"])), lambda ends: with_ends(own, ends)))


def _pieces(text: Column, apart: Column) -> Column:
    """The pieces of the text before, between and behind spans that don't overlap: one more than spans.

    The text is cut into the parts that blocks of spans cover, and these into pieces, so no cut starts at the text's beginning.
    """

    def cut(spans: Column) -> Column:
        begin = lambda first: F.when(first == 1, F.lit(0)).otherwise(F.get(spans, first - 2)["end"])
        end = lambda first: F.when(first + BLOCK > F.size(spans), F.char_length(text)).otherwise(F.get(spans, first + BLOCK - 2)["end"])

        def block(first: Column) -> Column:
            own, base = F.slice(spans, first, F.lit(BLOCK)), begin(first)
            inside = lambda part: F.transform(own, lambda x, i: F.substr(part, F.when(i == 0, F.lit(0)).otherwise(F.get(own, i - 1)["end"] - base) + 1, x["start"] - F.when(i == 0, base).otherwise(F.get(own, i - 1)["end"])))
            return _let(F.substr(text, base + 1, end(first) - base), inside)

        behind = F.substr(text, F.coalesce(F.element_at(spans, -1)["end"], F.lit(0)) + 1)
        return F.concat(F.flatten(F.transform(_blocks(F.size(spans)), block)), F.array(behind))

    return _let(apart, cut)


def _blanked(text: Column, base: Column) -> Column:
    """The text with spaces in place of base spans and of words that part candidates."""
    spaces = lambda spans: F.transform(spans, lambda x: F.repeat(F.lit(" "), x["end"] - x["start"]))
    zipped = lambda spans: F.array_join(F.flatten(F.transform(F.arrays_zip(_pieces(text, spans).alias("piece"), spaces(spans).alias("gap")), lambda x: F.array(x["piece"], F.coalesce(x["gap"], F.lit(""))))), "")
    out = F.when(F.size(base) > 0, _let(_merged(base), zipped)).otherwise(text)
    for word in PARTING:
        alone = rf"(?<![A-Za-z0-9])(?i:{word})(?={SEPARATOR})|(?<={SEPARATOR})(?i:{word})(?![A-Za-z0-9])"
        out = F.regexp_replace(out, alone, " " * len(word))
    return out


def _spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end")))


_NO_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _found(text: Column, kind: str, pattern: str, may: str | None = None) -> Column:
    return F.when(text.rlike(may or pattern), _spans(_places(text, pattern), kind)).otherwise(F.array().cast(_NO_SPANS))


def _assigned(text: Column) -> Column:
    """As _found(), without those whose value is too short; these still take their characters."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    kept = F.filter(F.arrays_zip(_spans(_places(text, ASSIGN), "assign").alias("span"), F.transform(values, F.char_length).alias("size")), lambda x: x["size"] >= LEAST_VALUE)
    return F.when(text.rlike(MAY_ASSIGN), F.transform(kept, lambda x: x["span"])).otherwise(F.array().cast(_NO_SPANS))


def hot_stretches(candidate: Column, bits: Column) -> Column:
    """array<struct<first, last>>: the stretches of windows with more bits than given that overlap or touch.

    Windows must hold a digit and a letter, or letters in both cases and LETTER_BITS. The counts of a window's characters are kept in
    words of PACKED counts, COUNT_BITS bits each; a character that comes in or goes out changes one of them.
    """
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    among = lambda k, low, high: ((k >= low) & (k < high)).cast("int")
    word = lambda k: ((k - k % PACKED) / PACKED).cast("int")
    bit = lambda k: (k % PACKED * COUNT_BITS).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), bit(k))
    count = lambda counts, k: F.call_function("shiftright", F.get(counts, word(k)), bit(k)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
    none = F.array().cast("array<struct<first:int,last:int>>")
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("upper"), F.lit(0).alias("lower"), F.lit(0).alias("digits"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), none.alias("done"))
    now = lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))

    def step(acc: Column, x: Column) -> Column:
        i, new, old = x["i"], x["new"], x["old"]
        came = F.get(terms, count(acc["counts"], new) + 1) - F.get(terms, count(acc["counts"], new))
        count_old = count(acc["counts"], old) + (old == new).cast("int")
        went = F.when(old >= 0, F.get(terms, count_old) - F.get(terms, count_old - 1)).otherwise(0.0)
        total = acc["sum"] + came - went
        upper, lower, digits = (acc[c] + among(new, *ends) - among(old, *ends) for c, ends in (("upper", (0, 26)), ("lower", (26, 52)), ("digits", (52, 62))))
        least = F.when((digits > 0) & (upper + lower > 0), bits).when((digits == 0) & (upper > 0) & (lower > 0), F.lit(LETTER_BITS))
        hot = F.coalesce((i >= WINDOW - 1) & (math.log2(WINDOW) - total / WINDOW > least), F.lit(False))
        fresh_one = hot & (acc["last"].isNull() | (i - (WINDOW - 1) > acc["last"]))
        moved = lambda c, k: c + F.when(word(new) == k, one(new)).otherwise(0) - F.when((old >= 0) & (word(old) == k), one(old)).otherwise(0)
        return F.struct(
            F.transform(acc["counts"], moved).alias("counts"),
            total.alias("sum"),
            upper.alias("upper"),
            lower.alias("lower"),
            digits.alias("digits"),
            F.when(fresh_one, i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
            F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
            F.when(fresh_one & acc["last"].isNotNull(), F.array_append(acc["done"], now(acc))).otherwise(acc["done"]).alias("done"),
        )

    def slid(codes: Column) -> Column:
        steps = F.transform(codes, lambda new, i: F.struct(i.alias("i"), new.alias("new"), F.coalesce(F.get(codes, F.when(i >= WINDOW, i - WINDOW)), F.lit(-1)).alias("old")))
        return F.aggregate(steps, zero, step, lambda acc: F.when(acc["last"].isNull(), none).otherwise(F.array_append(acc["done"], now(acc))))

    return _let(F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1), slid)


def _random(text: Column) -> Column:
    """Spans of the candidates' random parts."""
    found = F.arrays_zip(_places(text, RUN).alias("at"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("run"))
    may = lambda run: (run.rlike("[0-9]") & run.rlike("[A-Za-z]") | run.rlike("[A-Z]") & run.rlike("[a-z]")) & ~F.greatest(*(run.rlike(p) for p in ALLOWED))
    bits = lambda run: F.when(run.rlike("^[0-9a-fA-F]+$"), HEX_BITS).otherwise(OTHER_BITS)
    # a harmless word in a stretch, or within a window's length of it in its run
    beside = lambda w, h: (h["start"] < w["last"] + WINDOW) & (h["end"] > w["first"] - WINDOW)
    clean = lambda run, hot: F.when(run.rlike(HARMLESS), _let(_places(run, HARMLESS), lambda harm: F.filter(hot, lambda w: ~F.exists(harm, lambda h: beside(w, h))))).otherwise(hot)
    own = lambda x: F.transform(clean(x["run"], hot_stretches(x["run"], bits(x["run"]))), lambda w: F.struct((x["at"]["start"] + w["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), (x["at"]["start"] + w["last"]).alias("end")))
    return F.when(text.rlike(RUN), F.flatten(F.transform(F.filter(found, lambda x: may(x["run"])), own))).otherwise(F.array().cast(_NO_SPANS))


def with_spans(docs: DataFrame, text: str, base: str, every: str) -> DataFrame:
    """docs with two more columns: the base spans, and these with the method's; array<struct<start, rank, end>> in order."""
    names = [fresh(docs, f"spans_{k}") for k in KINDS]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumns({names[0]: _assigned(whole), names[1]: _found(whole, "access", ACCESS), names[2]: _found(whole, "hex", HEX)})
    out = out.withColumn(base, F.array_sort(F.concat(*names[:3])))
    return out.withColumn(names[3], _blanked(whole, F.col(base))).withColumn(every, F.array_sort(F.concat(F.col(base), _random(F.col(names[3]))))).drop(*names)


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, the number of base spans by kind, the digest of the base spans, all spans."""
    columns = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = with_spans(columns, "text", "base", "every")
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = MARK) -> DataFrame:
    """docs with each span in the text replaced by a mark and the number of characters put right; null texts stay null."""
    base, every = fresh(docs, "base_spans"), fresh(docs, "all_spans")
    found = with_spans(docs, text, base, every)
    whole = F.col(text)

    cut = F.array_join(_pieces(whole, _merged(F.col(every))), mark)
    out = found.withColumn(text, F.when(F.size(every) > 0, cut).otherwise(whole))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.size(every) > 0, F.char_length(text).cast("long")).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
