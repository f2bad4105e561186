"""Chat formatting: links tool calls to their results and writes canonical records.

Calls and results meet in a hash join on conversation and identifier. Each
call gets a level, the length of the longest chain of calls that it waits
for, so that ordering by level is a topological order; calls in or behind a
cycle have none. Conversations whose identifiers take MOST_BYTES at most are ordered in one pass
over their rows; in larger ones chains of calls that need one other are jumped
over by doubling, and rounds over all other calls in parallel settle those whose
needs are settled. Arguments are validated
against the schema of their tool, and each call is written as JSON with sorted
keys, without spaces, in UTF-8.

Defined results: of several calls (or results) with the same identifier the
first by turn counts, and the status says so; calls without identifier are
kept, unlinked; results without call are kept with status "no call"; unknown
needs are listed and not waited for; null arguments are invalid JSON, and so are
those with half a surrogate pair or nested more than DEPTH deep; tools
without schema take anything; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import discard, staged

#: Bytes of identifiers (16 more for each) of a conversation that one task orders: some million calls.
MOST_BYTES = 1 << 26
#: How deep arguments may be nested.
DEPTH = 100


def canonical(value: object) -> str:
    """JSON with sorted keys, without spaces; numbers that are whole have no fraction; no NaN."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        if isinstance(x, Mapping):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def depth(value: object) -> int:
    """How many lists and objects lie in one another."""
    n, now = 0, [value]
    while now := [x for x in now if isinstance(x, (list, dict))]:
        n, now = n + 1, [y for x in now for y in (x if isinstance(x, list) else x.values())]
    return n


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """What breaks the schema: types, enum, required and further properties, items, lengths, bounds, patterns."""
    kind, out = schema.get("type"), []
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not any(number and (k == "number" or k == "integer" and value == int(value)) if k in ("number", "integer") else isinstance(value, _TYPES[k]) for k in kinds):
            return [f"{at}: not of type {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not allowed")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in own:
                out += violations(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not expected")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, (str, list)):
        name = "Length" if isinstance(value, str) else "Items"
        if not schema.get(f"min{name}", 0) <= len(value) <= schema.get(f"max{name}", math.inf):
            out.append(f"{at}: length {len(value)}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: no match")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        out.append(f"{at}: out of bounds")
    return out


def levels_of(needs: Mapping[str, list[str]]) -> dict[str, int]:
    """The level of each call of a conversation; calls in or behind a cycle are left out."""
    waiting = {c: {d for d in own if d in needs} for c, own in needs.items()}
    behind: dict[str, list[str]] = {}
    for c, own in waiting.items():
        for d in own:
            behind.setdefault(d, []).append(c)
    level = {c: 0 for c, own in waiting.items() if not own}
    ready = list(level)
    while ready:
        now = ready.pop()
        for c in behind.get(now, ()):
            waiting[c].discard(now)
            if not waiting[c]:
                level[c] = 1 + max(level[d] for d in needs[c] if d in needs)
                ready.append(c)
    return level


def _levels_small(calls: DataFrame) -> DataFrame:
    """Conversations that a task can hold: their rows arrive one after the other."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None

        def flush() -> pa.RecordBatch:
            level = levels_of(held)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(held), pa.string()), pa.array(held, pa.string()), pa.array([level.get(c) for c in held], pa.int32())], ["conv", "call", "level"])

        for batch in rows:
            for conv, call, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if held:
                        yield flush()
                    held, now = {}, conv
                held[call] = needs or []
        if held:
            yield flush()

    return calls.select("conv", "call", "needs").repartition("conv").sortWithinPartitions("conv", "call").mapInArrow(run, "conv string, call string, level int")


def _jumps(single: DataFrame, n: int) -> DataFrame:
    """(conv, call, to, distance): from each call that needs one other along such calls to the first that does not; none for those in a cycle.

    The way of a call doubles in each round.
    """
    now = staged(single.select("conv", "call", F.col("need").alias("to"), F.lit(1).cast("long").alias("distance")), "jumps")
    for _ in range(n.bit_length()):
        further = now.select("conv", F.col("call").alias("to"), F.col("to").alias("beyond"), F.col("distance").alias("more"))
        joined = now.join(further, ["conv", "to"], "left")
        if joined.where("beyond is not null").isEmpty():
            break
        held, now = now, staged(joined.select("conv", "call", F.coalesce("beyond", "to").alias("to"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance")), "jumps")
        discard(held)
    ends = single.select("conv", F.col("call").alias("to"))
    return now.join(ends, ["conv", "to"], "left_anti").select("conv", "call", "to", "distance")


def _levels_large(calls: DataFrame) -> DataFrame:
    """Conversations of any size: chains of calls that need one other are jumped over, then rounds of joins settle the other calls."""
    edges = staged(calls.select("conv", "call", F.explode(F.array_distinct("needs")).alias("need")).join(calls.select("conv", F.col("call").alias("need")), ["conv", "need"], "left_semi").select("conv", "call", "need"), "needs")
    needed = edges.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("n"))
    single = staged(edges.join(needed.where("n = 1"), ["conv", "call"], "left_semi").select("conv", "call", "need"), "single")
    jumps = staged(_jumps(single, single.count()), "jumped")
    # a need that is such a call stands for the call at the end of its chain, so much further; one that leads into a cycle stays and is never settled
    far = jumps.select("conv", F.col("call").alias("need"), "to", "distance")
    knots = edges.join(needed.where("n > 1"), ["conv", "call"], "left_semi").join(far, ["conv", "need"], "left")
    knots = staged(knots.select("conv", "call", F.coalesce("to", "need").alias("need"), (F.coalesce("distance", F.lit(0)) + 1).alias("step")), "knots")
    done = staged(calls.select("conv", "call").join(edges, ["conv", "call"], "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    out, new = done, done
    while not new.isEmpty():
        met = knots.join(out.select("conv", F.col("call").alias("need"), "level"), ["conv", "need"], "left").groupBy("conv", "call").agg(F.max(F.col("level") + F.col("step")).alias("top"), F.bool_and(F.col("level").isNotNull()).alias("ready"))
        new = staged(met.where("ready").select("conv", "call", F.col("top").alias("level")).join(out, ["conv", "call"], "left_anti"), "levels")
        held, out = out, staged(out.unionByName(new), "levels")
        discard(held)
    along = jumps.join(out.select("conv", F.col("call").alias("to"), "level"), ["conv", "to"]).select("conv", "call", (F.col("level") + F.col("distance")).alias("level"))
    return calls.select("conv", "call").join(out.unionByName(along), ["conv", "call"], "left").select("conv", "call", F.col("level").cast("int").alias("level"))


def levels(calls: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(conv, call, level) for calls (conv, call, needs) whose identifiers are unique."""
    needed = F.aggregate("needs", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    sizes = calls.groupBy("conv").agg(F.sum(F.octet_length("call") + 16 + needed).alias("n"))
    large = sizes.where(F.col("n") > most).select("conv")
    if large.isEmpty():
        return _levels_small(calls)
    return _levels_small(calls.join(large, "conv", "left_anti")).unionByName(_levels_large(staged(calls.join(large, "conv", "left_semi"), "calls")))


_OUT = "conv string, call string, turn long, name string, level int, result_turn long, status string, errors array<string>, record string"


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], most: int = MOST_BYTES) -> DataFrame:
    """A row per call, and per result without call.

    calls: conv, call (identifiers), turn, name, arguments (JSON), needs (identifiers of calls);
    results: conv, call, turn, content.
    """
    own = calls.select(F.col("conv").cast("string").alias("conv"), F.col("call").cast("string").alias("call"), F.col("turn").cast("long").alias("turn"), "name", "arguments", F.coalesce(F.filter("needs", lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("needs"))
    got = results.select(F.col("conv").cast("string").alias("conv"), F.col("call").cast("string").alias("call"), F.col("turn").cast("long").alias("turn"), "content")
    named = "conv is not null and call is not null"
    first = own.where(named).groupBy("conv", "call").agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    answer = got.where(named).groupBy("conv", "call").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    level = levels(first.select("conv", "call", "c.needs"), most)
    joined = first.join(answer, ["conv", "call"], "full").join(level, ["conv", "call"], "left")
    joined = joined.select("conv", "call", "c", "n_calls", "r", "n_results", "level")
    loose = own.where(f"not ({named})").select("conv", "call", F.struct("turn", "name", "arguments", "needs").alias("c"), F.lit(1).cast("long").alias("n_calls"), F.lit(None).cast(answer.schema["r"].dataType).alias("r"), F.lit(None).cast("long").alias("n_results"), F.lit(None).cast("int").alias("level"))
    stray = got.where(f"not ({named})").select("conv", "call", F.lit(None).cast(first.schema["c"].dataType).alias("c"), F.lit(None).cast("long").alias("n_calls"), F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"), F.lit(None).cast("int").alias("level"))
    every = joined.unionByName(loose).unionByName(stray)
    rows = every.select("conv", "call", "c.turn", "c.name", "c.arguments", "c.needs", "n_calls", F.col("r.turn").alias("result_turn"), "r.content", "n_results", "level")
    schemas = dict(schemas)

    def one(x: dict) -> tuple:
        if x["n_calls"] is None:
            return (x["conv"], x["call"], None, None, None, x["result_turn"], "no call", [], canonical({"id": x["call"], "result": x["content"]}))
        errors, text = [], "null"
        try:
            arguments = json.loads(x["arguments"] if x["arguments"] is not None else "")
            if depth(arguments) > DEPTH:
                raise ValueError("nested too deep")
            if x["name"] in schemas:
                errors = violations(arguments, schemas[x["name"]])
                "".join(errors).encode()
            (text := canonical(arguments)).encode()
        except (ValueError, RecursionError):  # no JSON, no characters of Unicode, or nested too deep
            errors, text = ["$: no JSON"], "null"
        loose = x["conv"] is None or x["call"] is None
        status = "no identifier" if loose else "cycle" if x["level"] is None else "invalid" if errors else "several calls" if x["n_calls"] > 1 else "no result" if x["n_results"] is None else "several results" if x["n_results"] > 1 else "ok"
        rest = {"id": x["call"], "name": x["name"], "needs": sorted(set(x["needs"])), "level": x["level"], "result": x["content"]}
        record = f'{{"arguments":{text},{canonical(rest)[1:]}'  # the first of the sorted keys, as it was written when it was checked
        return (x["conv"], x["call"], x["turn"], x["name"], x["level"], x["result_turn"], status, errors, record)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            out = [one(x) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(len(kinds))], names)

    return rows.mapInArrow(run, _OUT)


#: What a turn of a plain conversation may ask: the tool that calls_of() names.
TURN_SCHEMAS = {"answer": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 1, "maximum": 4096}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain conversation (conv_id, turn, role, text).

    A user's turn calls the tool "answer" under the identifier conv-turn, and needs the call two turns before;
    an assistant's turn is the result of the call of the turn before. Other turns are neither.
    """
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1)))
    asked = turns.where("role = 'user'")
    calls = asked.select(F.col("conv_id").cast("string").alias("conv"), F.when(known, name(0)).alias("call"), "turn", F.lit("answer").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn", words.alias("words"))).alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(2))).alias("needs"))
    told = turns.where("role = 'assistant'")
    results = told.select(F.col("conv_id").cast("string").alias("conv"), F.when(known, name(1)).alias("call"), "turn", F.col("text").alias("content"))
    return calls, results
