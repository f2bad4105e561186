"""Structures of unknown shape, kept within bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels, items of a level, and characters of a text and of a name that are kept; what stands in place of a deeper value.
DEPTH, ITEMS, TEXT, NAME = 5, 25, 500, 100
TOO_DEEP = "<depth-limited>"


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return _with(F.to_json(F.array(text)), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))


def bounded(text: Column, depth: int = DEPTH, items: int = ITEMS, longest: int = TEXT, name: int = NAME) -> Column:
    """JSON text cut to so many levels, items and characters, as JSON text with sorted names; null if it is no JSON or null.

    Each array keeps its first items, each object those with the first names by their bytes. Names are cut as well; of names that become equal
    the last one's value stays. A value below the last level, of whatever kind, is replaced by a mark. Numbers stand as Spark's VARIANT writes
    them. A name that an object has twice makes it no JSON. The expression grows with the depth and not with the shapes: objects and
    arrays of a level become one list of items, and each level is written once.
    """

    def level(value: Column, at: int) -> Column:
        if at >= depth:
            return quoted(F.lit(TOO_DEEP))
        return _with(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _with(F.try_variant_get(value, "$", "array<variant>"), lambda a: inside(value, m, a, at)))

    def inside(value: Column, fields: Column, values: Column, at: int) -> Column:
        names = F.slice(F.array_sort(F.map_keys(fields)), 1, items)
        each = F.when(fields.isNotNull(), F.transform(names, lambda k: F.struct(k.alias("k"), F.element_at(fields, k).alias("v")))).otherwise(F.transform(F.slice(values, 1, items), lambda v: F.struct(F.lit(None).cast("string").alias("k"), v.alias("v"))))
        written = F.transform(each, lambda e: F.struct(quoted(F.substring(e["k"], 1, name)).alias("k"), F.when(e["k"].isNotNull(), F.substring(e["k"], 1, name)).alias("cut"), level(e["v"], at + 1).alias("v")))
        lasting = _with(written, lambda w: F.filter(w, lambda x, i: x["cut"].isNull() | ~x["cut"].eqNullSafe(F.get(w, i + 1)["cut"])))
        body = F.array_join(F.transform(lasting, lambda x: F.when(x["cut"].isNotNull(), F.concat(x["k"], F.lit(":"), x["v"])).otherwise(x["v"])), ",")
        scalar = F.when(F.schema_of_variant(value) == "STRING", quoted(F.substring(F.try_variant_get(value, "$", "string"), 1, longest))).otherwise(F.to_json(value))
        edge = lambda one, other: F.when(fields.isNotNull(), one).otherwise(other)
        # body holds all deeper levels, so it stands once: twice would double the expression at each level
        whole = F.when(fields.isNotNull() | values.isNotNull(), F.concat(edge("{", "["), body, edge("}", "]"))).otherwise(scalar)
        return F.when(value.isNull(), "null").otherwise(whole)

    return _with(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), level(v, 0)))
