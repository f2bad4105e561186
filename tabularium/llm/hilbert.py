"""Shards along a Hilbert curve, so that a file holds a small range of several metadata columns at once.

Each dimension is quantised into cells that hold about equally many rows: the
values, numbers by the buckets of a fine grid, are counted and sorted, and a
cell ends where the running count passes the next multiple. The cells of all
dimensions give a place on the Hilbert curve; rows are sorted by it, and the
sorted sequence is cut into runs, which are the shards. Neighbours on the curve
are neighbours in all dimensions, so that the least and greatest values kept of
each file tell most files apart for ranges in any dimension, or in several.

Laws of a cut: `rows` (row counts at most one apart) or `bytes` (a row goes to the
shard that holds the middle of its bytes, so that sums are near equal).

The global order needs no task that sees all rows: rows are range-partitioned
by the curve and then by tie columns, sorted and numbered in each partition and
written; the counts and sums of the partitions, a row for each, are added up
to where each partition begins. A row number breaks the last ties, so copies of one row, however many, are
split like other rows.

Defined results: a null has cell 0, the cell of the least values, and never
counts as a boundary; NaN goes to the last cell; a dimension of one value has one cell; equal keys are
ordered by the tie columns, nulls first, then by their place in the input; repeated
rows keep a place each; with fewer rows than shards some shards are empty; an
empty table gives no rows; all columns stay, and a column whose name
the result needs itself is refused before any work (the query selects its columns).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm.common import discard, numbered, staged

#: Bits of a dimension, and buckets of the grid by which numbers are counted.
BITS, GRID = 5, 1 << 12
SHARDS = 24
LAWS = ("rows", "bytes")


def curve_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each point; cells: for each dimension numbers below 2 ** bits.

    The cube is halved in all dimensions bit by bit. At each step the corner that
    a point lies in, seen in the frame of its sub-cube, gives the next digits by
    the Gray code; the frame of a sub-cube is its entry corner and its direction.
    """
    d = len(cells)
    if d * bits > 62:
        raise ValueError(f"{d} dimensions of {bits} bits do not fit 62 bits")
    mask = (1 << d) - 1
    points = [np.asarray(c).astype(np.int64) for c in cells]
    entry, turn, out = (np.zeros(len(points[0]), np.int64) for _ in range(3))

    def rolled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The d bits of x, moved down by so many places, the lowest ones to the top."""
        return (x >> by | x << (d - by)) & mask

    for level in reversed(range(bits)):
        corner = sum((p >> level & 1) << k for k, p in enumerate(points))
        digit = rolled(corner ^ entry, turn)
        for step in (1, 2, 4, 8, 16, 32):  # the inverse of the Gray code
            if step < d:
                digit = digit ^ digit >> step
        out = out << d | digit
        # the sub-cube is entered at the Gray code of the even digit before, and crossed along the bit that changes at the odd one
        even = np.maximum(digit - 1, 0) & ~1
        entry = entry ^ rolled(even ^ even >> 1, (d - turn) % d)
        odd = np.where(digit & 1, digit, np.maximum(digit - 1, 0))
        turn = (turn + np.bitwise_count((odd ^ (odd + 1)) >> 1) * (digit > 0) + 1) % d
    return out


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of docs with the text's size, text_crc32 and text_hash, written to the shared folder: texts are read once, though rows are sorted."""
    body = F.coalesce(F.col(text), F.lit(""))
    new = {"size": F.octet_length(body).cast("long") + 8, "text_crc32": F.crc32(body.cast("binary")), "text_hash": F.xxhash64(body)}
    return staged(docs.withColumns(new).drop(text), "described")


def _sort_key(df: DataFrame, name: str) -> Column:
    """Numbers, dates and times as doubles, all else as strings."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.NumericType | T.TimestampType | T.BooleanType):
        return F.col(name).cast("double")
    return F.col(name).cast("string")


def boundaries(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> list[list]:
    """For each dimension the greatest values of its cells but the last; a value that fills several cells stands several times."""
    cells = 1 << bits
    keys = {d: _sort_key(df, d) for d in dims}
    keyed = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys.values())))
    numbers = [c for c, kind in keyed.dtypes if kind == "double"]
    found: dict[str, list] = {c: [] for c in keyed.columns}
    if numbers:
        # NaN sorts last and is nobody's boundary
        real = keyed.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in numbers))
        ends = real.agg(*(f(c).alias(f"{c}{s}") for c in numbers for f, s in ((F.min, "low"), (F.max, "high")))).first()
        # a grid of equal steps of the logarithm tells small values apart, however great the greatest is
        steps = F.array(*(F.struct(F.lit(c).alias("dim"), F.floor(F.log1p(F.col(c) - ends[f"{c}low"]) * (GRID / max(1e-300, float(np.log1p(ends[f"{c}high"] - ends[f"{c}low"]))))).alias("step"), F.col(c).alias("key")) for c in numbers if ends[f"{c}low"] is not None))
        if any(ends[f"{c}low"] is not None for c in numbers):
            seen = real.select(F.inline(steps)).where("key IS NOT NULL").groupBy("dim", "step").agg(F.max("key").alias("key"), F.count("*").alias("n"))
            for row in sorted(seen.collect(), key=lambda r: (r["dim"], r["key"])):  # GRID + 1 rows of a dimension at most
                found[row["dim"]].append((row["key"], row["n"]))
    out = []
    for c in keyed.columns:
        if c in numbers:
            pairs = found[c]
            total, upto = sum(n for _, n in pairs), np.cumsum([n for _, n in pairs])
            at = np.searchsorted(upto, np.arange(1, cells) * total / cells) if pairs else []
            out.append([pairs[k][0] for k in at])
        else:
            counts = keyed.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n"))
            placed, _, total = numbered(counts, ["key"], F.col("n"))
            ends = placed.select("key", (F.col("bytes_before") * cells / total).alias("a"), ((F.col("bytes_before") + F.col("n")) * cells / total).alias("b"))
            # a multiple that the running count reaches with this value
            rows = ends.select("key", (F.floor("a") + 1).alias("first"), F.least(F.floor("b"), F.lit(cells - 1)).alias("last")).where("first <= last").collect()  # fewer than cells
            out.append([r["key"] for r in sorted(rows, key=lambda r: r["first"]) for _ in range(r["first"], r["last"] + 1)])
            discard(placed)
    return out


def curve(df: DataFrame, dims: Sequence[str], bits: int = BITS, bounds: list[list] | None = None) -> Column:
    """The place on the curve of a row of df."""
    bounds = boundaries(df, dims, bits) if bounds is None else bounds

    def cell(key: Column, most: list) -> Column:
        passed = F.size(F.filter(F.array(*map(F.lit, most)), lambda x: x < key)) if most else F.lit(0)
        return F.coalesce(F.when(key.isNotNull(), passed), F.lit(0))

    @F.pandas_udf("long")
    def place(*cells: pd.Series) -> pd.Series:
        return pd.Series(curve_index([c.to_numpy() for c in cells], bits))

    return place(*(cell(_sort_key(df, d), most) for d, most in zip(dims, bounds, strict=True)))


def sharded(df: DataFrame, dims: Sequence[str], n_shards: int = SHARDS, law: str = "rows", size: Column | None = None, ties: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """df with curve, shard and slot (the place in its shard), and the columns rank and bytes_before of the whole order."""
    if law not in LAWS:
        raise ValueError(f"law {law!r} is none of {LAWS}")
    if {"rank", "bytes_before", "curve", "shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError("rename columns called rank, bytes_before, curve, shard or slot first")
    placed, n, total = numbered(df.withColumn("curve", curve(df, dims, bits)), ["curve", *ties], size)
    if law == "rows":
        shard = F.expr(f"rank * {n_shards} div {max(1, n)}")
        first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
        return placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).withColumn("shard", F.col("shard").cast("int"))
    size = F.lit(0) if size is None else size
    middle = F.floor((F.col("bytes_before") * 2 + size) * n_shards / (2 * max(1, total)))
    cut = placed.withColumn("shard", F.least(F.lit(n_shards - 1), middle).cast("int"))
    firsts = F.broadcast(cut.groupBy("shard").agg(F.min("rank").alias("_first")))  # a row per shard
    return cut.join(firsts, "shard").withColumn("slot", F.col("rank") - F.col("_first")).drop("_first")


def write(sharded_rows: DataFrame, path: str, dims: Sequence[str], file_rows: int = 1 << 20) -> None:
    """Files of so many rows of a shard at most, in order, with a manifest of each file's least and greatest values."""
    cut = sharded_rows.withColumn("file", F.expr(f"slot div {file_rows}").cast("int"))
    cut.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").write.partitionBy("shard", "file").parquet(f"{path}/data")
    limits = [f(d).alias(f"{s}_{d}") for d in dims for f, s in ((F.min, "least"), (F.max, "most"))]
    back = sharded_rows.sparkSession.read.parquet(f"{path}/data")
    back.groupBy("shard", "file").agg(F.count("*").alias("n_rows"), *limits).write.parquet(f"{path}/manifest")


def files_for(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The manifest's rows of files that can hold values within all ranges (both ends included; None leaves an end open)."""
    out = spark.read.parquet(f"{path}/manifest")
    for d, (low, high) in ranges.items():
        if low is not None:
            out = out.where(F.col(f"most_{d}") >= F.lit(low))
        if high is not None:
            out = out.where(F.col(f"least_{d}") <= F.lit(high))
    return out


def read_where(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows within all ranges; Spark skips the other files when the join with the manifest runs (dynamic partition pruning)."""
    rows = spark.read.parquet(f"{path}/data").join(files_for(spark, path, ranges).select("shard", "file"), ["shard", "file"], "left_semi")
    for d, (low, high) in ranges.items():
        if low is not None:
            rows = rows.where(F.col(d) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(d) <= F.lit(high))
    return rows
