"""Helpers that the operators of this subpackage share: reading, the shared folder, global order, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that end a word.
WHITE = b" \t\n\r\x0b\x0c"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(context, "_tabularium_folder", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            context._tabularium_folder = folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df as a table written to the shared folder: it cuts the lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind staged(); only for tables that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_values(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def batches(rows: Iterable[pa.RecordBatch], limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes, a row at least."""
    for batch in rows:
        step = max(1, int(batch.num_rows * min(1, limit / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def code_point_offsets(data: bytes, positions: Iterable[int]) -> list[int]:
    """Byte offsets at character boundaries as code-point offsets."""
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [int(starts[p - 1]) if p else 0 for p in positions]


def numbered(df: DataFrame, order: Sequence[str], weight: Column | None = None) -> tuple[DataFrame, int, int]:
    """Rows with `rank` (from 0, in the order of the columns) and `bytes_before` (the sum of weights of rows before); how many, and the sum of weights.

    The rows are written to the shared folder, so that counts and numbers come from the same partitions.
    """
    spark = df.sparkSession
    rows = df.withColumns({"_weight": (F.lit(0) if weight is None else weight).cast("long"), "_place": F.monotonically_increasing_id()})
    sort = [F.col(c).asc_nulls_first() for c in (*order, "_place")]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "rank", "bytes_before"))])
    at = rows.columns.index("_weight")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            weights = batch.column(at).to_numpy()
            upto = total + np.cumsum(weights)
            new = [np.full(len(weights), part), np.arange(n, n + len(weights)), upto - weights]
            n, total = n + len(weights), int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in new)], schema.names)

    written = staged(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(run, schema), "sorted")
    parts = sorted(written.groupBy("_part").agg(F.count("*").alias("n"), F.sum("_weight").alias("w")).collect())  # a row per partition
    begins, n, total = [], 0, 0
    for r in parts:
        begins.append((r["_part"], n, total))
        n, total = n + r["n"], total + r["w"]
    known = F.broadcast(spark.createDataFrame(begins, "_part long, _n long, _w long"))
    out = written.join(known, "_part").withColumns({"rank": F.col("rank") + F.col("_n"), "bytes_before": F.col("bytes_before") + F.col("_w")}).drop("_part", "_n", "_w", "_weight", "_place")
    out._staged_path = written._staged_path
    return out, n, total


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) reaches, by alternating large and small stars."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    sign, held = None, None
    while True:
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        new = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        discard(held)
        if new == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign, held = new, now
