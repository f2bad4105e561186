"""A deterministic sharded WARC writer, and a reader.

Pages are cut into shards of consecutive page ids of about equal size; a shard
is written in order of id, each record as a gzip member of its own, and rolls
to a new file when the compressed size reaches a limit. All headers and
digests are made anew from the payload and the id, so the same pages give the
same files byte for byte, however Spark deals out the work. Payloads that
equal that of a smaller id become revisit records without payload.

Files get a temporary name of their own in each attempt; the table of what
the successful attempts wrote (the manifest) is written by Spark's commit
protocol. Only then are these files renamed to their final names, the final
manifest is written, and what lost attempts left is deleted. A reader takes
the manifest alone as the truth.

The archive's folder may be in any file system that pyarrow can open on the
executors (shared disk, object store).

Defined results: null texts have an empty payload; null urls are written as
"urn:none"; null page ids come after all others, in shards by payload, and, as
a revisit, refer to the smallest id that is not null; repeated rows have a
record each, and one with the payload and id of the first revisits it; equal
payloads of one id go by url; empty tables give an archive
without files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from io import BufferedReader

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm.common import byte_values, discard, numbered, remove, staged

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Payload bytes of a shard, and compressed bytes at which a file is closed.
SHARD_BYTES, FILE_BYTES = 64 << 20, 16 << 20
#: A reader's tasks: as many as files up to so many, then one for so many bytes.
FEW_FILES, READ_BYTES = 1024, 64 << 20
#: Records carry no time of their own; the date is a parameter, for the bytes must not depend on the clock.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("7d5f1b1c-6d0e-5c3a-9a55-0b3c1b6a7f10")


def record_id(page: int | None, digest: str, again: int) -> str:
    """again: how many rows before have the same page and payload."""
    return f"<{uuid.uuid5(NAMESPACE, f'{page}/{digest}/{again}').urn}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def target(url: str | None) -> str:
    """The url as one header line: what is no printable ASCII is percent-coded."""
    return "".join(ch if "!" <= ch <= "~" else "".join(f"%{b:02X}" for b in ch.encode("utf-8", "replace")) for ch in url or "urn:none")


def record(page: int | None, again: int, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the page that it refers to, whose payload is the same."""
    digest, head = hashlib.sha256(payload).hexdigest(), http_head(len(payload))
    block = head if revisit else head + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, digest, again)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-X-Page-Id", "" if page is None else str(page)),
    ]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, 0)), ("WARC-X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Smallest ids of all shards but the first, from exact sums over all rows (page_id, size); null ids are left out.

    A shard begins with the first id before which a further multiple of shard_bytes has been filled. Ids are summed and sorted in ranges, and the
    sums of the ranges added up, so it takes the same few jobs at any size; what comes back is a number per shard.
    """
    own = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("size").alias("size"))
    placed, _, total = numbered(own, ["page_id"], F.col("size"))
    if total <= shard_bytes:
        discard(placed)
        return []
    firsts = placed.groupBy(F.expr(f"bytes_before div {shard_bytes}").alias("k")).agg(F.min("page_id").alias("first"))
    bounds = sorted(r["first"] for r in firsts.where("k > 0").collect())  # a row per shard
    discard(placed)
    return bounds


_FILES = "shard long, roll long, temporary string, records long, bytes long, sha256 string, first_id long, last_id long"


class _Shard:
    """Writes the files of one shard, in order."""

    def __init__(self, where: fs.FileSystem, folder: str, shard: int, file_bytes: int):
        self.where, self.folder, self.shard, self.file_bytes, self.roll, self.file = where, folder, shard, file_bytes, 0, None

    def add(self, page: int | None, data: bytes) -> list | None:
        """The row of the file that this closed, if any."""
        if self.file is None:
            self.name = f"_temporary/{uuid.uuid4().hex}.warc.gz"
            self.file = self.where.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.size, self.records, self.first, self.sum = 0, 0, page, hashlib.sha256()
        self.file.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1
        self.last = page
        return self.close() if self.size >= self.file_bytes else None

    def close(self) -> list | None:
        if self.file is None:
            return None
        self.file.close()
        self.file, row = None, [self.shard, self.roll, self.name, self.records, self.size, self.sum.hexdigest(), self.first, self.last]
        self.roll += 1
        return row


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write the archive into a new folder; returns its manifest, a row per file."""
    spark = pages.sparkSession
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    sized = staged(own.select("page_id", F.octet_length("html").cast("long").alias("size")), "sizes")
    bounds = shard_bounds(sized, shard_bytes)
    nameless = max(1, -(-(sized.where("page_id is null").agg(F.sum("size")).first()[0] or 0) // shard_bytes))  # shards of rows without id
    # the least id of each payload, then of the rows that have another: few and narrow, the payloads stay where they are
    digests = own.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.unhex(F.sha2(F.encode("html", "utf-8"), 256)).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = digests.join(least, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()
    # a note on a page travels with the page itself, and comes before it
    void = lambda kind: F.lit(None).cast(kind)
    rows = own.select("page_id", "url", "html", F.lit(1).alias("kind"), void("binary").alias("digest"), void("long").alias("refers_to")).unionByName(again.select("page_id", void("string").alias("url"), void("string").alias("html"), F.lit(0).alias("kind"), "digest", "refers_to"))
    payload = F.coalesce("digest", F.unhex(F.sha2(F.encode("html", "utf-8"), 256)))  # for rows without id alone: they meet by payload
    numbered = _numbered(rows, bounds).withColumn("shard", F.when(F.col("page_id").isNull(), F.col("shard") + F.pmod(F.xxhash64(payload), F.lit(nameless)).cast("int")).otherwise(F.col("shard")))
    dealt = numbered.repartitionById(len(bounds) + nameless, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "url", "html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(f"{path}/_temporary", recursive=True)
        out: list[list] = []
        writer, page, refers, seen = None, object(), {}, {}
        for batch in batches:
            columns = (batch.column(0), batch.column(1), batch.column(3), batch.column(4), batch.column(5), batch.column(6))
            for i, link, kind, digest, target_id, shard, data in zip(*(c.to_pylist() for c in columns), byte_values(batch.column(2)), strict=True):
                if writer is None or writer.shard != shard:
                    out += [writer.close()] if writer else []
                    writer, page = _Shard(where, path, shard, file_bytes), object()
                if i != page:
                    page, refers, seen = i, {}, {}
                if kind == 0:
                    refers[digest] = target_id
                    continue
                data = data or b""
                digest = hashlib.sha256(data).digest()
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                revisit = len(data) >= LEAST_REVISIT and (digest in refers or again > 0)
                out.append(writer.add(i, member(record(i, again, link, data, revisit, refers.get(digest, i) if revisit else None, date))))
        out += [writer.close()] if writer else []
        found = [x for x in out if x]
        names = [x.split()[0] for x in _FILES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kinds[k]) for k in range(len(kinds))], names)

    dealt.mapInArrow(run, _FILES).write.parquet(f"{folder}/_written")
    return _commit(spark, folder)


def _numbered(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """rows with the number of their shard, by binary search; rows without id have the number after the last bound."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    def run(ids: pa.Array) -> pa.Array:
        out = np.searchsorted(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(sent.value), out).astype(np.int32))

    return rows.withColumn("shard", F.arrow_udf(run, "int")("page_id") if bounds else F.lit(0))


def _commit(spark: SparkSession, folder: str) -> DataFrame:
    """Give the files of the manifest their final names; a second call after a failure goes on where the first ended."""
    written = spark.read.schema(_FILES).parquet(f"{folder}/_written")
    named = written.select(F.format_string("part-%06d-%04d.warc.gz", "shard", "roll").alias("file"), *(x.split()[0] for x in _FILES.split(", ")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for final, temporary in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if where.get_file_info(f"{path}/{temporary}").type == fs.FileType.File:
                    where.move(f"{path}/{temporary}", f"{path}/{final}")
            yield batch

    named.mapInArrow(run, named.schema).drop("temporary").write.parquet(f"{folder}/manifest")
    remove(spark, f"{folder}/_temporary")
    remove(spark, f"{folder}/_written")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def _members(stream: BufferedReader, step: int = 1 << 20) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one after the other."""
    data, parts, unpack = b"", [], None
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                break
        if unpack is None:
            unpack, parts = zlib.decompressobj(31), []
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            data, unpack = unpack.unused_data, None
            yield b"".join(parts)
    if unpack is not None:
        raise ValueError("the archive ends within a record")


_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's digest must be right."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.decode(): v.decode() for k, v in _HEADER.findall(head.partition(b"\r\n")[2] + b"\r\n")}
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return headers, block


_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archive's files. Responses carry their payload if asked for; its digest is checked in any case."""
    files = manifest(spark, folder)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # a task for each file while there are few, then one for READ_BYTES; a number that is given is kept as it is
    found = files.select("file", "sha256").repartition(max(1, min(n, max(FEW_FILES, -(-size // READ_BYTES)))), F.col("file"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(len(kinds))], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with where.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        headers, block = parse(data)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", head)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                        page, to = headers["WARC-X-Page-Id"], headers.get("WARC-X-Refers-To-Page-Id")
                        rows.append((int(page) if page else None, headers["WARC-Target-URI"], kind, length, digest, int(to) if to else None, payload if payloads and kind == "response" else None))
                        size += len(payload) * payloads + 200
                        if size > 1 << 22:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return found.mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archive and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to for each record."""
    write(pages, folder, page_id, url, html)
    return read_archive(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
