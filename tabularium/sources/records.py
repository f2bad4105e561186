"""Records as lines of JSON: a data source that writes them with their evidence files in two phases, and reads them, damaged lines included.

Writing: a task writes a folder of its own, parts/<name>, with records.jsonl and
the evidence files of its records (data/), and reports it. The driver then
writes the manifest, the list of parts, under a temporary name and renames it.
Only what the manifest lists counts, so a lost task leaves neither half a file
nor a doubled record, and an append or overwrite is seen as a whole or not at all.

Reading: files are cut into ranges of bytes, a line belonging to the range that it
begins in. A task reads the ranges of a section of a file one after the other. A line that can't be a record of the schema is a row
with its reason, if the schema has columns for that, and is left out otherwise. Filters that Spark pushes
down are applied to a record before it becomes a row, where that is asked for.

Paths are those that Arrow's file systems know (a local or mounted folder, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import operator
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Bytes of a range, by default, and of the ranges that a task reads where they are smaller.
RANGE, SECTION = 1 << 26, 1 << 23
#: What a schema may ask for besides fields: where a line begins, why it is none of the good ones (else null), and its bytes as text.
FILE, OFFSET, REASON, LINE = "_file", "_offset", "_reason", "_line"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _said(system: fs.FileSystem, name: str) -> dict | None:
    if system.get_file_info(name).type != fs.FileType.File:
        return None
    with system.open_input_stream(name) as f:
        return json.loads(f.readall())


def _put(system: fs.FileSystem, name: str, data: bytes) -> None:
    """The whole file or none, also where another one is replaced."""
    folder, _, last = name.rpartition("/")
    draft = f"{folder}/.{last}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, name)


@dataclass
class Part(WriterCommitMessage):
    name: str
    n: int
    first: object
    last: object
    digest: str


@dataclass
class Range(InputPartition):
    """A section of a file, in ranges of step bytes."""

    file: str
    start: int
    end: int
    step: int


class RecordWriter(DataSourceWriter):
    """Options: id (the field that parts are listed by), files (an array column of variable, name, content), zip (true: each part also as an archive)."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.id, self.files, self.zip, self.overwrite = options["path"].rstrip("/"), options.get("id"), options.get("files"), options.get("zip", "false") == "true", overwrite

    def write(self, rows: Iterator) -> Part:
        system, path = _opened(self.path)
        name = uuid.uuid4().hex
        folder = f"{path}/parts/{name}"
        system.create_dir(f"{folder}/data", recursive=True)
        n, ids, digest, evidence, draft = 0, [], hashlib.sha256(), {}, f"{folder}/.records.jsonl"
        with system.open_output_stream(draft) as out:
            for row in rows:
                record = row.asDict(recursive=True)
                for x in (record.pop(self.files) or ()) if self.files else ():
                    held = hashlib.sha256(x["content"].encode()).hexdigest()
                    if evidence.setdefault(x["name"], held) != held:
                        raise ValueError(f"two files named {x['name']} differ")
                    if (target := f"{folder}/data/{x['name']}") and system.get_file_info(target).type == fs.FileType.NotFound:
                        _put(system, target, x["content"].encode())
                    record.setdefault("evidence", []).append({"variable": x["variable"], "csv_path": f"data/{x['name']}"})
                line = json.dumps(record, ensure_ascii=False, default=str).encode() + b"\n"
                digest.update(line)
                out.write(line)
                n += 1
                if self.id and record[self.id] is not None:
                    ids = [min(ids[0], record[self.id]), max(ids[1], record[self.id])] if ids else [record[self.id]] * 2
        system.move(draft, f"{folder}/records.jsonl")
        if self.zip:
            self._zipped(system, folder, sorted(evidence))
        return Part(name, n, *(ids or [None, None]), digest.hexdigest())

    def _zipped(self, system: fs.FileSystem, folder: str, names: list[str]) -> None:
        """The part's records as one JSON array and its files by name; equal parts give equal bytes."""
        with system.open_output_stream(f"{folder}/.bundle.zip") as out, zipfile.ZipFile(io.BufferedWriter(out), "w", zipfile.ZIP_DEFLATED) as bundle:
            for name, inside in (("records.jsonl", "submission.json"), *((f"data/{x}", f"data/{x}") for x in names)):
                with system.open_input_stream(f"{folder}/{name}") as f:
                    data = f.readall()
                if name == "records.jsonl":
                    data = b"[" + b",\n".join(data.splitlines()) + b"]\n"
                bundle.writestr(zipfile.ZipInfo(inside, (1980, 1, 1, 0, 0, 0)), data)
        system.move(f"{folder}/.bundle.zip", f"{folder}/bundle.zip")

    def commit(self, messages: list[Part | None]) -> None:
        system, path = _opened(self.path)
        before = (_said(system, f"{path}/{MANIFEST}") or {"parts": []})["parts"]
        new = [vars(m) for m in messages if m is not None]
        empty = [p["name"] for p in new if not p["n"]]
        new = sorted((p for p in new if p["n"]), key=lambda p: (p["first"] is None, p["first"], p["name"]))
        kept = new if self.overwrite else before + new
        _put(system, f"{path}/{MANIFEST}", json.dumps({"parts": kept}).encode())
        for name in empty + [p["name"] for p in before if self.overwrite]:
            system.delete_dir(f"{path}/parts/{name}")

    def abort(self, messages: list[Part | None]) -> None:
        system, path = _opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{path}/parts/{m.name}").type == fs.FileType.Directory:
                system.delete_dir(f"{path}/parts/{m.name}")


class Wrong(ValueError):
    """A field that is not of its type."""


def _as(value: object, kind: T.DataType, at: str) -> object:
    """A value of JSON as Spark takes it for the type."""
    if value is None:
        return None
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(_as(value.get(f.name), f.dataType, f"{at}.{f.name}") for f in kind)
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [_as(x, kind.elementType, f"{at}[]") for x in value]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {k: _as(x, kind.valueType, f"{at}.{k}") for k, x in value.items()}
    if isinstance(kind, T.StringType) and isinstance(value, str) or isinstance(kind, T.BooleanType) and isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(kind))
        if bits and isinstance(value, int) and -(1 << bits) <= value < 1 << bits:
            return value
    raise Wrong(at)


_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_BY_NAME = {kind.__name__: compare for kind, compare in _COMPARED.items()}


class LineReader(DataSourceReader):
    """Options: required (fields that no record lacks, by commas), rangebytes, push (true: take the filters that Spark offers).

    Spark keeps one reader for all uses of a DataFrame, so a plan in which one that takes filters stands twice, with
    different filters, would mix them up: take filters only where a DataFrame is used once.
    """

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.held = schema, options["path"].rstrip("/"), []
        self.required = [x.strip() for x in options.get("required", "").split(",") if x.strip()]
        self.range_bytes, self.push = int(options.get("rangebytes", RANGE)), options.get("push", "false") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        simple = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        for f in filters:
            if self.push and type(f) in (*_COMPARED, In, IsNull, IsNotNull) and len(f.attribute) == 1 and isinstance(self.schema[f.attribute[0]].dataType, simple):
                self.held.append((f.attribute[0], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _fits(self, record: dict) -> bool:
        for name, kind, value in self.held:
            own = record.get(name)
            if kind in ("IsNull", "IsNotNull"):
                if (own is None) != (kind == "IsNull"):
                    return False
            elif own is None or not (own in value if kind == "In" else _BY_NAME[kind](own, value)):
                return False
        return True

    def partitions(self) -> list[Range]:
        system, path = _opened(self.path)
        said = _said(system, f"{path}/{MANIFEST}")
        if said is not None:
            files = [system.get_file_info(f"{path}/parts/{p['name']}/records.jsonl") for p in said["parts"]]
        elif (info := system.get_file_info(path)).type == fs.FileType.File:
            files = [info]
        else:
            files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        section = self.range_bytes * max(1, SECTION // self.range_bytes)
        return [Range(f.path, a, min(f.size, a + section), self.range_bytes) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, section)] or [Range("", 0, 0, 1)]

    def _row(self, record: dict) -> tuple:
        return tuple(record.get(f.name) for f in self.schema)

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as raw:
            # one buffer for all ranges, so that small ranges don't read the same bytes again and again
            lines = io.BufferedReader(raw, 1 << 20)
            for start in range(partition.start, partition.end, partition.step):
                yield from self._read_range(lines, partition.file, start, min(partition.end, start + partition.step))

    def _read_range(self, lines: io.BufferedReader, file: str, start: int, end: int) -> Iterator[tuple]:
        extra, fields = {FILE, OFFSET, REASON, LINE}, [f for f in self.schema if f.name not in (FILE, OFFSET, REASON, LINE)]
        rejects = REASON in self.schema.names
        at = max(0, start - 1)
        lines.seek(at)
        if start:
            at += len(lines.readline())  # the rest of a line that began before, or its end
        while at < end and (line := lines.readline()):
            where, at, body, reason = at, at + len(line), line.rstrip(b"\r\n"), None
            if not body.strip():
                continue
            record: dict = {}
            try:
                parsed = json.loads(body.decode(), parse_constant=lambda x: math.nan)
                if not isinstance(parsed, dict):
                    reason = "not an object"
                elif lacking := [x for x in self.required if parsed.get(x) is None]:
                    reason = f"missing {lacking[0]}"
                else:
                    record = {f.name: _as(parsed.get(f.name), f.dataType, f.name) for f in fields}
            except UnicodeDecodeError:
                reason = "not UTF-8"
            except Wrong as x:
                reason = f"type of {x}"
            except (ValueError, RecursionError):
                reason = "not JSON"
            if reason and not rejects:
                continue
            if extra:
                record |= {FILE: file, OFFSET: where, REASON: reason, LINE: body.decode(errors="replace") if reason else None}
            if self._fits(record):
                yield self._row(record)


class RecordLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        raise ValueError("state the schema of the records")

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Spark push filters down to it."""
    spark.dataSource.register(RecordLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(df: DataFrame, path: str, by: str, mode: str = "overwrite", **options: str) -> None:
    """Records in order of a field, in as many parts as Spark shuffles to."""
    register(df.sparkSession)
    df.repartitionByRange(by).sortWithinPartitions(by).write.format("record_lines").mode(mode).options(path=path, id=by, **options).save()


def read(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("record_lines").schema(schema).options(path=path, **options).load()


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """(part, csv_path, content) of the files that the manifest's parts hold."""
    system, where = _opened(path)
    parts = [p["name"] for p in (_said(system, f"{where}/{MANIFEST}") or {"parts": []})["parts"]]
    if not parts:
        return spark.createDataFrame([], "part string, csv_path string, content string")
    files = spark.read.text([f"{path}/parts/{x}/data" for x in parts], wholetext=True)
    name = F.input_file_name()
    return files.select(F.regexp_extract(name, "/parts/([^/]+)/", 1).alias("part"), F.regexp_extract(name, "/(data/[^/]+)$", 1).alias("csv_path"), F.col("value").alias("content"))
