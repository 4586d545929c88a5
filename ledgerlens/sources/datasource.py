"""Conversation exports as a data source: ``spark.read.format("conversation_files").load(folder)``.

Files are planned into partitions by size; each is opened by the task that reads it. A row is one JSON value, transcript or
activity page, or a fault: what is malformed, unsafe or too large is reported with its reason and stops nothing else. The
adapters in ``exports`` take it from there; ``imported`` does so for all formats at once.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import exports

SCHEMA = "path string, member string, record int, kind string, value string, fault string"
ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("record", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("fault", pa.string())])
#: What a file is by the ending of its name, and archives, of which one may be inside another.
KINDS = {".json": "json", ".jsonl": "jsonl", ".html": "activity", ".htm": "activity", ".md": "transcript", ".txt": "transcript", ".zip": "zip"}
ARCHIVES = (".zip", ".tar", ".gz", ".rar", ".7z")
#: Bytes of files that a task reads, of text that a batch of rows holds, and of one value at most.
TASK_BYTES, BATCH_BYTES, MOST_BYTES = 64 << 20, 8 << 20, exports.MAX_EXPANDED


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def planned(sizes: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in the order of their names, as many to a partition as ``most`` bytes hold; a larger one has its own."""
    out: list[Files] = []
    held = most + 1
    for path, size in sorted(sizes):
        if held + size > most:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def archive_fault(infos: list[zipfile.ZipInfo], packed: int) -> str | None:
    """Why an archive is refused, by what its directory says; the limits are those of ``exports.archive_verdict``."""
    size = sum(i.file_size for i in infos)
    names = [PurePosixPath(i.filename.replace("\\", "/")) for i in infos]
    kinds = {(i.external_attr >> 16) >> 12 for i in infos}
    if packed > exports.MAX_COMPRESSED:
        return "too_large"
    if size > exports.MAX_EXPANDED:
        return "expands_too_far"
    if size > exports.MAX_RATIO * max(packed, 1):
        return "ratio"
    if len(infos) > exports.MAX_FILES:
        return "too_many_files"
    if any(n.is_absolute() or ".." in n.parts or (n.parts and n.parts[0].endswith(":")) for n in names):
        return "unsafe_path"
    if kinds - {0, 4, 8}:
        return "special_file"
    return "nested" if sum(str(n).lower().endswith(ARCHIVES) for n in names) > 1 else None


def parsed(kind: str, content: bytes) -> Iterator[tuple[int, str | None, str | None]]:
    """(record, value, fault) of a file's content."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        yield 0, None, "not_utf8"
        return
    if kind not in ("json", "jsonl"):
        yield 0, text, None
        return
    for i, value in enumerate(text.splitlines() if kind == "jsonl" else [text]):
        if kind == "jsonl" and not value.strip():
            continue
        try:
            json.loads(value)
        except (ValueError, RecursionError):
            yield i, None, "malformed"
        else:
            yield i, value, None


def rows_of(path: str, kind: str | None, stream: io.RawIOBase, size: int, member: str | None = None) -> Iterator[tuple]:
    """Rows of a file, or of all members of an archive that is safe."""
    if kind is None:
        yield path, member, 0, "other", None, "unknown_ending"
    elif kind == "zip" and member is None:
        try:
            with zipfile.ZipFile(stream) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                if reason := archive_fault(infos, size):
                    yield path, None, 0, "zip", None, reason
                    return
                for i in infos:
                    with z.open(i) as f:
                        yield from rows_of(path, KINDS.get(PurePosixPath(i.filename).suffix.lower()), f, i.file_size, i.filename)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, ValueError):
            yield path, None, 0, "zip", None, "malformed"
    elif kind == "zip":
        yield path, member, 0, "zip", None, "archive_inside"
    elif size > MOST_BYTES:
        yield path, member, 0, kind, None, "too_large"
    else:
        yield from ((path, member, i, kind, value, fault) for i, value, fault in parsed(kind, stream.read()))


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind")
        self.most = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        files, folder = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        found = files.get_file_info(folder)
        infos = [found] if found.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(folder, recursive=True))
        return planned([(i.path, i.size) for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        rows, held = [], 0
        for path in partition.paths if partition else ():
            with files.open_input_file(path) as stream:
                for row in rows_of(path, self.kind or KINDS.get(PurePosixPath(path).suffix.lower()), stream, stream.size()):
                    rows.append(row)
                    held += len(row[4] or "")
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(ARROW)], schema=ARROW)


class ConversationFiles(DataSource):
    """Options: path; kind (what every file is, whatever it is called); taskbytes (of files for one task)."""

    @classmethod
    def name(cls) -> str:
        return "conversation_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ConversationFiles)
    return spark.read.format("conversation_files").options(**options).load(path)


ADAPTERS = {"tree": exports.read_tree, "history": exports.read_history, "linear": exports.read_linear, "generic": exports.read_generic}


def imported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, faults) of files as read: the messages of all formats with their format, and a report of what could not be read.

    faults: path, member, record, fault. A JSON value whose shape no adapter knows is a fault too; transcripts and
    activity pages have no messages and are no faults.
    """
    values = files.where("kind in ('json', 'jsonl') and fault is null")
    # a line is one conversation or a list of them
    one = F.when(F.ltrim("value").startswith("{") & ~F.get_json_object("value", "$.format").isNotNull(), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    key = F.struct("path", "member", "record")
    payloads = values.select(F.to_json(key).alias("path"), one.alias("value"))
    shapes = payloads.join(exports.probe(payloads), "path")
    parts = [read(shapes.where(F.col("format") == name)).withColumn("format", F.lit(name)) for name, read in ADAPTERS.items()]
    messages = reduce(lambda a, b: a.unionByName(b), parts)
    odd = shapes.where(~F.col("format").isin(*ADAPTERS)).select(F.from_json("path", "path string, member string, record int").alias("k")).select("k.*", F.lit("unknown_format").alias("fault"))
    return messages, files.where("fault is not null").select("path", "member", "record", "fault").unionByName(odd)
