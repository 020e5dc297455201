"""Record logs as a data source of Spark: ``spark.read.format("record_lines")`` and ``spark.readStream`` over JSON lines that grow.

A line counts once it ends. What a crash left unended is not read; in a stream it is read once it has ended, also where the
same file has grown, which the built-in file source never sees. A whole line that is no record of the schema raises, with its
file and place. Files are cut into ranges of ``rangeBytes`` (16 MB), each a task; a range has the lines that begin in it.

Options: ``path`` (a file, or a folder with files named ``*.jsonl`` or ``*.json``), ``rangeBytes``. Defined results: blank lines
are left out; fields that a record doesn't have are null; fields that the schema doesn't have are left out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import opened

BLOCK = 1 << 20


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin in [start, stop); ``stop`` is at or before the end of its last whole line."""

    uri: str
    start: int
    stop: int
    first: bool  # whether a line begins at start for sure


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, size) of the files of a log, in the order of their names."""
    from pyarrow import fs

    system, root = opened(_uri(path))
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name.endswith((".jsonl", ".json")) and not f.base_name.startswith((".", "_"))]
    scheme = _uri(path).split("://")[0]
    host = _uri(path).split("://")[1].split("/")[0] if scheme != "file" else ""
    return sorted((f"{scheme}://{host}{f.path if f.path.startswith('/') else '/' + f.path}" if scheme == "file" or host and not f.path.startswith(host) else f"{scheme}://{f.path}", f.size) for f in found)


def _ended(uri: str, size: int, since: int = 0) -> int:
    """Where the last whole line of a file ends, read back from its end; ``since`` where none ended after that."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        at = size
        while at > since:
            start = max(since, at - BLOCK)
            file.seek(start)
            place = file.read(at - start).rfind(b"\n")
            if place >= 0:
                return start + place + 1
            at = start
    return since


def _ranges(uri: str, start: int, stop: int, size: int) -> list[LineRange]:
    return [LineRange(uri, s, min(s + size, stop), s == start) for s in range(start, stop, size)]


def _lines(part: LineRange):
    """(place, line) of the lines that begin in the range."""
    system, path = opened(part.uri)
    with system.open_input_file(path) as file:
        at = part.start if part.first else part.start - 1
        file.seek(at)
        held, here = b"", at
        skip = not part.first  # up to the first line that begins in the range
        while True:
            block = file.read(BLOCK)
            if not block:
                return
            held += block
            if skip:
                end = held.find(b"\n")
                if end < 0:
                    here, held = here + len(held), b""
                    if here >= part.stop:
                        return
                    continue
                here, held, skip = here + end + 1, held[end + 1 :], False
            *whole, held = held.split(b"\n")
            for line in whole:
                if here >= part.stop:
                    return
                yield here, line
                here += len(line) + 1
            if here >= part.stop:
                return


class _Reading:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("rangeBytes") or options.get("rangebytes") or 16 << 20)

    def read(self, partition: LineRange):
        shape = to_arrow_schema(self.schema)
        rows, size = [], 0
        for place, line in _lines(partition):
            if not line.strip():
                continue
            try:
                record = json.loads(line)
                if not isinstance(record, dict):
                    raise ValueError("no object")
                one = {f.name: record.get(f.name) for f in shape}
                pa.RecordBatch.from_pylist([one], schema=shape)
            except (ValueError, TypeError, pa.ArrowException) as e:
                raise ValueError(f"{partition.uri} at byte {place}: {e}") from e
            rows.append(one)
            size += len(line)
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


class _Batch(_Reading, DataSourceReader):
    def partitions(self):
        return [r for uri, size in _files(self.path) for r in _ranges(uri, 0, _ended(uri, size), self.size)] or [LineRange(_uri(self.path), 0, 0, True)]

    def read(self, partition: LineRange):
        return iter(()) if partition.stop == 0 else super().read(partition)


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are the ends of the last whole lines by file."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = {uri: _ended(uri, size, min(self.seen.get(uri, 0), size)) for uri, size in _files(self.path)}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict):
        return [r for uri, stop in sorted(end.items()) for r in _ranges(uri, start.get(uri, 0), stop, self.size)]

    def commit(self, end: dict) -> None:
        pass


class RecordLines(DataSource):
    """The source ``record_lines``; its schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        raise ValueError("state the schema of the records")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLines)
