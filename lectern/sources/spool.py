"""Live queues as a streaming source: a spool folder of JSON lines, drained at most so many rows a micro-batch.

Writers put whole files into the folder, named in the order in which they are to be read (write beside it, then rename).
An offset is a file, a number of its lines and the byte behind them; the lines before it are done with. A batch never
holds more than ``maxRows`` rows, so a backlog, however long, is worked off in bounded steps; files are read by tasks, not
by the driver, which only looks for the line ends of the next batch. Each step starts at its byte, so the cost of a batch
does not depend on where in a file it lies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows a drain takes, as the reference's window does.
MOST_ROWS = 20
#: Bytes of a file, and rows of a table, that are held at a time.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 10_000
#: Lines that a task reads.
TASK_ROWS = 12_500
PROGRESS = "job_id string, ts timestamp, done int, total int, status int"


def folder_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme or host is local."""
    local = path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)


class Lines(InputPartition):
    """The lines between two bytes of a file."""

    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class SpoolReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("maxrows", MOST_ROWS))
        if self.most < 1:
            raise ValueError("maxRows must be at least 1")
        self.given: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"file": "", "line": 0, "byte": 0}

    def _files(self, since: str) -> list[tuple[str, int]]:
        """Names and sizes of the files, in order."""
        system, path = folder_of(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f.base_name >= since)

    def _chunks(self, name: str, first: int = 0) -> Iterator[bytes]:
        system, path = folder_of(self.path)
        with system.open_input_file(f"{path}/{name}") as f:
            f.seek(first)
            while chunk := f.read(CHUNK_BYTES):
                yield chunk

    def _after(self, name: str, first: int, most: int) -> tuple[int, int]:
        """The next lines from a byte on, at most ``most``: their number and the byte behind them."""
        lines, at, chunk = 0, first, b"\n"
        if not most:
            return 0, first
        for chunk in self._chunks(name, first):
            n = chunk.count(b"\n")
            if lines + n >= most:
                return most, at + int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)[most - lines - 1]) + 1
            lines, at = lines + n, at + len(chunk)
        return lines + (not chunk.endswith(b"\n")), at

    def _byte(self, offset: dict) -> int:
        """Where an offset lies; those of older checkpoints tell lines alone."""
        return offset["byte"] if "byte" in offset else self._after(offset["file"], 0, offset["line"])[1]

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        # After a restart Spark first plans the last batch again (partitions below), so ``given`` is known by now.
        at, left = self.given or self.initialOffset(), self.most
        self.given = at
        for name, size in self._files(at["file"]):
            line, first = (at["line"], self._byte(at)) if name == at["file"] else (0, 0)
            if first >= size:
                continue
            n, last = self._after(name, first, left)
            self.given, left = {"file": name, "line": line + n, "byte": last}, left - n
            if not left:
                break
        return self.given

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.given is None or (self.given["file"], self.given["line"]) < (end["file"], end["line"]):
            self.given = end
        out = []
        for name, size in self._files(start["file"]):
            if name > end["file"]:
                break
            first = self._byte(start) if name == start["file"] else 0
            last = self._byte(end) if name == end["file"] else size
            while first < last:
                till = last if self.most <= TASK_ROWS else min(last, self._after(name, first, TASK_ROWS)[1])
                out.append(Lines(name, first, till))
                first = till
        return out

    def _lines(self, partition: Lines) -> Iterator[bytes]:
        left, rest = partition.last - partition.first, b""
        for chunk in self._chunks(partition.file, partition.first):
            *whole, rest = (rest + chunk[:left]).split(b"\n")
            left -= len(chunk)
            yield from whole
            if left <= 0:
                break
        if rest:
            yield rest

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        """Rows of the lines; one that is no JSON object gives nulls, as a row must come of every line."""
        fields = [(f.name, *_kind(f.dataType.simpleString())) for f in self.schema]
        values: list[dict] = []

        def batch() -> pa.RecordBatch:
            columns = [_column([v.get(name) for v in values], kind, to) for name, kind, to in fields]
            return pa.RecordBatch.from_arrays(columns, [name for name, *_ in fields])

        for line in self._lines(partition):
            try:
                value = json.loads(line)
            except ValueError:
                value = None
            values.append(value if isinstance(value, dict) else {})
            if len(values) == CHUNK_ROWS:
                yield batch()
                values = []
        if values:
            yield batch()


def _whole(bits: int) -> Callable:
    def to(value) -> int | None:
        number = int(value)
        return number if -(1 << bits - 1) <= number < 1 << bits - 1 else None

    return to


def _kind(kind: str) -> tuple[pa.DataType, Callable]:
    """Arrow type of a column's type and what makes its values."""
    if kind == "timestamp":
        return pa.timestamp("us", "UTC"), lambda value: datetime.fromisoformat(str(value)).astimezone(timezone.utc)
    if kind.startswith("timestamp"):
        return pa.timestamp("us"), lambda value: datetime.fromisoformat(str(value))
    known = {"int": (pa.int32(), _whole(32)), "bigint": (pa.int64(), _whole(64)), "double": (pa.float64(), float), "boolean": (pa.bool_(), bool)}
    return known.get(kind, (pa.string(), str))


def _column(values: list, kind: pa.DataType, to: Callable) -> pa.Array:
    have = set(map(type, values)) - {type(None)}
    if not have:
        return pa.nulls(len(values), kind)
    if have <= {str} and kind == pa.string():
        return pa.array(values, kind)
    return pa.array([_typed(v, to) for v in values], kind)


def _typed(value, to: Callable):
    """A JSON value as a column's; null where it doesn't fit."""
    if value is None:
        return None
    try:
        return to(value)
    except (ValueError, TypeError, OverflowError):
        return None


class Spool(DataSource):
    """``spark.readStream.format("spool").option("path", folder).option("maxRows", 20)``."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return PROGRESS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return SpoolReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_spool(spark: SparkSession, path: str, most: int = MOST_ROWS, schema: str = PROGRESS):
    """A stream of the spool at ``path``, at most ``most`` rows a micro-batch."""
    spark.dataSource.register(Spool)
    return spark.readStream.format("spool").schema(schema).option("path", path).option("maxRows", str(most)).load()
