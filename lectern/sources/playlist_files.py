"""Playlist files as a batch source: a folder tree of ``.m3u8`` files becomes rows of lines, whole files a task.

Filters on ``playlist_id`` (equal, in, prefix) are taken over by the source: files that cannot match become no partition
and are not opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from .spool import folder_of

SUFFIX = ".m3u8"
LINES = "playlist_id string, base_url string, pos int, line string"
#: Bytes of files that one task reads, and files at most.
TASK_BYTES, TASK_FILES = 32 << 20, 1000


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class PlaylistReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.base = schema.names, options["path"], options.get("baseurl", "").rstrip("/")
        self.task_bytes, self.tests = int(options.get("taskbytes", TASK_BYTES)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if getattr(f, "attribute", None) == ("playlist_id",) and isinstance(f, EqualTo | In | StringStartsWith):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, id: str) -> bool:
        return all(id == f.value if isinstance(f, EqualTo) else id in f.value if isinstance(f, In) else id.startswith(f.value) for f in self.tests)

    def partitions(self) -> list[InputPartition]:
        system, path = folder_of(self.path)
        root = path.rstrip("/") + "/"
        found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.is_file and f.path.lower().endswith(SUFFIX) and not f.base_name.startswith(".")]
        tasks: list[list[str]] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            name = f.path.removeprefix(root)
            if self._wanted(name[: -len(SUFFIX)]):
                if not tasks or room < f.size or len(tasks[-1]) >= TASK_FILES:
                    tasks.append([])
                    room = self.task_bytes
                tasks[-1].append(name)
                room -= f.size
        return [Files(t) for t in tasks] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, path = folder_of(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{path.rstrip('/')}/{name}") as f:
                text = f.read().decode("utf-8", "replace")
            for pos, line in enumerate(text.split("\n")):
                line = line.replace("\r", "").strip(" ")
                if line:
                    row = {"playlist_id": name[: -len(SUFFIX)], "base_url": f"{self.base}/{name}", "pos": pos, "line": line}
                    yield tuple(row[c] for c in self.names)


class PlaylistFiles(DataSource):
    """``spark.read.format("playlists").option("path", folder).option("baseUrl", "https://host")``."""

    @classmethod
    def name(cls) -> str:
        return "playlists"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlaylistReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_playlists(spark: SparkSession, path: str, base_url: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(playlist_id, base_url, pos, line) of the lines that are not blank, of every playlist below ``path``.

    ``playlist_id`` is the file's path below the folder without its suffix, ``base_url`` the playlist's own url, against
    which its links are resolved.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlaylistFiles)
    return spark.read.format("playlists").option("path", path).option("baseUrl", base_url).option("taskBytes", str(task_bytes)).load()


def links(lines: DataFrame) -> DataFrame:
    """(url, target): which playlist lies behind each url, for ``playlist.resolved``."""
    return lines.select(F.col("base_url").alias("url"), F.col("playlist_id").alias("target")).distinct()


def write_playlists(texts: DataFrame, path: str, key: str = "playlist_id", text: str = "text") -> None:
    """One ``<key>.m3u8`` file a row below ``path``, written by the tasks; a file is there as a whole or not at all."""
    system, root = folder_of(path)
    root = root.rstrip("/")
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(root)

    def write(rows: Iterator) -> None:
        system, _ = folder_of(path)
        for r in rows:
            name = f"{root}/{r[key]}{SUFFIX}"
            folder, _, base = name.rpartition("/")
            system.create_dir(folder)
            draft = f"{folder}/.{base}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as f:
                f.write((r[text] or "").encode())
            system.move(draft, name)

    texts.select(key, text).foreachPartition(write)
