"""Sinks: text bodies, JSON records and atomic replacement, through Spark's writers."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import history_state, merge_history

#: Folders of a replaced table: the rows of each version, and one empty file a commit.
DATA, COMMITS = "data", "commits"


def write_bodies(df: DataFrame, path: str, body: str = "body") -> None:
    """One text record a body."""
    df.select(F.col(body).alias("value")).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path`` and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


@dataclass(frozen=True, order=True)
class Version:
    """A committed version of a table: its number, the writer's epoch (-1: none), its folder and time of commit."""

    number: int
    epoch: int
    folder: str
    millis: int = 0

    @property
    def name(self) -> str:
        return f"{self.number:012d}.{self.epoch}.{self.folder}"


def versions(spark: SparkSession, path: str) -> list[Version]:
    """Committed versions of a table, oldest first; none if there is no table."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path, COMMITS)):
        return []
    found = [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(at(path, COMMITS))]
    parts = [(*name.split("."), when) for name, when in found if not name.startswith((".", "_"))]
    return sorted(Version(int(number), int(epoch), folder, when) for number, epoch, folder, when in parts)


def replace_table(df: DataFrame, path: str, *, epoch: int | None = None, form: str = "parquet", keep: int = 2, retain_seconds: int = 3600) -> bool:
    """Replace the table at ``path`` by ``df``; readers see the old version or the new one, never less. False if done before.

    Rows go to a folder of their own below ``data``. The commit is one rename of an empty file, whose name tells the
    version, to a name that never existed; a writer that dies before leaves the old version. An ``epoch`` (of a
    streaming batch) that is not above the newest committed one is not written again. Versions that are neither among
    the newest ``keep`` nor younger than ``retain_seconds`` go, with folders that were never committed.
    """
    spark = df.sparkSession
    fs, at = _files(spark, path)
    before = versions(spark, path)
    if epoch is not None and before and max(v.epoch for v in before) >= epoch:
        return False
    fresh = Version(before[-1].number + 1 if before else 1, -1 if epoch is None else epoch, uuid.uuid4().hex)
    df.write.format(form).save(f"{path}/{DATA}/{fresh.folder}")
    fs.mkdirs(at(path, COMMITS))
    draft = at(path, COMMITS, f".{fresh.folder}")
    fs.create(draft).close()
    if not fs.rename(draft, at(path, COMMITS, fresh.name)):
        raise OSError(f"commit of {fresh.name} failed")
    _prune(spark, path, keep, retain_seconds)
    return True


def _prune(spark: SparkSession, path: str, keep: int, retain_seconds: int) -> None:
    fs, at = _files(spark, path)
    known, limit = versions(spark, path), int(time.time() * 1000) - 1000 * retain_seconds
    for v in known[: -max(1, keep)]:
        if v.millis < limit:
            fs.delete(at(path, COMMITS, v.name), False)
            fs.delete(at(path, DATA, v.folder), True)
    folders = {v.folder for v in known}
    for f in fs.listStatus(at(path, DATA)):
        if f.getPath().getName() not in folders and f.getModificationTime() < limit:
            fs.delete(f.getPath(), True)


def read_table(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The newest committed version of a table that :func:`replace_table` writes."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.format(form).load(f"{path}/{DATA}/{found[-1].folder}")


def upsert_history(events: DataFrame, path: str, key: str, at: str, *, epoch: int | None = None, **last: str) -> DataFrame:
    """Take look-ups into the stored state at ``path``, without reading older look-ups again, and return the new state."""
    spark = events.sparkSession
    delta = history_state(events, key, at, **last)
    state = merge_history(read_table(spark, path), delta, key) if versions(spark, path) else delta
    replace_table(state, path, epoch=epoch)
    return read_table(spark, path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table (reports hold one row a configuration); rows beyond ``most`` are replaced by a line that says so."""
    found = df.limit(most + 1).collect()
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in found[:most]]]
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([*lines, f"(more than {most} rows)"] if len(found) > most else lines)
