"""Tables replaced by one rename, and the history that is merged into a stored state."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lectern.operators import jobs
from lectern.sources import sinks


def numbers(spark, n, version):
    return spark.range(n).withColumn("version", F.lit(version))


def test_a_reader_never_sees_less_than_a_version(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(numbers(spark, 20, 0), path)
    done, seen, failed = threading.Event(), [], []

    def read():
        session = spark.newSession()
        while not done.is_set():
            try:
                rows = sinks.read_table(session, path).collect()
                seen.append((len(rows), {r["version"] for r in rows}))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 51):
        assert sinks.replace_table(numbers(spark, 20, i).coalesce(2), path)
    done.set()
    reader.join()
    assert not failed and seen and all(n == 20 and len(v) == 1 for n, v in seen)
    order = [next(iter(v)) for _, v in seen]
    assert order == sorted(order) and sinks.read_table(spark, path).first()["version"] == 50


def test_a_dead_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    sinks.replace_table(numbers(spark, 3, 1), path)
    # Rows written, draft of the commit made, no rename: what a writer killed there leaves.
    numbers(spark, 3, 2).write.parquet(f"{path}/data/feed")
    open(f"{path}/commits/.feed", "w").close()
    assert {r["version"] for r in sinks.read_table(spark, path).collect()} == {1}
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path)
    assert {r["version"] for r in sinks.read_table(spark, path).collect()} == {1}
    sinks.replace_table(numbers(spark, 3, 3), path)
    assert {r["version"] for r in sinks.read_table(spark, path).collect()} == {3} and len(sinks.versions(spark, path)) == 2


def test_old_versions_and_leftovers_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        sinks.replace_table(numbers(spark, 1, i), path, keep=2, retain_seconds=-10)
    assert [v.number for v in sinks.versions(spark, path)] == [3, 4] and len([d for d in os.listdir(f"{path}/data") if not d.startswith(".")]) == 2
    numbers(spark, 1, 9).write.parquet(f"{path}/data/orphan")
    sinks.replace_table(numbers(spark, 1, 5), path, keep=1, retain_seconds=-10)
    assert not os.path.exists(f"{path}/data/orphan") and sinks.read_table(spark, path).first()["version"] == 5


def test_an_epoch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.replace_table(numbers(spark, 2, 7), path, epoch=7) and not sinks.replace_table(numbers(spark, 2, 8), path, epoch=7)
    assert not sinks.replace_table(numbers(spark, 2, 6), path, epoch=6) and sinks.replace_table(numbers(spark, 2, 8), path, epoch=8)
    assert sinks.read_table(spark, path).first()["version"] == 8


LOOKUPS = "key string, at int, name string, who string"


def test_merged_halves_equal_the_whole(spark, tmp_path):
    rows = [(f"c{i % 70}", i * 7919 % 1000, f"n{i}" if i % 3 else "", f"w{i}" if i % 5 == 0 else None) for i in range(900)] + [(None, 1, "x", "y"), (" ", 2, "x", "y")]
    df = spark.createDataFrame(rows, LOOKUPS)
    fields = {"course_name": "name", "professor": "who"}
    whole = jobs.history(df, "key", "at", **fields).collect()
    path = str(tmp_path / "h")
    for part in range(3):
        state = sinks.upsert_history(df.where(F.col("at") % 3 == part), path, "key", "at", epoch=part, **fields)
    assert jobs.newest_history(state, "key").collect() == whole and len(whole) == 50
    again = sinks.upsert_history(df.where("at % 3 = 2"), path, "key", "at", epoch=2, **fields)  # a batch that is run again counts once
    assert jobs.newest_history(again, "key").collect() == whole
    last = max((r for r in rows if r[0] == whole[0]["key"] and r[2]), key=lambda r: (r[1], r[2]))
    assert whole[0]["course_name"] == last[2] and whole[0]["count"] == sum(r[0] == whole[0]["key"] for r in rows)
