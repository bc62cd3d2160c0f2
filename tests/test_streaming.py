"""Streams over small files, drained to memory."""

from datetime import datetime, timedelta

import pytest

from lectern.streaming import progress

START = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        path = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    return make


def at(s):
    return START + timedelta(seconds=s)


def test_idle_of_exactly_the_limit_goes_on(stream):
    df = stream([("a", at(s), s) for s in (0, 180, 361)], "job_id string, ts timestamp_ntz, done int")
    got = progress.drain(progress.activity(progress.as_events(df), "job_id", "ts"), "spells", "complete")
    assert sorted(r["events"] for r in got.collect()) == [1, 2]


def test_latest_and_windows(stream):
    df = stream([("a", at(s), s) for s in (0, 100, 400)], "job_id string, ts timestamp_ntz, done int")
    events = progress.as_events(df)
    assert [(r["job_id"], r["done"]) for r in progress.drain(progress.latest(events, "job_id", "ts", "done"), "newest", "complete").collect()] == [("a", 400)]
    assert sorted(r["events"] for r in progress.drain(progress.windowed(events, "ts", "5 minutes", None, "job_id"), "windows", "complete").collect()) == [1, 2]


def test_supervisor_restarts_after_a_stall(stream):
    df = stream([("a", at(s), n) for s, n in ((0, 1), (600, 1), (601, 1), (700, 2), (1300, 2), (1302, 2))], "job_id string, ts timestamp_ntz, log_bytes long")
    got = progress.drain(progress.supervise(progress.as_events(df)), "restarts")
    assert sorted((r["ts"], r["restart"]) for r in got.collect()) == [(at(601), 1), (at(1302), 2)]


def test_batches_go_to_a_writer(stream, tmp_path):
    df, seen = stream([("a", at(s), s) for s in (0, 1)], "job_id string, ts timestamp_ntz, done int"), []
    q = progress.for_each_batch(df, lambda b, epoch: seen.append((epoch, b.count())), str(tmp_path / "cp"), "append")
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 2)]
