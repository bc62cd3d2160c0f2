"""Rules of sources, sinks, scans and supervision that no query over the driver tables reaches."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as fn
from lectern.operators import catalog, jobs, slides, timeline
from lectern.sources import files, playlist, sinks
from lectern.streaming import progress

from .test_golden import one

START = datetime(2024, 1, 1)


def test_scan_without_recursion(spark, tmp_path):
    for name in ("a.mp4", "sub/b.mp4"):
        p = tmp_path / "media" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"1")
    assert [r["stem"] for r in files.scan_files(spark, str(tmp_path / "media"), recursive=False).collect()] == ["a"]


def test_writers_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "line"), ("b", "other")], "k string, body string")
    sinks.write_bodies(rows, str(tmp_path / "bodies"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "bodies")).collect()) == ["line", "other"]
    for _ in range(2):
        sinks.write_records(rows, str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 4
    long = sinks.markdown(spark.range(12), 10).split("\n")
    assert len(long) == 13 and long[-1] == "(more than 10 rows)" and sinks.markdown(spark.range(10), 10).count("\n") == 11


def test_log_tail_of_a_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.log_tail(spark, str(tmp_path / "log.txt"), 3).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["pos"], r["line"]) for r in got] == [(0, "line 4999"), (1, "line 4998"), (2, "line 4997")]


def test_medians_first_keys_and_caps(spark):
    for n in range(1, 7):
        df = spark.range(n).selectExpr("1 as k", "id * 10 as v")
        assert catalog.upper_median(df, ["k"], "v").first()["median"] == sorted(range(0, n * 10, 10))[n // 2]
    df = spark.range(200).selectExpr("id % 2 as k", "id % 60 as v")
    got = {r["k"]: (r["n"], r["first"]) for r in catalog.first_keys(df, ["k"], "v", 3).collect()}
    assert got == {0: (30, [0, 2, 4]), 1: (30, [1, 3, 5])}
    for size, whole in ((4, "h:aaaa\nh:bbbb"), (3, "h:aaa\nh:bbb")):
        texts = spark.createDataFrame([(1, 1, "a" * size), (1, 2, "b" * size), (1, 3, " ")], "k int, n int, t string")
        for cap in range(1, 16):
            text = catalog.concat_capped(texts, ["k"], ["n"], F.lit("h:"), F.col("t"), cap, "+").first()["text"]
            assert text == (whole if len(whole) <= cap else whole[:cap] + "+")


def test_scans_agree_with_folds_over_many_batches(spark):
    rows = spark.range(3000).selectExpr("id % 3 as k", "id as n", "cast((id * 7919 % 997) / 10 + id as double) as t", "xxhash64(id % 40) as w", "id % 7 <> 0 as ok")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        folded = timeline.sorted_rows(rows, ["k"], ["t", "n"], "w", "ok")
        pairs = lambda df, c: sorted((r["k"], r[c]) for r in df.collect())
        spaced = folded.select("k", F.explode(timeline.keep_spaced(F.col("rows"), "t", 25.0)).alias("r")).select("k", "r.n")
        assert pairs(timeline.spaced(rows, ["k"], ["t", "n"], "t", 25.0, "n"), "n") == pairs(spaced, "n")
        for memory in (1, 5):
            kept = folded.select("k", F.explode(timeline.keep_unlike(F.col("rows"), "w", 28, memory)).alias("r")).select("k", "r.n")
            assert pairs(timeline.unlike(rows, ["k"], ["t", "n"], "w", 28, "n", memory), "n") == pairs(kept, "n")
        done = rows.selectExpr("k", "n div 3 + 1 as done", "1000L as total")
        emitted = timeline.sorted_rows(done, ["k"], ["done"], "total").select("k", F.explode(timeline.throttle(F.col("rows"), "done", F.lit(1000), 7.0)).alias("r")).select("k", "r.done")
        assert pairs(timeline.throttled(done, ["k"], "done", "total", 7.0), "done") == pairs(emitted, "done")
        sizes = folded.select("k", F.posexplode(timeline.adaptive_window(F.transform("rows", lambda r: r["ok"]))).alias("p", "size"))
        got = timeline.windows(rows, ["k"], ["t", "n"], "ok")
        assert sorted((r["k"], r["pos"] - 1, r["size"]) for r in got.collect()) == sorted((r["k"], r["p"], r["size"]) for r in sizes.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_job_rules(spark):
    assert [one(spark, fn.probed_duration(F.lit(x))) for x in ("12.5", " 3 ", "N/A", "-1", None, "inf")] == [12.5, 3.0, 0.0, 0.0, 0.0, 0.0]
    assert [one(spark, fn.reusable_audio(F.lit(n), F.lit(10.0))) for n in (32000, 32001)] == [False, True] and not one(spark, fn.reusable_audio(F.lit(1000), F.lit(0.0)))
    assert one(spark, fn.reachable(F.lit(True), F.lit(None).cast("boolean"))) is False and one(spark, fn.complete(F.lit(99), F.lit(100), strict=True)) is False
    empty = jobs.batch_totals(spark.createDataFrame([], "slides int, status string")).first()
    assert (empty["files"], empty["succeeded"], empty["slides"]) == (0, 0, 0)
    manifest = slides.slide_manifest(
        spark.createDataFrame([("a", None), ("b", None), ("c", "codec")], "m string, error string"), spark.createDataFrame([("a", "2.jpg"), ("a", "1.jpg")], "m string, f string"), "m", "f")
    assert {r["m"]: (r["status"], r["files"]) for r in manifest.collect()} == {"a": ("ok (2)", ["1.jpg", "2.jpg"]), "b": ("placeholder", []), "c": ("failed: codec", [])}


def test_nested_playlists_that_never_end(spark):
    lines = playlist.playlist_lines(spark.createDataFrame([("a", "https://h/x", "#EXT-X-STREAM-INF:BANDWIDTH=1\nb"), ("b", "https://h/x", "#EXT-X-STREAM-INF:BANDWIDTH=1\na")], "playlist_id string, base_url string, text string"))
    links = spark.createDataFrame([("https://h/a", "a"), ("https://h/b", "b")], "url string, target string")
    assert playlist.resolved(lines, links).count() == 0


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema):
        path = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    return make


def at(s):
    return START + timedelta(seconds=s)


def test_supervisor_knows_exits_and_ends(stream):
    rows = [("a", at(0), 1, False, False), ("a", at(5), 1, True, False), ("a", at(300), 1, False, False), ("a", at(700), 1, False, True), ("a", at(5000), 1, True, False)]
    df = stream(rows, "job_id string, ts timestamp_ntz, log_bytes long, gone boolean, over boolean")
    got = progress.drain(progress.supervise(progress.as_events(df), exited="gone", done="over"), "exits")
    assert sorted((r["ts"], r["restart"]) for r in got.collect()) == [(at(5), 1)]


def test_timers_fire_without_a_further_sample(spark, stream):
    df = stream([("a", at(0), 1), ("b", at(1), 1)], "job_id string, ts timestamp_ntz, log_bytes long")
    said = []
    listener = progress.ProgressListener(lambda n, total, message: said.append((n, message)))
    spark.streams.addListener(listener)
    queries = [
        progress.idle_alarms(progress.as_events(df), idle=2).writeStream.outputMode("append").format("memory").queryName("alarms").start(),
        progress.supervise(progress.as_events(df), stall=2, most=2, timer=True).writeStream.outputMode("append").format("memory").queryName("late").start()]
    try:
        until = time.time() + 60
        while time.time() < until and (spark.table("alarms").count() < 2 or spark.table("late").count() < 4):
            time.sleep(1)
    finally:
        for q in queries:
            q.stop()
        spark.streams.removeListener(listener)
    assert sorted((r["job_id"], r["at"]) for r in spark.table("alarms").collect()) == [("a", at(2)), ("b", at(3))]
    assert sorted((r["job_id"], r["restart"]) for r in spark.table("late").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert any(n == 2 for n, _ in said) and said[0] == (0, "started")


def test_observed_metrics(spark):
    df, seen = progress.observed(spark.range(7), "seven", most=F.max("id"))
    assert df.count() == 7 and seen.get == {"most": 6}
