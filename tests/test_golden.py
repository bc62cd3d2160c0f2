"""Hand-computed rows for rules with thresholds, ties and traps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as fn
from lectern.operators import catalog, jobs, slides, timeline, transcript
from lectern.sources import files, playlist, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("seconds", "srt", "minutes", "clock"), [(0.0, "00:00:00,000", "00:00", "00:00"), (1.001, "00:00:01,000", "00:01", "00:01"), (6307.5, "01:45:07,500", "105:07", "01:45:07")])
def test_times(spark, seconds, srt, minutes, clock):
    s = F.lit(seconds)
    assert (one(spark, fn.srt_time(s)), one(spark, fn.minute_time(s)), one(spark, fn.clock_time(s))) == (srt, minutes, clock)


@pytest.mark.parametrize(("text", "want"), [("105:07", 6307), ("1:02:03", 3723), ("5", 0), ("", 0), ("1:2:3:4", 0), ("a:b", None)])
def test_parse_time(spark, text, want):
    assert one(spark, fn.parse_time(F.lit(text))) == want


def test_names_labels_and_sizes(spark):
    assert one(spark, fn.sanitize_name(F.lit('　a/b:c*?"<>|d\\ '))) == "a_b_c______d_"
    assert one(spark, fn.history_label(F.lit("7"), F.lit("x" * 30), F.lit(" P "), F.lit(0))) == "7  ·  " + "x" * 27 + "… · P  ·  1 次"
    assert [one(spark, fn.human_bytes(F.lit(n))) for n in (1023, 1024, 1536 * 1024, 5 << 40)] == ["1023.0 B", "1.0 KB", "1.5 MB", "5.0 TB"]
    # Ties go to the even digit, and the largest unit takes what is beyond it.
    assert [one(spark, fn.human_bytes(F.lit(n), "GB")) for n in (1024 + 256, 1024 + 768, 16 * 512_000**2, None)] == ["1.2 KB", "1.8 KB", "3906.2 GB", None]
    assert [one(spark, fn.backoff(F.lit(a))) for a in (0, 3, 9)] == [0.5, 4.0, 8.0]
    assert [one(spark, fn.error_class(F.lit(m))) for m in ("ProxyError timeout", "Read timed out", "SSLError", "other")] == ["proxy", "timeout", "ssl", "other"]
    assert [one(spark, fn.complete(F.lit(n), F.lit(100))) for n in (95, 94)] == [True, False] and one(spark, fn.complete(F.lit(19), F.lit(20)))
    assert one(spark, fn.healthy(F.lit(1048576), F.lit(30.0))) and not one(spark, fn.healthy(F.lit(1048575), F.lit(30.0))) and not one(spark, fn.healthy(F.lit(1048576), F.lit(29.99)))
    assert [one(spark, fn.status_label(F.lit(c))) for c in (-2, -1, 0, 1, 2, 9)] == ["starting", "failed", "downloading", "merging", "done", ""]
    assert one(spark, fn.similarity(F.array(F.lit(3).cast("long")), F.array(F.lit(0).cast("long")))) == 1 - 2 / 64
    assert one(spark, fn.total_time(F.lit(100), F.lit(1.0), F.lit(10), F.lit(50.0), F.lit(2.0))) == pytest.approx(5 + 2 + 2 + 2)


def test_keep_first_counts_a_copy_without_url(spark):
    df = spark.createDataFrame([("a", 0, ""), ("a", 1, "u"), ("b", 2, "v")], "name string, pos int, url string")
    assert [tuple(r) for r in catalog.keep_first(df, ["name"], ["pos"]).orderBy("name").collect()] == [("a", 0, ""), ("b", 2, "v")]


def test_upper_median_and_ranking(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 3.0), ("c", 6.0), ("c", None)], "name string, v double")
    got = jobs.rank_trials(df, ["name"], F.col("v"), F.col("v").isNotNull()).orderBy("rank").collect()
    assert [(r["name"], r["median"], r["rank"], r["ratio"]) for r in got] == [("a", 3.0, 1, 1.0), ("b", 3.0, 2, 1.0), ("c", 6.0, 3, 2.0)]


def test_gaps_stalls_and_sessions(spark):
    df = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 25), (1, 2, 35, 40), (1, 3, 30, 41), (2, 0, 5, 9)], "m int, seq int, start int, end int")
    assert [tuple(r) for r in timeline.largest_gap(df, ["m"], ["seq"], "start", "end").collect()] == [(1, 10, 20)]
    p = spark.createDataFrame([(1, 0.0, 1), (1, 1.0, 1), (1, 5.0, 2), (1, 10.0, 3), (1, 12.0, 4), (2, 3.0, 1)], "job int, t double, done int")
    assert sorted(tuple(r) for r in timeline.longest_stall(p, ["job"], ["t"], "t", "done").collect()) == [(1, 5.0, 0.0), (2, 0.0, 0.0)]
    s = spark.createDataFrame([(1, 0.0), (1, 180.0), (1, 361.0)], "job int, t double")
    assert [r["session"] for r in timeline.idle_sessions(s, ["job"], ["t"], F.col("t")).orderBy("t").collect()] == [0, 0, 1]


def test_folds(spark):
    df = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.0, 2.5, 4.1, 5.9, 6.1)], "m int, ts double")
    rows = timeline.sorted_rows(df, ["m"], ["ts"])
    assert [r["ts"] for r in rows.select(timeline.keep_spaced(F.col("rows"), "ts", 2.0)).first()[0]] == [0.0, 2.0, 4.1, 6.1]
    h = spark.createDataFrame([(1, i, w) for i, w in enumerate([0, (1 << 25) - 1, (1 << 26) - 1, 1, 0])], "m int, n int, w long")
    assert [r["n"] for r in timeline.sorted_rows(h, ["m"], ["n"], "w").select(timeline.keep_unlike(F.col("rows"), "w", 25)).first()[0]] == [0, 2, 4]
    oks = spark.createDataFrame([([True, False, False] + [False] * 9,)], "o array<boolean>")
    assert oks.select(timeline.adaptive_window(F.col("o"))).first()[0] == [17, 15, 13, 11, 9, 7, 5, 4, 4, 4, 4, 4]


def test_recent_five_looks_back_five(spark):
    far = [((1 << 20) - 1) << (i * 7) for i in range(6)]
    back = lambda k: [*far, far[6 - k]]
    for k, seen in ((5, True), (6, False)):
        df = spark.createDataFrame([(1, i, w & (1 << 62) - 1) for i, w in enumerate(back(k))], "m int, n int, w long")
        kept = [r["n"] for r in timeline.sorted_rows(df, ["m"], ["n"], "w").select(timeline.keep_unlike(F.col("rows"), "w", 0, 5)).first()[0]]
        assert (6 not in kept) == seen


def test_scene_fallback_and_keyframes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.1), (1, 1.0, 0.11), (2, 0.0, 0.1), (2, 1.0, 0.05), (3, 0.0, 0.01)], "media_id int, ts double, score double")
    assert sorted((r[0], r[1]) for r in slides.scene_cuts(df).collect()) == [(1, 1.0), (2, 0.0)]
    a, b = 0, (1 << 40) - 1
    still = [(1, i * 0.5, a) for i in range(8)] + [(1, 4.0 + i * 0.5, b) for i in range(8)]
    moving = [(2, i * 0.5, (a, b)[i % 2]) for i in range(10)] + [(2, 5.0 + i * 0.5, a) for i in range(12)]
    got = slides.keyframes(spark.createDataFrame([*still, *moving], "m int, ts double, w long"), "m", "ts", "w").collect()
    assert sorted(tuple(r) for r in got if r[0] == 1) == [(1, 0.0), (1, 4.0)]
    # The compared hash is frozen in a moving passage; the slide that waits is the last that changed, taken after four calm samples.
    assert sorted(tuple(r) for r in got if r[0] == 2) == [(2, 0.0), (2, 4.5)]


def test_transcripts(spark):
    lines = ["[105:07-105:09] x", "noise", "[1:02:03-1:02:09] y", "=====", "[00:01-00:02] z"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "media_id int, pos int, line string")
    assert [tuple(r) for r in transcript.parse_lines(df).orderBy("pos").collect()] == [(1, 0, 6307, 6309, "x"), (1, 2, 3723, 3729, "y")]
    seg = [(k, i, i * 10, i * 10 + 1, "ok") for k, n in ((1, 100), (2, 101)) for i in range(n)] + [(3, 0, 0, 1, "long text"), (3, 1, 301, 302, "long text"), (4, 0, 0, 1, "long text"), (4, 1, 302, 303, "12.5")]
    q = {r["media_id"]: r for r in transcript.quality(spark.createDataFrame(seg, "media_id int, pos int, start int, end int, text string")).collect()}
    assert (q[1]["suspect"], q[2]["suspect"], q[3]["long_break"], q[4]["long_break"], q[4]["short_lines"]) == (False, True, False, True, 1)
    d = transcript.chunk_plan(spark.createDataFrame([(x,) for x in (1799.9, 1800.0, 2400.0, 2400.5)], "duration double"))
    assert sorted((r["duration"], r["chunk"], r["offset"], r["length"]) for r in d.collect()) == [
        (1799.9, 1, 0.0, 1799.9), (1800.0, 1, 0.0, 1200.0), (1800.0, 2, 1200.0, 600.0), (2400.0, 1, 0.0, 1200.0), (2400.0, 2, 1200.0, 1200.0), (2400.5, 1, 0.0, 1200.0), (2400.5, 2, 1200.0, 1200.0), (2400.5, 3, 2400.0, 0.5)]
    assert one(spark, fn.clamp_segment(F.lit(5.0), F.lit(3.0), F.lit(1.0), F.lit(10.0))).asDict() == {"start": 6.0, "end": 6.0}


MASTER = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=100\nlow/a.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900\n#note\nhigh/a.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900\nsame/a.m3u8\n#EXT-X-STREAM-INF:NAME=x\nnone/a.m3u8\n"
LEAF = '#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="k.bin"\n#EXTINF:2\nhttps://o.example/x.ts\n\n/rooted.ts\nrel#1.ts\n#EXT-X-ENDLIST\nlate.ts'


def test_playlists(spark):
    df = spark.createDataFrame([("m", "https://h.example/d/p.m3u8?t=1", MASTER), ("l", "https://h.example/d/p.m3u8", LEAF)], "playlist_id string, base_url string, text string")
    lines = playlist.playlist_lines(df)
    chosen = lambda p: playlist.variants(lines, p).first()["url"]
    assert [chosen(p) for p in ("best", "first", "last")] == [f"https://h.example/d/{x}/a.m3u8" for x in ("high", "low", "none")]
    leaf = lines.where("playlist_id = 'l'")
    assert [r["url"] for r in playlist.segments(leaf).orderBy("idx").collect()] == ["https://o.example/x.ts", "https://h.example/rooted.ts", "https://h.example/d/rel#1.ts"]
    text = playlist.rewritten(leaf).first()["text"]
    assert text.split("\n")[1:6] == ['#EXT-X-KEY:METHOD=AES-128,URI="key.m3u8key"', "#EXTINF:2", "0.ts", "1.ts", "2.ts"] and "late" not in text


def test_sources_and_sinks(spark, tmp_path):
    for name in ("a.MP4", "b.mp4", "transcripts/c.mp4", "d.txt", "sub/e.mkv"):
        p = tmp_path / "media" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12345")
    found = files.scan_files(spark, str(tmp_path / "media"))
    assert sorted((r["stem"], r["length"]) for r in found.collect()) == [("a", 5), ("b", 5)]
    assert sorted(r["stem"] for r in files.scan_media(spark, str(tmp_path / "media")).collect()) == ["a", "b", "e"]
    (tmp_path / "h.json").write_text('[{"course_id":"1","last_used":"2024"},{"course_id":" "},{"course_id":"2","last_used":"2025","count":3}]')
    assert [(r["course_id"], r["count"]) for r in files.read_history(spark, str(tmp_path / "h.json")).collect()] == [("2", 3), ("1", 1)]
    assert files.read_history(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "ids.txt").write_text("1\n\n# c\n 2 \n")
    assert [r["id"] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["1", "2"]
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(30))) + "\n")
    assert [r["line"] for r in files.log_tail(spark, str(tmp_path / "log.txt"), 3).collect()] == ["29", "28", "27"]
    (tmp_path / "lecture.txt").write_text("[00:01-00:02] a\n====\nb")
    assert [(r["media_id"], r["pos"], r["text"]) for r in transcript.parse_lines(files.read_transcripts(spark, str(tmp_path / "lecture.txt"))).collect()] == [("lecture", 0, "a")]
    body = spark.createDataFrame([("c", 1, '{"list":[]}'), ("c", 2, '{"data":[{"id":"7","title":"x"}]}'), ("c", 3, '[{"id":"8"}]')], "course_id string, attempt int, body string")
    assert [(r["pos"], r["id"]) for r in files.session_lists(body).collect()] == [(0, "7")]
    info = files.course_info(spark.createDataFrame([('{"code":"0","data":{"id":"5","name_zh":"n","professors":[]}}',), ('{"code":1}',)], "body string")).collect()
    assert [(r["course_id"], r["professor"], r["ok"]) for r in info] == [("5", "unknown", True), (None, "unknown", False)]
    for rows in ([1, 2], [3]):
        sinks.replace_table(spark.createDataFrame([(x,) for x in rows], "x int"), str(tmp_path / "t"))
    assert [r["x"] for r in sinks.read_table(spark, str(tmp_path / "t")).collect()] == [3]
    assert sinks.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_history_and_copies(spark):
    ev = spark.createDataFrame([("k", 1, "old"), ("k", 2, ""), ("z", 3, None)], "key string, at int, name string")
    assert [(r["key"], r["count"], r["course_name"]) for r in jobs.history(ev, "key", "at", course_name="name").collect()] == [("z", 1, None), ("k", 2, "old")]
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, size int")
    assert sorted(r["path"] for r in catalog.copy_plan(a, a.where("path <> 'z'").withColumn("size", F.lit(1)), "path", "size").collect()) == ["y", "z"]


def test_frame_hashes(spark):
    rng = np.random.default_rng(1)
    frame = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    df = spark.createDataFrame([(1, frame.tobytes()), (2, (255 - frame).tobytes()), (3, b"short"), (4, None)], "id int, pixels binary")
    got = {r["id"]: r["hash"] for r in slides.frame_hashes(df).collect()}
    n, k = np.arange(64), np.arange(16)
    low = [[sum(float(frame[y, x]) * math.cos(math.pi * u * (2 * y + 1) / 128) * math.cos(math.pi * v * (2 * x + 1) / 128) for y in n for x in n) for v in k] for u in k[:2]]
    value = sum((w & (1 << 64) - 1) << 64 * (3 - i) for i, w in enumerate(got[1]))
    whole = slides._cosines(64, 16) @ frame @ slides._cosines(64, 16).T
    assert np.allclose(low, whole[:2])
    assert [value >> (255 - i) & 1 for i in range(256)] == (whole > np.median(whole)).ravel().astype(int).tolist()
    assert sum((a ^ b).bit_count() for a, b in zip(*([w & (1 << 64) - 1 for w in got[i]] for i in (1, 2)), strict=True)) >= 250 and got[3] is None and got[4] is None
    ramp = np.tile(np.arange(17, dtype=np.uint8), (16, 1))
    ramp[1] = 9
    one_ = slides.frame_hashes(spark.createDataFrame([(1, ramp.tobytes())], "id int, pixels binary"), kind="gradient").first()["hash"]
    assert one_ == [-(1 << 48) | (1 << 32) - 1, -1, -1, -1]


def test_transcribe_with_a_plugged_recogniser(spark):
    def load():
        return lambda source, offset, length: [(1.0, 2.5, f" {source} "), (3.0, 4.0, "  "), (length - 1, length + 9, "end")]

    plan = transcript.chunk_plan(spark.createDataFrame([("m", "a.wav", 2400.5)], "media_id string, source string, duration double"))
    got = sorted(tuple(r) for r in transcript.transcribe(plan, load).collect())
    assert got == [
        ("m", 1, 0, 1.0, 2.5, "a.wav"), ("m", 1, 2, 1199.0, 1209.0, "end"), ("m", 2, 0, 1201.0, 1202.5, "a.wav"), ("m", 2, 2, 2399.0, 2409.0 - 8.5, "end"),
        ("m", 3, 0, 2400.5, 2400.5, "a.wav"), ("m", 3, 2, 2399.5, 2400.5, "end")]
