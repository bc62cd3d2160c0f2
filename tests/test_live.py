"""Streams with state, the spool source, playlist files and restarts: the same rows as the batch, however they are cut."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, slides
from lectern.sources import playlist, playlist_files, spool
from lectern.streaming import keyframes, restart

START = datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, keyframes.ROCKSDB)
    yield
    spark.conf.set(name, before)


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def put(spark, rows, schema, folder):
    """One more file, newer than those before it: streams read files in the order of their times."""
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for name in set(os.listdir(folder)) - there:
        if name.startswith("part-"):
            when = 1_700_000_000 + 10 * len(there)
            os.utime(f"{folder}/{name}", (when, when))


def frames(seed, media=3, n=220):
    """Stable stretches, single changes and passages that keep changing."""
    rng = random.Random(seed)
    rows = []
    for m in range(media):
        word, i = rng.getrandbits(63), 0
        while i < n:
            moving = rng.random() < 0.4
            for _ in range(rng.randint(3, 25)):
                if moving:
                    word = rng.getrandbits(63)
                rows.append((f"m{m}", i * 0.5, word if rng.random() < 0.95 else word ^ 3))
                i += 1
            word = rng.getrandbits(63)
    return rows


FRAMES = "media_id string, ts double, w long"


def test_keyframes_of_any_split_and_after_restarts(spark, tmp_path, rocksdb):
    rows = frames(1, 4, 320)
    want = sorted(map(tuple, slides.keyframes(spark.createDataFrame(rows, FRAMES), "media_id", "ts", "w", 63).collect()))
    rng = random.Random(2)
    rows.sort(key=lambda r: r[1])
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        put(spark, rows[a:b], FRAMES, folder)
        if i % 2:  # some runs find two new files, and each begins from the checkpoint
            stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(folder)
            run(keyframes.stream_keyframes(stream, "media_id", "ts", "w", 63), out, checkpoint)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) > 5


def test_late_frames_wait_for_the_watermark(spark, tmp_path, rocksdb):
    rows = frames(3, 2, 120)
    want = sorted(map(tuple, slides.keyframes(spark.createDataFrame(rows, FRAMES), "media_id", "ts", "w", 63).collect()))
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))
    folder = str(tmp_path / "in")
    parts = [mixed[a : a + 60] for a in range(0, len(mixed), 60)] + [[("end", 10_000.0, 0)], [("end", 20_000.0, 0)]]
    for part in parts:
        put(spark, part, FRAMES, folder)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(folder)
    run(keyframes.stream_keyframes(stream, "media_id", "ts", "w", 63, late="10 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("media_id <> 'end'").collect()))
    assert got == want and len(want) > 5


def test_state_round_trip_and_options(spark):
    m = slides.Machine()
    for r in frames(7, 1, 60):
        slides.advance(m, r[1], r[2], 63)
        again = keyframes.from_row(keyframes.to_row(m))
        assert again == m and again.flags.maxlen == slides.WINDOW
    with pytest.raises(ValueError, match="choose one"):
        keyframes.stream_keyframes(spark.createDataFrame([], FRAMES), "media_id", "ts", "w", late="1 second", ttl_seconds=5)


def spool_file(folder, name, first, n):
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}"
    with open(draft, "w") as f:
        for i in range(first, first + n):
            f.write(json.dumps({"job_id": f"j{i % 3}", "ts": (START + timedelta(seconds=i)).isoformat(), "done": i, "total": 999}) + "\n")
    os.rename(draft, f"{folder}/{name}")


def test_spool_is_drained_in_bounded_steps_and_goes_on_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("spool", "out", "cp"))
    spool_file(folder, "0001", 0, 37)
    spool_file(folder, "0002", 37, 1)
    with open(f"{folder}/0003", "w") as f:
        f.write('no json\n{"job_id": 5, "done": "x"}')  # a broken line, and a last line without an end
    sizes, seen = [], []

    def take(batch, epoch):
        rows = batch.collect()
        if rows:
            sizes.append(len(rows))
            seen.extend(rows)

    def start():
        return spool.read_spool(spark, folder, 20).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).start()

    q = start()
    q.processAllAvailable()
    q.stop()
    assert sizes == [20, 20] and [r["done"] for r in seen[:38]] == list(range(38)) and [(r["job_id"], r["done"]) for r in seen[38:]] == [(None, None), ("5", None)]
    spool_file(folder, "0004", 38, 45)
    for _ in range(2):  # a restart with and one without new rows
        q = start()
        q.processAllAvailable()
        spool_file(folder, "0005", 83, 7)
        q.processAllAvailable()
        q.stop()
    assert max(sizes) <= 20 and sorted(r["done"] for r in seen if r["done"] is not None) == list(range(90))
    assert seen[0]["ts"] == START and seen[0]["status"] is None


def test_a_failed_batch_is_read_again(spark, tmp_path):
    folder, checkpoint, seen = str(tmp_path / "spool"), str(tmp_path / "cp"), {}
    spool_file(folder, "0001", 0, 50)

    def start(fail):
        def take(batch, epoch):
            rows = [r["done"] for r in batch.collect()]
            if fail and epoch == 1:
                raise RuntimeError("writer died")
            seen[epoch] = rows

        return spool.read_spool(spark, folder, 20).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).start()

    q = start(True)
    with pytest.raises(Exception, match="writer died"):
        q.processAllAvailable()
    q.stop()
    q = start(False)
    q.processAllAvailable()
    q.stop()
    assert seen == {0: list(range(20)), 1: list(range(20, 40)), 2: list(range(40, 50))}


def test_a_spool_step_reads_its_own_bytes_only(spark, tmp_path, monkeypatch):
    from pyspark.sql.types import _parse_datatype_string

    folder, read = str(tmp_path / "spool"), []
    spool_file(folder, "0001", 0, 3000)
    size = os.path.getsize(f"{folder}/0001")
    monkeypatch.setattr(spool, "CHUNK_BYTES", 1024)
    chunks = spool.SpoolReader._chunks
    monkeypatch.setattr(spool.SpoolReader, "_chunks", lambda self, *a: (read.append(len(c)) or c for c in chunks(self, *a)))
    reader = spool.SpoolReader(_parse_datatype_string("done int, total long, status int"), {"path": folder, "maxrows": "100"})
    at, seen, steps = reader.initialOffset(), [], 0
    while (after := reader.latestOffset()) != at:
        parts = reader.partitions(at, after)
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert len(parts) == 1 and len(rows) == 100
        seen, at, steps = seen + rows, after, steps + 1
    assert [r["done"] for r in seen] == list(range(3000)) and steps == 30
    assert sum(read) <= 4 * size  # found and read once each; from the start of the file it would be 30 times
    again = spool.SpoolReader(reader.schema, {"path": folder, "maxrows": "100"})  # an offset of lines alone, as it was stored before
    assert [r["done"] for p in again.partitions({"file": "0001", "line": 40}, {"file": "0001", "line": 43}) for b in again.read(p) for r in b.to_pylist()] == [40, 41, 42]
    with open(f"{folder}/0002", "w") as f:
        f.write('{"done": 3000000000, "total": 3000000000, "status": Infinity}\n\n[1]\n{"done": "7"}')
    rows = [r for p in reader.partitions(at, reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in rows] == [(None, 3_000_000_000, None), (None,) * 3, (None,) * 3, (7, None, None)]


@pytest.fixture
def playlists(tmp_path):
    """A tree of playlist files: masters that lead to masters and to media playlists."""
    files = {
        "a/master.m3u8": "#EXTM3U\r\n#EXT-X-STREAM-INF:BANDWIDTH=100\r\nlow/list.m3u8\r\n\r\n#EXT-X-STREAM-INF:BANDWIDTH=900\r\n/a/high/inner.m3u8\r\n",
        "a/high/inner.m3u8": "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\nlist.m3u8\n",
        "a/high/list.m3u8": "#EXTM3U\n#EXTINF:4,\n0.ts\n\n#EXTINF:4,\nhttps://other/1.ts\n/2.ts\n#EXT-X-ENDLIST\nafter.ts\n",
        "a/low/list.m3u8": "#EXTM3U\nx.ts\n",
        "b/only.M3U8": "#EXTM3U\ny.ts",
        "b/notes.txt": "not a playlist",
    }
    for name, text in files.items():
        p = tmp_path / "lists" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return str(tmp_path / "lists")


def test_playlist_files_and_the_recursion_of_masters(spark, playlists):
    lines = playlist_files.read_playlists(spark, playlists, "https://host", task_bytes=1)
    assert {r["playlist_id"] for r in lines.collect()} == {"a/master", "a/high/inner", "a/high/list", "a/low/list", "b/only"}
    found = {r["playlist_id"]: (r["url"], r["depth"]) for r in playlist.resolved(lines, playlist_files.links(lines)).collect()}
    assert found == {"a/master": ("https://host/a/high/list.m3u8", 2), "a/high/inner": ("https://host/a/high/list.m3u8", 1)}
    high = [(r["idx"], r["url"]) for r in playlist.segments(lines.where("playlist_id = 'a/high/list'")).orderBy("idx").collect()]
    assert high == [(0, "https://host/a/high/0.ts"), (1, "https://other/1.ts"), (2, "https://host/2.ts")]


def test_pushed_filters_prune_files(spark, playlists):
    lines = playlist_files.read_playlists(spark, playlists, "https://host", task_bytes=1)
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(lines) == 5 and parts(lines.where("playlist_id = 'a/low/list'")) == 1
    assert parts(lines.where(F.col("playlist_id").startswith("a/high"))) == 2 and parts(lines.where(F.col("playlist_id").isin("b/only", "a/master", "none"))) == 2
    both = lines.where("playlist_id like 'a/%' and pos > 0 and playlist_id <> 'a/master'")
    assert {r["playlist_id"] for r in both.collect()} == {"a/high/inner", "a/high/list", "a/low/list"}
    assert lines.where("playlist_id = 'none'").collect() == []
    # All files fit one task by default.
    assert parts(playlist_files.read_playlists(spark, playlists, "https://host")) == 1


ITEMS = "k string, ts timestamp"


def at(s):
    return START + timedelta(seconds=s)


def test_missing_outputs_are_told_after_a_restart_too(spark, tmp_path):
    rng = random.Random(6)
    expected = [(f"v{i}", at(10 * i)) for i in range(60)]
    outputs = [(k, t + timedelta(seconds=rng.randint(0, 250))) for k, t in expected if rng.random() < 0.7]
    late = {k for (k, t) in outputs if (t - dict(expected)[k]).seconds > 120}
    assert late
    have = spark.createDataFrame([r for r in outputs if r[0] not in late], ITEMS)
    want = sorted(r["k"] for r in catalog.missing(spark.createDataFrame(expected, ITEMS), have, "k").collect())
    e, o, out, checkpoint = (str(tmp_path / x) for x in ("e", "o", "out", "cp"))

    def write(rows, path):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(path)

    for lo, hi in ((0, 200), (200, 401), (401, 10_000)):
        write([r for r in expected if at(lo) <= r[1] < at(hi)], e)
        write([r for r in outputs if at(lo) <= r[1] < at(hi)], o)
        if hi > 9000:  # a last row of each moves time on
            write([("end", at(9000))], e)
            write([("end", at(9000))], o)
        streams = [spark.readStream.schema(ITEMS).parquet(p) for p in (e, o)]
        run(restart.still_missing(*streams, "k", "ts", "120 seconds", "260 seconds"), out, checkpoint)  # a new query each time
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == want


def test_work_done_once_over_restarts(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in ([("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(30)), ("c", at(31))], [("b", at(33)), ("d", at(34))]):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(folder)
        run(restart.once(spark.readStream.schema(ITEMS).parquet(folder), ["k"], "ts", "1 hour"), out, checkpoint)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]
