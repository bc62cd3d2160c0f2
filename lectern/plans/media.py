"""Playlist, reply, transcript, slide, job and progress queries over relations built from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import catalog, jobs, slides, transcript
from ..sources import files, playlist
from ..streaming import progress
from .base import Tables, query

# A page becomes a playlist: masters (every third page) list three variants, the others segments with a key line and
# lines after the end mark. The SQL builds the same texts.
TEXT_SQL = """p AS (
  SELECT page_id, 'https://h' || (page_id % 4) || '.example/d/p.m3u8?t=' || page_id AS base,
    CASE WHEN page_id % 3 = 0 THEN '#EXTM3U' || chr(10) || '#EXT-X-STREAM-INF:BANDWIDTH=' || (page_id % 5 * 100) || chr(10) || 'low/a.m3u8' || chr(10)
      || '#EXT-X-STREAM-INF:BANDWIDTH=' || (page_id % 7 * 100) || ',AVERAGE-BANDWIDTH=' || (page_id % 7 * 90) || chr(10) || '#note' || chr(10) || '/mid/a.m3u8' || chr(10)
      || '#EXT-X-STREAM-INF:NAME=x' || chr(10) || 'https://o.example/none.m3u8' || chr(10)
    ELSE '#EXTM3U' || chr(10) || '#EXT-X-KEY:METHOD=AES-128,URI="k' || page_id || '.bin"' || chr(10) || 'a' || page_id || '.ts' || chr(10) || chr(10) || '/r/b.ts' || chr(10)
      || '#EXTINF:2' || chr(10) || 'https://o.example/c#1.ts' || chr(10) || '#EXT-X-ENDLIST' || chr(10) || 'late.ts' END AS text
  FROM pages)"""


def _playlists(t: Tables) -> DataFrame:
    n, feed = F.col("page_id"), F.lit("\n")
    s = lambda c: c.cast("string")
    master = F.concat_ws(
        "\n", F.lit("#EXTM3U"), F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), s(n % 5 * 100)), F.lit("low/a.m3u8"),
        F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), s(n % 7 * 100), F.lit(",AVERAGE-BANDWIDTH="), s(n % 7 * 90)), F.lit("#note"), F.lit("/mid/a.m3u8"),
        F.lit("#EXT-X-STREAM-INF:NAME=x"), F.lit("https://o.example/none.m3u8"), F.lit(""))
    leaf = F.concat(
        F.lit('#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="k'), s(n), F.lit('.bin"\na'), s(n), F.lit(".ts\n\n/r/b.ts\n#EXTINF:2\nhttps://o.example/c#1.ts\n#EXT-X-ENDLIST\nlate.ts"))
    base = F.concat(F.lit("https://h"), s(n % 4), F.lit(".example/d/p.m3u8?t="), s(n))
    return t.pages.select(n.alias("playlist_id"), base.alias("base_url"), F.when(n % 3 == 0, master).otherwise(leaf).alias("text"))


VARIANT_SQL = """WITH b AS (SELECT page_id, page_id % 5 * 100 AS low, page_id % 7 * 90 AS mid FROM pages WHERE page_id % 3 = 0)"""


@query(f"""{VARIANT_SQL}
SELECT page_id AS playlist_id, CASE WHEN low >= mid THEN 'https://h' || (page_id % 4) || '.example/d/low/a.m3u8' ELSE 'https://h' || (page_id % 4) || '.example/mid/a.m3u8' END AS url,
       greatest(low, mid)::BIGINT AS bandwidth FROM b WHERE greatest(low, mid) > 0""")
def q_playlist_variant(t: Tables) -> DataFrame:
    return playlist.variants(playlist.playlist_lines(_playlists(t)))


@query(f"""WITH {TEXT_SQL}
SELECT page_id AS playlist_id, CASE WHEN page_id % 3 = 0 THEN 'https://o.example/none.m3u8' END AS url, 0::BIGINT AS bandwidth FROM p WHERE page_id % 3 = 0""")
def q_playlist_last(t: Tables) -> DataFrame:
    return playlist.variants(playlist.playlist_lines(_playlists(t)), "last")


@query(f"""WITH {TEXT_SQL},
l AS (SELECT page_id, base, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p WHERE page_id % 3 <> 0),
k AS (SELECT * FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND pos < (SELECT min(pos) FROM l e WHERE e.page_id = l.page_id AND starts_with(e.line, '#EXT-X-ENDLIST')))
SELECT page_id AS playlist_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS idx,
  CASE WHEN regexp_matches(line, '^[a-z]+://') THEN line WHEN starts_with(line, '/') THEN regexp_extract(base, '^([a-z]+://[^/]+)', 1) || line ELSE regexp_extract(base, '^([a-z]+://[^/]+)', 1) || '/d/' || line END AS url
FROM k""")
def q_playlist_segments(t: Tables) -> DataFrame:
    return playlist.segments(playlist.playlist_lines(_playlists(t).where("playlist_id % 3 <> 0")))


@query("""
SELECT page_id AS playlist_id, '#EXTM3U' || chr(10) || '#EXT-X-KEY:METHOD=AES-128,URI="key.m3u8key"' || chr(10) || '0.ts' || chr(10) || '1.ts' || chr(10) || '#EXTINF:2' || chr(10) || '2.ts' || chr(10)
  || '#EXT-X-ENDLIST' || chr(10) AS text FROM pages WHERE page_id % 3 <> 0""")
def q_playlist_rewrite(t: Tables) -> DataFrame:
    return playlist.rewritten(playlist.playlist_lines(_playlists(t).where("playlist_id % 3 <> 0")))


@query("""
SELECT page_id AS playlist_id, 'https://e.example/' || goal AS url, (goal - page_id)::INTEGER AS depth
FROM (SELECT page_id, least(page_id - page_id % 9 + 9, top + 1) AS goal FROM pages, (SELECT max(page_id) AS top FROM pages)) WHERE page_id % 9 <> 0 AND goal - page_id <= 5""")
def q_playlist_nesting(t: Tables) -> DataFrame:
    # Playlist n leads to n + 1 up to the next multiple of nine: chains of one to eight, of which five are followed.
    n = F.col("page_id")
    lines = t.pages.where("page_id % 9 <> 0").select(
        n.alias("playlist_id"), F.lit("https://e.example/p").alias("base_url"),
        F.concat(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\n"), (n + 1).cast("string")).alias("text"))
    chain = playlist.playlist_lines(lines)
    links = t.pages.where("page_id % 9 <> 0").select(F.concat(F.lit("https://e.example/"), (n + 1).cast("string")).alias("url"), (n + 1).alias("target"))
    return playlist.resolved(chain, links)


# Replies of a course service: code 0 as number or text, lists in three shapes, the first attempt empty.
@query("""
SELECT p_partkey::VARCHAR AS course_id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE p_brand END AS professor, p_size % 5 <> 1 AS ok,
  CASE WHEN p_size % 5 = 1 THEN 'bad reply' WHEN p_size % 7 = 0 THEN 'no sessions' END AS error FROM part""")
def q_course_info(t: Tables) -> DataFrame:
    size = F.col("p_size")
    people = F.when(size % 4 == 0, F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct(F.col("p_brand").alias("name"))))
    data = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name_zh"), people.alias("professors")))
    code = F.when(size % 5 == 1, F.lit("5")).when(size % 2 == 0, F.lit("0")).otherwise(F.lit('"0"'))
    info = files.course_info(t.part.select(F.concat(F.lit('{"code":'), code, F.lit(',"data":'), data, F.lit("}")).alias("body")))
    return files.checked_sessions(info, t.part.where("p_size % 7 <> 0").select(F.col("p_partkey").cast("string").alias("course_id")))


@query("""
WITH a AS (SELECT p_partkey AS course_id, unnest(range(0, p_size % 3 + 1)) AS pos, p_size FROM part WHERE p_size % 4 <> 3)
SELECT course_id, pos::INTEGER AS pos, (course_id * 10 + pos)::VARCHAR AS id, 's' || pos AS title FROM a""")
def q_session_lists(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    items = F.transform(F.sequence(F.lit(0), (size % 3).cast("int")), lambda i: F.struct((key * 10 + i).cast("string").alias("id"), F.concat(F.lit("s"), i.cast("string")).alias("title")))
    listed = F.to_json(items)
    body = F.when(size % 4 == 0, listed).when(size % 4 == 1, F.concat(F.lit('{"data":'), listed, F.lit("}"))).when(size % 4 == 2, F.concat(F.lit('{"list":'), listed, F.lit("}"))).otherwise('{"data":[]}')
    replies = t.part.select(key.alias("course_id"), F.explode(F.array(F.struct(F.lit(1).alias("attempt"), F.lit('{"list":[]}').alias("body")), F.struct(F.lit(2).alias("attempt"), body.alias("body")))).alias("r"))
    return files.session_lists(replies.select("course_id", "r.*")).select("course_id", "pos", "id", "title")


@query("""
SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY s_nationkey""")
def q_first_match(t: Tables) -> DataFrame:
    wanted = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return catalog.first_match(t.supplier, wanted, "s_nationkey", ["s_acctbal", "s_suppkey"]).select("s_nationkey", "s_suppkey")


@query("""
WITH s AS (SELECT conv_id, turn, turn * 400 AS a, turn * 400 + length(text) % 200 AS b, text FROM conversations),
g AS (SELECT *, a - lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM s),
m AS (SELECT conv_id, gap, a FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY gap DESC, turn) AS n FROM g WHERE gap > 0) WHERE n = 1),
c AS (SELECT conv_id, count(*) AS lines, count(*) FILTER (regexp_matches(trim(text), '^[0-9.]+$') OR length(trim(text)) <= 3) AS short_lines FROM s GROUP BY conv_id)
SELECT c.conv_id AS media_id, lines, short_lines, coalesce(gap, 0) AS max_gap, coalesce(a, 0) AS gap_at, short_lines > 100 AS suspect, NOT short_lines > 100 AND coalesce(gap, 0) > 300 AS long_break
FROM c LEFT JOIN m USING (conv_id)""")
def q_transcript_quality(t: Tables) -> DataFrame:
    start = F.col("turn") * 400
    return transcript.quality(t.conversations.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), start.alias("start"), (start + F.length("text") % 200).alias("end"), "text"))


@query("SELECT event_id, round(value, 3) AS ts FROM events WHERE event_id % 3 <> 0")
def q_scene_log(t: Tables) -> DataFrame:
    shown = F.round("value", 3)
    line = F.when(F.col("event_id") % 3 == 0, "frame= 12 fps= 25").otherwise(F.concat(F.lit("[Parsed_showinfo] n:4 pts_time:"), F.format_string("%.3f", shown), F.lit(" duration:1")))
    return files.scene_log(t.events.select("event_id", line.alias("line"))).select("event_id", "ts")


@query("SELECT l_orderkey, l_linenumber, ts, floor(ts * 4)::INTEGER AS frame_no FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity / 8 AS ts FROM lineitem) WHERE floor(ts * 4) % 2 = 0")
def q_frames_at(t: Tables) -> DataFrame:
    # Both sides are laid out by medium before frames are told out, so the join moves no frame.
    shown = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("media_id"), (F.col("l_quantity") / 8).alias("ts")).repartition("media_id")
    times, media = shown.distinct(), shown.select("media_id").distinct()
    frames = media.select("media_id", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(2))).alias("frame_no"))
    found = files.frames_at(times.withColumn("fps", F.lit(4.0)).hint("shuffle_hash"), frames, few=True)
    return found.select("media_id.l_orderkey", "media_id.l_linenumber", "ts", "frame_no")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 12 = 0")
def q_sampled(t: Tables) -> DataFrame:
    return files.sampled(t.embeddings.select("vec_id", F.col("vec_id").alias("frame_no")), 25.0).select("vec_id")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey || '.jpg' AS file FROM orders WHERE o_orderstatus = 'F'),
i AS (SELECT o_custkey, array_to_string(list_sort(list(file)), ',') AS files, count(*) AS slides FROM s GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'failed: no codec' WHEN coalesce(slides, 0) > 0 THEN 'ok (' || slides || ')' ELSE 'placeholder' END AS status, coalesce(slides, 0) AS slides, coalesce(files, '') AS files
FROM customer LEFT JOIN i ON o_custkey = c_custkey""")
def q_slide_manifest(t: Tables) -> DataFrame:
    media = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 17 == 0, "no codec").alias("error"))
    images = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file"))
    return slides.slide_manifest(media, images, "c_custkey", "file").withColumn("files", F.array_join("files", ","))


@query("""
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx)::INTEGER AS pos, idx || '.ts' AS file, b AS bytes, sum(b) OVER (PARTITION BY l_orderkey)::BIGINT AS total
FROM (SELECT l_orderkey, l_linenumber AS idx, sum(l_quantity)::BIGINT % 4 AS b FROM lineitem GROUP BY ALL) WHERE b > 0""")
def q_merge_manifest(t: Tables) -> DataFrame:
    segments = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("idx")).agg((F.sum("l_quantity").cast("long") % 4).alias("bytes"))
    return jobs.merge_manifest(segments, "l_orderkey")


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority")
def q_range(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"))


@query("SELECT c_mktsegment, n AS k, c AS v FROM (SELECT c_mktsegment, c_nationkey AS n, count(*) AS c FROM customer GROUP BY ALL)")
def q_counts_map(t: Tables) -> DataFrame:
    return catalog.counts_by(t.customer, "c_mktsegment", "c_nationkey").select("c_mktsegment", F.explode("counts").alias("k", "v"))


@query("SELECT count(*) AS files, count(*) FILTER (contains(o_orderpriority, 'HIGH')) AS succeeded, sum(o_orderkey % 7)::BIGINT AS slides, sum(o_orderkey % 11)::BIGINT AS segments FROM orders")
def q_batch_totals(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return jobs.batch_totals(t.orders.select((k % 7).alias("slides"), (k % 11).alias("segments"), F.col("o_orderpriority").alias("status")), word="HIGH", segments="segments")


@query("""
SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id)[-30:], ',') AS history FROM events GROUP BY user_id""")
def q_last_thirty(t: Tables) -> DataFrame:
    return jobs.last_samples(t.events, ["user_id"], ["ts", "event_id"], "event_id").select("user_id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT unnest([3, 7, 11])) AND p_partkey % 2 = 0 ORDER BY p_partkey")
def q_selection(t: Tables) -> DataFrame:
    chosen = t.part.where("p_size in (3, 7, 11) and p_partkey % 2 = 0").select("p_partkey")
    return catalog.selected(t.part.select("p_partkey", "p_size"), chosen, "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q_retry_selection(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", -1).otherwise(2)
    return jobs.retryable(t.orders.select("o_orderkey", status.alias("status"))).select("o_orderkey")


@query("""
SELECT event_id, CASE WHEN contains(lower(m), 'proxy') THEN 'proxy' WHEN contains(m, 'no session') OR contains(m, 'course id') THEN 'absent' ELSE 'other' END AS class
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'bad course id' WHEN 'view' THEN 'via PROXY, no session' WHEN 'error' THEN 'no session' ELSE event_type END AS m FROM events)""")
def q_fetch_error_class(t: Tables) -> DataFrame:
    e = F.col("event_type")
    message = F.when(e == "click", "bad course id").when(e == "view", "via PROXY, no session").when(e == "error", "no session").otherwise(e)
    return t.events.select("event_id", fn.fetch_error_class(message, ("no session", "course id")).alias("class"))


@query("""
SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 = 0 AS both, p_size * 40 > 1000 AS made, p_size >= 50 AS strict, p_size * 4000 > greatest(1000, p_size % 5 * 3200.0::DOUBLE) AS reusable,
       CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice END AS seconds FROM part""")
def q_reuse(t: Tables) -> DataFrame:
    size = F.col("p_size")
    probe = F.when(size % 4 == 0, F.when(size % 8 == 0, "N/A").otherwise("-1")).otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string")))
    return t.part.select(
        "p_partkey", fn.reachable(size % 2 == 0, size % 3 == 0).alias("both"), fn.has_output(size * 40).alias("made"), fn.complete(size, F.lit(50), strict=True).alias("strict"),
        fn.reusable_audio(size * 4000, size % 5).alias("reusable"), fn.probed_duration(probe).alias("seconds"))


@query("""
SELECT p_partkey::VARCHAR AS course_id, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS course_name, '' AS professor, p_brand AS last_used, CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END AS count
FROM part WHERE p_size % 5 <> 0 AND p_partkey <> 7""")
def q_history_clean(t: Tables) -> DataFrame:
    size = F.col("p_size")
    rows = t.part.select(
        F.when(size % 5 == 0, F.when(size % 2 == 0, "  ")).otherwise(F.col("p_partkey").cast("string")).alias("course_id"), F.when(size % 2 == 1, F.col("p_name")).alias("course_name"),
        F.lit(None).cast("string").alias("professor"), F.col("p_brand").alias("last_used"), F.when(size % 3 == 0, F.when(size % 2 == 0, F.lit(0))).otherwise(size).alias("count"))
    kept = jobs.without(jobs.cleaned_history(rows), "course_id", " 7 ")
    return kept.unionByName(jobs.cleared(kept))


@query("SELECT c_name FROM customer ORDER BY c_name")
def q_name_order(t: Tables) -> DataFrame:
    return catalog.by_name(t.customer.select("c_name"), "c_name")


@query("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region WHERE r_regionkey < 3")
def q_set_union(t: Tables) -> DataFrame:
    return catalog.extensions(t.nation.select(F.col("n_regionkey").alias("k")), t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("k")))


def _words(first: str) -> Column:
    return F.array(F.col(first).cast("long"), F.col("p_size").cast("long"))


@query("""
SELECT p_partkey, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', floor(s / 3600)::INTEGER, floor(s % 3600 / 60)::INTEGER, floor(s % 60)::INTEGER) ELSE printf('%02d:%02d', floor(s / 60)::INTEGER, floor(s % 60)::INTEGER) END AS clock,
  1 - (bit_count(xor(p_partkey::BIGINT, 5::BIGINT)) + bit_count(xor(p_size::BIGINT, 9::BIGINT))) / 128.0::DOUBLE AS similarity
FROM (SELECT *, p_retailprice * 3 AS s FROM part)""")
def q_clock_similarity(t: Tables) -> DataFrame:
    other = F.array(F.lit(5).cast("long"), F.lit(9).cast("long"))
    return t.part.select("p_partkey", fn.clock_time(F.col("p_retailprice") * 3).alias("clock"), fn.similarity(_words("p_partkey"), other).alias("similarity"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type, value)) AS event_type, arg_max(value, (ts, event_type, value)) AS value FROM events GROUP BY user_id")
def q_latest(t: Tables) -> DataFrame:
    return progress.latest(t.events, "user_id", "ts", "event_type", "value")


@query("""
SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS begin, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS "end", count(*) AS events
FROM events GROUP BY ALL""")
def q_windows(t: Tables) -> DataFrame:
    return progress.windowed(t.events, "ts", "6 hours", None, "event_type")


@query("""
WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000, FALSE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS events, min(ts) AS begin, max(ts) AS last FROM s GROUP BY user_id, k""")
def q_activity(t: Tables) -> DataFrame:
    return progress.activity(t.events, "user_id", "ts", 43200)
