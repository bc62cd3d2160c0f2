"""Order-dependent, transcript and slide queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import slides, transcript
from ..operators import timeline as ops
from .base import Tables, query

SECONDS = "epoch_us(ts) / 1000000.0::DOUBLE"


def _timed(t: Tables) -> DataFrame:
    return t.events.withColumn("s", ops.micros("ts") / 1000000.0)


def _sign_word(bits: int = 63) -> Column:
    """The first ``bits`` signs of a vector as one long; bit 63 stays clear, as SQL engines differ there."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda w, i: F.when(F.get("embedding", i) > 0, w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(w))


SIGN_SQL = "list_reduce(list_prepend(0::BIGINT, [CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END for i in range(0, 63)]), lambda a, b: a | b)"


@query("""
WITH g AS (SELECT user_id, event_id, value, value - lag(value) OVER w AS gap, row_number() OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, gap, "at" FROM (SELECT user_id, gap, value AS "at", row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, p) AS n FROM g WHERE gap > 0) WHERE n = 1""")
def q_gap_max(t: Tables) -> DataFrame:
    return ops.largest_gap(t.events, ["user_id"], ["ts", "event_id"], "value", "value")


@query(f"""
WITH k AS (SELECT user_id, ts, event_id, {SECONDS} AS s, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, s, lead(s) OVER w - s AS d, row_number() OVER w AS n FROM k WHERE n = 1 OR event_type IS DISTINCT FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(d, -1) DESC, n) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM c)
SELECT user_id, CASE WHEN m < 2 THEN 0 ELSE round(d, 1) END AS stall, CASE WHEN m < 2 THEN 0 ELSE round(s, 1) END AS at FROM r WHERE k = 1""")
def q_stall(t: Tables) -> DataFrame:
    return ops.longest_stall(_timed(t), ["user_id"], ["ts", "event_id"], "s", "event_type")


@query("SELECT user_id, min(ts) AS first_progress FROM events WHERE value > 10 GROUP BY user_id")
def q_first_progress(t: Tables) -> DataFrame:
    return t.events.where("value > 10").groupBy("user_id").agg(F.min("ts").alias("first_progress"))


@query(f"""
WITH g AS (SELECT event_id, ts, {SECONDS} - lag({SECONDS}) OVER (ORDER BY ts, event_id) > 180 AS n FROM events)
SELECT event_id, coalesce(sum(n::INTEGER) OVER (ORDER BY ts, event_id), 0)::BIGINT AS session FROM g""")
def q_idle_sessions(t: Tables) -> DataFrame:
    return ops.idle_sessions(_timed(t).select("event_id", "ts", "s"), [], ["ts", "event_id"], F.col("s")).select("event_id", "session")


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, {SECONDS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, event_id, s, n, s AS kept, TRUE AS take FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.s, e.n, CASE WHEN e.s - k.kept >= 43200 THEN e.s ELSE k.kept END, e.s - k.kept >= 43200 FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
SELECT user_id, event_id FROM k WHERE take""")
def q_min_interval(t: Tables) -> DataFrame:
    return ops.spaced(_timed(t), ["user_id"], ["s", "event_id"], "s", 43200.0, "event_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events),
k AS (SELECT user_id, event_id, n, total, CASE WHEN n >= 5 OR n = total THEN n ELSE 0 END AS last, n >= 5 OR n = total AS take FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, e.total, CASE WHEN e.n >= k.last + 5 OR e.n = e.total THEN e.n ELSE k.last END, e.n >= k.last + 5 OR e.n = e.total
  FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
SELECT user_id, event_id, n AS done FROM k WHERE take""")
def q_throttle(t: Tables) -> DataFrame:
    numbered = ops.numbered(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "done", "total")
    return ops.throttled(numbered, ["user_id"], "done", "total", 5, "event_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, n, CASE WHEN ok THEN 17 ELSE 14 END AS w FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN e.ok THEN least(k.w + 1, 64) ELSE greatest(k.w - 2, 4) END FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
SELECT user_id, max(w) AS top, min(w) AS low, arg_max(w, n) AS last FROM k GROUP BY user_id""")
def q_aimd(t: Tables) -> DataFrame:
    rows = _timed(t).select("user_id", "s", "event_id", (F.col("event_type") != "error").alias("ok"))
    sizes = ops.windows(rows, ["user_id"], ["s", "event_id"], "ok")
    return sizes.groupBy("user_id").agg(F.max("size").alias("top"), F.min("size").alias("low"), F.max_by("size", "pos").alias("last"))


@query(f"""
WITH RECURSIVE e AS (SELECT label, vec_id, {SIGN_SQL} AS w, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
k AS (SELECT label, vec_id, n, w AS kept, TRUE AS take FROM e WHERE n = 1
  UNION ALL SELECT e.label, e.vec_id, e.n, CASE WHEN bit_count(xor(e.w, k.kept)) > 25 THEN e.w ELSE k.kept END, bit_count(xor(e.w, k.kept)) > 25 FROM k JOIN e ON e.label = k.label AND e.n = k.n + 1)
SELECT label, vec_id FROM k WHERE take""")
def q_phash_dedup(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", _sign_word().alias("w"))
    return ops.unlike(rows, ["label"], ["vec_id"], "w", 25, "vec_id")


@query(f"""
WITH RECURSIVE e AS (SELECT label, vec_id, {SIGN_SQL} AS w, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
k AS (SELECT label, vec_id, n, [w] AS kept, TRUE AS take FROM e WHERE n = 1
  UNION ALL SELECT label, vec_id, n, CASE WHEN fresh THEN (kept || [w])[-5:] ELSE kept END, fresh FROM (
    SELECT e.label, e.vec_id, e.n, e.w, k.kept, len([x for x in k.kept if bit_count(xor(e.w, x)) <= 24]) = 0 AS fresh FROM k JOIN e ON e.label = k.label AND e.n = k.n + 1))
SELECT label, vec_id FROM k WHERE take""")
def q_recent5(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", _sign_word().alias("w"))
    return ops.unlike(rows, ["label"], ["vec_id"], "w", 24, "vec_id", 5)


def _frames(t: Tables) -> DataFrame:
    """A frame relation: vectors repeat within runs of seven, so there are stable stretches and changing ones."""
    v = t.embeddings.select("label", "vec_id", _sign_word().alias("w"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    word = F.when(F.col("vec_id") % 4 == 0, F.col("w").bitwiseXOR(F.col("i").cast("long") * 1048575)).otherwise(F.col("w"))
    return v.select("label", (F.col("vec_id") * 8 + F.col("i")).cast("double").alias("ts"), word.alias("w"))


FRAMES_SQL = f"""v AS (SELECT label, vec_id, {SIGN_SQL} AS w, unnest(range(0, 7)) AS i FROM embeddings),
f AS (SELECT label, (vec_id * 8 + i)::DOUBLE AS ts, CASE WHEN vec_id % 4 = 0 THEN xor(w, i * 1048575) ELSE w END AS w FROM v)"""


@query(f"""
WITH RECURSIVE {FRAMES_SQL},
n AS (SELECT label, ts, w, row_number() OVER (PARTITION BY label ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY label) AS total FROM f),
-- seen: the hash compared against; flags: the last six changes; video: in a passage; wait, calm: the slide that waits and its calm samples; last: place of the last slide.
m AS (
  SELECT label, -1::BIGINT AS i, NULL::BIGINT AS seen, []::BOOLEAN[] AS flags, FALSE AS video, NULL::DOUBLE AS wait, 0 AS calm, -6::BIGINT AS last, NULL::DOUBLE AS taken FROM (SELECT DISTINCT label FROM n)
  UNION ALL
  SELECT label, i,
    CASE WHEN video THEN seen WHEN wait1 IS NULL THEN w WHEN NOT changed AND calm1 >= 4 THEN w ELSE seen END,
    flags, video,
    CASE WHEN video OR wait1 IS NULL THEN NULL WHEN changed THEN ts WHEN calm1 >= 4 THEN NULL ELSE wait1 END,
    CASE WHEN video OR wait1 IS NULL THEN 0 WHEN changed THEN 0 WHEN calm1 >= 4 THEN 0 ELSE calm1 END,
    CASE WHEN take THEN i ELSE last END,
    CASE WHEN take THEN (CASE WHEN wait1 IS NULL THEN ts ELSE wait1 END) END
  FROM (
    SELECT *, NOT video AND (CASE WHEN wait1 IS NULL THEN seen IS NULL OR (changed AND spaced) ELSE NOT changed AND calm1 >= 4 AND spaced END) AS take FROM (
      SELECT *, CASE WHEN opened THEN ts ELSE wait END AS wait1, (CASE WHEN opened THEN 1 ELSE calm END) + (CASE WHEN changed THEN 0 ELSE 1 END) AS calm1, i - last >= 6 AS spaced FROM (
        SELECT *, len(flags) = 6 AND video0 AND NOT video AS opened FROM (
          SELECT *, CASE WHEN len(flags) = 6 THEN len(list_filter(flags, lambda x: x)) / 6.0::DOUBLE >= 0.7 ELSE video0 END AS video FROM (
            SELECT *, (flags0 || [changed])[-6:] AS flags FROM (
              SELECT n.label, n.i, n.ts, n.w, m.seen, m.flags AS flags0, m.video AS video0, m.wait, m.calm, m.last,
                     coalesce(1 - bit_count(xor(n.w, m.seen)) / 63.0::DOUBLE < 0.92, FALSE) AS changed
              FROM m JOIN n ON n.label = m.label AND n.i = m.i + 1))))))
)
SELECT label, taken AS ts FROM m WHERE taken IS NOT NULL""")
def q_video_segment(t: Tables) -> DataFrame:
    return slides.keyframes(_frames(t), "label", "ts", "w", 63)


@query(f"""
WITH v AS (SELECT label, vec_id, {SIGN_SQL} AS w, unnest(range(0, 7)) AS i FROM embeddings),
f AS (SELECT label, (vec_id * 8 + i)::DOUBLE AS ts, CASE WHEN vec_id % 4 = 0 THEN xor(w, i * 1048575) ELSE w END AS w FROM v),
c AS (SELECT label, ts, coalesce((1 - bit_count(xor(w, lag(w) OVER p)) / 63.0::DOUBLE < 0.92)::INTEGER, 0) AS changed FROM f WINDOW p AS (PARTITION BY label ORDER BY ts))
SELECT label, ts, changed, count(*) OVER q = 6 AND sum(changed) OVER q / 6.0::DOUBLE >= 0.7 AS in_video FROM c WINDOW q AS (PARTITION BY label ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def q_change_ratio(t: Tables) -> DataFrame:
    return slides.change_ratio(_frames(t), "label", "ts", "w", 63).select("label", "ts", "changed", "in_video")


@query("""
SELECT label, vec_id, n AS slide, printf('%d_slide_%03d_%02dm%02ds.jpg', label, n, (vec_id // 60)::INTEGER, (vec_id % 60)::INTEGER) AS file
FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)""")
def q_slide_names(t: Tables) -> DataFrame:
    return slides.slide_names(t.embeddings.select("label", "vec_id"), "label", "vec_id").select("label", "vec_id", "slide", "file")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[0-9.]+$') OR length(line) <= 3) AS short_lines, count(*) FILTER (regexp_matches(line, '^[0-9.]+$') OR length(line) <= 3) > 3 AS suspect
FROM l GROUP BY doc_id""")
def q_line_quality(t: Tables) -> DataFrame:
    from ..functions.scalars import is_short_line

    lines = F.split("text", "\n", -1)
    counted = t.documents.select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, is_short_line)).cast("long").alias("short_lines"))
    return counted.withColumn("suspect", F.col("short_lines") > 3)


def _segments(t: Tables) -> DataFrame:
    """Turns as transcript segments: a turn starts at turn * 37 seconds and lasts 35, the 90th minute long past."""
    start = F.col("turn") * 37.25 + 5000
    return t.conversations.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), start.alias("start"), (start + 35.5).alias("end"), F.regexp_replace("text", "\n", " ").alias("text"))


MMSS = "printf('%02d:%02d', floor(({0}) / 60)::INTEGER, floor(({0}) % 60)::INTEGER)"
START, END = "(turn * 37.25::DOUBLE + 5000)", "(turn * 37.25::DOUBLE + 5035.5)"


@query(f"""
SELECT conv_id AS media_id, floor({START})::INTEGER AS start, floor({END})::INTEGER AS "end", replace(text, chr(10), ' ') AS text, turn AS pos FROM conversations WHERE turn < 4""")
def q_parse_lines(t: Tables) -> DataFrame:
    from ..functions.scalars import minute_time

    s = _segments(t)
    line = F.when(F.col("pos") == 4, "=====").otherwise(F.concat(F.lit("["), minute_time(F.col("start")), F.lit("-"), minute_time(F.col("end")), F.lit("] "), F.col("text")))
    return transcript.parse_lines(s.select("media_id", "pos", line.alias("line")))


@query("SELECT conv_id, turn, role FROM conversations c WHERE turn < coalesce((SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND role = 'assistant'), 1000000)")
def q_prefix_until(t: Tables) -> DataFrame:
    return ops.until(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "assistant")


@query(f"""
SELECT conv_id AS media_id, string_agg('[' || {MMSS.format(START)} || '-' || {MMSS.format(END)} || '] ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) || chr(10) || repeat('=', 50) || chr(10)
  || string_agg(replace(text, chr(10), ' '), ' ' ORDER BY turn) AS body FROM conversations GROUP BY conv_id""")
def q_txt(t: Tables) -> DataFrame:
    return transcript.to_txt(_segments(t))


SRT_TIME = "printf('%02d:%02d:%02d,%03d', floor(({0}) / 3600)::INTEGER, floor((({0}) % 3600) / 60)::INTEGER, floor(({0}) % 60)::INTEGER, floor((({0}) % 1) * 1000)::INTEGER)"


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id AS media_id, string_agg(i || chr(10) || {SRT_TIME.format(START)} || ' --> ' || {SRT_TIME.format(END)} || chr(10) || replace(text, chr(10), ' ') || chr(10), chr(10) ORDER BY turn) AS body
FROM n GROUP BY conv_id""")
def q_srt(t: Tables) -> DataFrame:
    return transcript.to_srt(_segments(t))


@query("""
SELECT doc_id, c + 1 AS chunk, c * 1200.0::DOUBLE AS "offset", CASE WHEN n_chars >= 1800 THEN least(1200.0::DOUBLE, n_chars - c * 1200.0::DOUBLE) ELSE n_chars::DOUBLE END AS length
FROM (SELECT doc_id, n_chars, unnest(CASE WHEN n_chars >= 1800 THEN range(0, (n_chars + 1199) // 1200) ELSE [0] END) AS c FROM documents)""")
def q_chunks(t: Tables) -> DataFrame:
    return transcript.chunk_plan(t.documents.select("doc_id", "n_chars"), "n_chars").select("doc_id", "chunk", "offset", "length")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a AS start, greatest(a, least(l_quantity + l_discount * 100 + l_linenumber, 40.0::DOUBLE)) AS "end"
FROM (SELECT *, greatest(0.0::DOUBLE, least(l_quantity + l_linenumber, 40.0::DOUBLE)) AS a FROM lineitem)""")
def q_clamp_segments(t: Tables) -> DataFrame:
    from ..functions.scalars import clamp_segment

    s = clamp_segment(F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount") * 100, F.col("l_linenumber"), F.lit(40.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.start", "s.end")


@query("""
WITH c AS (SELECT conv_id, turn, turn * 40 AS a, turn * 40 + length(text) % 60 AS b FROM conversations), g AS (SELECT conv_id, turn, a, a - lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM c)
SELECT conv_id, gap, a AS at FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY gap DESC, turn) AS n FROM g WHERE gap > 0) WHERE n = 1""")
def q_transcript_gap(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", (F.col("turn") * 40).alias("a"), (F.col("turn") * 40 + F.length("text") % 60).alias("b"))
    return ops.largest_gap(c, ["conv_id"], ["turn"], "a", "b")
