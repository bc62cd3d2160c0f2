"""Sources and sinks: what the driver tables give is written to the shared folder and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs
from ..operators.carry import shared_folder
from ..sources import files, playlist, playlist_files, sinks, spool
from .base import Tables, query


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def _text_tree(t: Tables) -> str:
    """Texts in a folder a language; every tenth lies in an output folder, which scans skip."""
    path = _folder(t)
    folder = F.when(F.col("doc_id") % 10 == 0, "slides").otherwise(F.coalesce("lang", F.lit("none")))
    t.documents.select(folder.alias("folder"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("folder").text(path)
    return path


@query("SELECT coalesce(lang, 'none') AS folder, 'txt' AS ext, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents WHERE doc_id % 10 <> 0 GROUP BY 1")
def q_scan_files(t: Tables) -> DataFrame:
    found = files.scan_files(t.spark, _text_tree(t), ("txt",), skip=("slides",))
    return found.groupBy(F.regexp_extract("folder", "folder=([^/]*)$", 1).alias("folder"), "ext").agg(F.sum("length").alias("bytes"))


@query("SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents WHERE doc_id % 10 <> 0 AND lang = 'en'")
def q_scan_flat(t: Tables) -> DataFrame:
    tree = _text_tree(t)
    found = [files.scan_files(t.spark, f"{tree}{p}", ("txt",), recursive=False, skip=("slides",)) for p in ("", "/folder=en")]
    return found[0].union(found[1]).agg(F.sum("length").alias("bytes"))  # the files of one folder, not of those below the root


@query("""
SELECT CAST(user_id AS VARCHAR) AS course_id, course_name, 'unknown' AS professor, strftime(last_used, '%Y-%m-%dT%H:%M:%S') AS last_used, CAST(count AS INTEGER) AS count FROM (
  SELECT user_id, count(*) AS count, max(ts) AS last_used, arg_max(event_type, ts) FILTER (event_type <> '') AS course_name FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 50)""")
def q_history_file(t: Tables) -> DataFrame:
    newest = jobs.history(t.events, "user_id", "ts", course_name="event_type")
    item = F.struct(F.col("user_id").cast("string").alias("course_id"), "course_name", F.lit("unknown").alias("professor"), F.date_format("last_used", "yyyy-MM-dd'T'HH:mm:ss").alias("last_used"), F.col("count").cast("int").alias("count"))
    blank = F.struct(F.lit(" ").alias("course_id"), F.lit("").alias("course_name"), F.lit("").alias("professor"), F.lit("").alias("last_used"), F.lit(1).alias("count"))
    path = _folder(t)
    sinks.write_bodies(newest.agg(F.to_json(F.concat(F.collect_list(item), F.array(blank))).alias("body")), path)  # 50 rows at most
    return files.read_history(t.spark, path).select("course_id", "course_name", "professor", "last_used", "count")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def q_id_list(t: Tables) -> DataFrame:
    path, key = _folder(t), F.col("c_custkey")
    line = F.when(key % 7 == 0, F.concat(F.lit("# "), key.cast("string"))).when(key % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), key.cast("string")))
    sinks.write_bodies(t.customer.select(line.alias("body")), path)
    return files.read_ids(t.spark, path)


@query("""
SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS pos, event_id || ' ' || event_type AS line FROM events WINDOW w AS (ORDER BY ts DESC, event_id DESC) ORDER BY pos LIMIT 10""")
def q_log_tail(t: Tables) -> DataFrame:
    path = _folder(t)
    rolled = t.events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    sinks.write_bodies(rolled.select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("body")), path)
    return files.log_tail(t.spark, path, 10)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_records(t: Tables) -> DataFrame:
    path, rows = _folder(t), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in (0, 1):  # records are added after each trial
        sinks.write_records(rows.where(F.col("o_orderkey") % 2 == part), path)
    return t.spark.read.schema(rows.schema).json(path)


@query("SELECT c_custkey || ': ' || c_mktsegment AS line FROM customer")
def q_text_dump(t: Tables) -> DataFrame:
    path = _folder(t)
    sinks.write_bodies(t.customer.select(F.concat_ws(": ", F.col("c_custkey").cast("string"), "c_mktsegment").alias("body")), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("""
WITH m AS (SELECT event_type, (list_sort(list(value)))[len(list(value)) // 2 + 1] AS median, count(*) AS trials FROM events GROUP BY event_type),
r AS (SELECT row_number() OVER (ORDER BY median, event_type) AS n, event_type, trials FROM m)
SELECT 0 AS pos, '| rank | event_type | trials |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT CAST(n + 1 AS INTEGER), '| ' || n || ' | ' || event_type || ' | ' || trials || ' |' FROM r""")
def q_report(t: Tables) -> DataFrame:
    ranked = jobs.rank_trials(t.events, ["event_type"], F.col("value")).orderBy("rank").select("rank", "event_type", "trials")
    lines = sinks.markdown(ranked).split("\n")  # one line a configuration
    return t.spark.createDataFrame(list(enumerate(lines)), "pos int, line string")


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id AS INTEGER) AS done FROM events")
def q_spool(t: Tables) -> DataFrame:
    """Events as a queue of JSON lines, drained in steps of at most 50,000 rows."""
    path = _folder(t)
    item = F.to_json(F.struct(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("done")))
    sinks.write_bodies(t.events.select(item.alias("body")), f"{path}/in")
    stream = spool.read_spool(t.spark, f"{path}/in", 50_000).select("job_id", "done").writeStream.format("parquet")
    q = stream.option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.read.schema("job_id string, done int").parquet(f"{path}/out")


#: Links of a page, in order; the playlist ends after four of them, what follows the end mark does not count.
LINKS_SQL = """l AS (SELECT page_id, unnest(h) AS link, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
s AS (SELECT page_id, link, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx FROM l WHERE pos <= 4 AND link <> '' AND NOT starts_with(link, '#'))"""


def _playlist_lines(t: Tables) -> DataFrame:
    """A playlist file a page, with the links of its html as segments, read back by the playlist source."""
    path, links = _folder(t), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    lines = F.transform(links, lambda x, i: F.concat(F.lit("#EXTINF:4,\r\n"), x, F.when(i == 3, "\r\n\r\n#EXT-X-ENDLIST").otherwise("")))
    text = F.concat(F.lit("#EXTM3U\r\n"), F.array_join(lines, "\r\n"), F.lit("\n"))
    playlist_files.write_playlists(t.pages.select(F.col("page_id").cast("string").alias("playlist_id"), text.alias("text")), path)
    return playlist_files.read_playlists(t.spark, path, "https://files.example")


@query(f"""
WITH {LINKS_SQL}
SELECT CAST(page_id AS VARCHAR) AS playlist_id, CAST(idx AS INTEGER) AS idx,
  CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN starts_with(link, '/') THEN 'https://files.example' || link ELSE 'https://files.example/' || link END AS url FROM s""")
def q_playlist_files(t: Tables) -> DataFrame:
    return playlist.segments(_playlist_lines(t))


@query(f"""
WITH {LINKS_SQL}
SELECT CAST(page_id AS VARCHAR) AS playlist_id, '#EXTM3U' || chr(10) || string_agg('#EXTINF:4,' || chr(10) || idx || '.ts', chr(10) ORDER BY pos) || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS text
FROM s WHERE page_id % 2 = 0 GROUP BY page_id""")
def q_playlist_local(t: Tables) -> DataFrame:
    return playlist.rewritten(_playlist_lines(t).where(F.col("playlist_id").cast("long") % 2 == 0))
