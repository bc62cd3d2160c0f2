"""Catalog, predicate, join and aggregate queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import catalog as ops
from ..operators import jobs
from ..operators.carry import shared_folder
from ..sources.sinks import upsert_history
from .base import Tables, query

LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("""
WITH m AS (SELECT event_type, (list_sort(list(value)))[len(list(value)) // 2 + 1] AS median, count(*) AS trials FROM events GROUP BY event_type)
SELECT event_type, median, trials, row_number() OVER w AS rank, CASE WHEN first(median) OVER w > 0 THEN round(median / first(median) OVER w, 2) END AS ratio
FROM m WINDOW w AS (ORDER BY median, event_type)""")
def q_rank_upper_median(t: Tables) -> DataFrame:
    return jobs.rank_trials(t.events, ["event_type"], F.col("value"))


@query(f"""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS n FROM lineitem) WHERE n = 1""")
def q_keep_first(t: Tables) -> DataFrame:
    return ops.keep_first(t.lineitem, ["l_orderkey", "l_linenumber"], LINE_ORDER)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_missing_outputs(t: Tables) -> DataFrame:
    return ops.missing(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""
SELECT c_custkey, c_mktsegment FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1)""")
def q_or_anti(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_mktsegment")
    return ops.missing_by_either(c, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), c.where("c_custkey = 1").select("c_mktsegment"), "c_custkey", "c_mktsegment")


@query("""
WITH got AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS got FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'downloading' ELSE 'merging' END AS status, coalesce(got, 0) AS got,
       CASE WHEN coalesce(got, 0) >= 4 THEN 'DONE' ELSE 'MISSING ' || (4 - coalesce(got, 0)) END AS verdict
FROM orders LEFT JOIN got ON l_orderkey = o_orderkey""")
def q_status(t: Tables) -> DataFrame:
    got = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_linenumber").alias("got"))
    n = F.coalesce("got", F.lit(0))
    code = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 0).otherwise(1)
    return t.orders.join(got, "o_orderkey", "left").select(
        "o_orderkey", fn.status_label(code).alias("status"), n.alias("got"), F.when(n >= 4, "DONE").otherwise(F.concat(F.lit("MISSING "), (4 - n).cast("string"))).alias("verdict"))


@query("""
SELECT *, (n_F >= n_O AND n_P >= n_O) AS done FROM (
  SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'P') AS n_P
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey))""")
def q_inventory_rollup(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    out = ops.inventory(rows, "c_nationkey", "o_orderstatus", ["O", "F", "P"])
    return out.withColumn("done", ops.done_flag(F.col("n_O"), F.col("n_F"), F.col("n_P")))


@query("""
SELECT doc_id, n_chars * 512 >= 1048576 AND n_chars / 50.0 >= 30.0 AS healthy, n_chars * 512 >= 1048576 AS size_ok, n_chars * 512 > 1048576 AS size_above FROM documents""")
def q_health(t: Tables) -> DataFrame:
    size = F.col("n_chars") * 512
    return t.documents.select("doc_id", fn.healthy(size, F.col("n_chars") / 50.0).alias("healthy"), (size >= fn.MIN_HEALTHY_BYTES).alias("size_ok"), (size > fn.MIN_HEALTHY_BYTES).alias("size_above"))


@query("""
SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, ''), nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), '') AS url FROM orders""")
def q_url_choice(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", fn.first_url(F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.when(k % 2 == 0, "").otherwise(F.col("o_orderstatus"))).alias("url"))


@query("""
WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'read timed out' WHEN 'view' THEN 'ProxyError: refused' WHEN 'error' THEN 'bad Certificate' ELSE event_type END AS msg FROM events)
SELECT event_id, CASE WHEN contains(msg, 'ProxyError') OR contains(lower(msg), 'proxy') THEN 'proxy' WHEN contains(lower(msg), 'timeout') OR contains(lower(msg), 'timed out') THEN 'timeout'
  WHEN contains(msg, 'SSLError') OR contains(lower(msg), 'certificate') THEN 'ssl' ELSE 'other' END AS class,
  CASE 400 + event_id % 6 WHEN 403 THEN 'token may be expired' WHEN 404 THEN 'video missing or deleted' ELSE '' END AS hint FROM m""")
def q_error_class(t: Tables) -> DataFrame:
    e = F.col("event_type")
    msg = F.when(e == "click", "read timed out").when(e == "view", "ProxyError: refused").when(e == "error", "bad Certificate").otherwise(e)
    return t.events.select("event_id", fn.error_class(msg).alias("class"), fn.http_hint(400 + F.col("event_id") % 6).alias("hint"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ok' WHEN event_id % 5 = 1 THEN 'neterr' WHEN event_id % 5 = 2 THEN CASE WHEN user_id % 2 = 0 THEN 'waf-proxy' ELSE 'waf-token' END
  WHEN event_id % 5 = 3 THEN 'unauth' ELSE 'unknown' END AS state FROM events""")
def q_probe_state(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    return t.events.select("event_id", fn.probe_state(
        k == 0, F.when(k == 1, "no route"), F.when(k == 2, 777).otherwise(0), F.when(k == 3, 401).otherwise(200), F.col("user_id") % 2 == 0, 777).alias("state"))


@query("SELECT p_partkey, greatest(4, least(p_size, 32)) AS workers, p_size >= 0.95 * 50 AS gate FROM part")
def q_clamp(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.clamp(F.col("p_size")).alias("workers"), fn.complete(F.col("p_size"), F.lit(50)).alias("gate"))


@query("""
WITH s AS (SELECT user_id, event_id, value / 1000.0 AS score FROM events), m AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS top FROM s)
SELECT user_id, event_id, score FROM m WHERE score > 0.1 OR (top <= 0.1 AND score > 0.05)""")
def q_scene_threshold(t: Tables) -> DataFrame:
    from ..operators.slides import scene_cuts

    return scene_cuts(t.events.select("user_id", "event_id", (F.col("value") / 1000.0).alias("score")), "user_id")


@query("""
SELECT vec_id, round(var_pop(x) * 40000, 4) AS variance, var_pop(x) * 40000 > 500 AS shown FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def q_blank_filter(t: Tables) -> DataFrame:
    from ..operators.slides import not_blank

    v = t.embeddings.select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg((F.var_pop(F.col("x").cast("double")) * 40000).alias("v"))
    return v.select("vec_id", F.round("v", 4).alias("variance"), not_blank(F.col("v")).alias("shown"))


@query("SELECT page_id, regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[0-9]+$') AS numeric_id FROM pages")
def q_numeric_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", fn.basename(F.col("url")).rlike("^[0-9]+$").alias("numeric_id"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 1 AND (contains(p_type, 'BRASS') OR ends_with(p_brand, '1'))")
def q_course_filter(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_partkey") % 2 == 1) & (F.col("p_type").contains("BRASS") | F.col("p_brand").endswith("1"))).select("p_partkey", "p_name")


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events, (SELECT max(ts) AS top FROM events) WHERE ts >= top - INTERVAL 1 DAY GROUP BY user_id""")
def q_recent(t: Tables) -> DataFrame:
    top = t.events.agg(F.max("ts").alias("top"))
    recent = t.events.crossJoin(F.broadcast(top)).where(F.col("ts") >= F.col("top") - F.expr("INTERVAL '1' DAY"))
    return recent.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
SELECT s_suppkey, s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(n_name, 'A') """)
def q_session_search(t: Tables) -> DataFrame:
    n = t.nation.where(F.col("n_name").contains("A")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "r_name")


@query("""
SELECT p_partkey, folder FROM part JOIN (VALUES ('Brand#1', 'one'), ('Brand#2', 'two'), ('Brand#12', 'twelve')) m(prefix, folder) ON starts_with(p_brand, prefix)""")
def q_prefix_map(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([("Brand#1", "one"), ("Brand#2", "two"), ("Brand#12", "twelve")], "prefix string, folder string")
    return ops.prefix_map(t.part, m, "p_brand", "prefix").select("p_partkey", "folder")


@query("SELECT o_orderkey, target FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('X', 'none')) m(o_orderstatus, target) USING (o_orderstatus)")
def q_mapping(t: Tables) -> DataFrame:
    m = t.spark.createDataFrame([("F", "finished"), ("O", "open"), ("X", "none")], "o_orderstatus string, target string")
    return t.orders.join(F.broadcast(m), "o_orderstatus").select("o_orderkey", "target")


@query("""
SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)""")
def q_backfill(t: Tables) -> DataFrame:
    return ops.backfill(t.lineitem.where("l_linenumber = 1"), t.lineitem.where("l_linenumber = 2"), "l_orderkey")


@query("""
SELECT s.p_partkey, s.p_size FROM part s LEFT JOIN (SELECT p_partkey, p_size + (p_partkey % 5 = 0)::INTEGER AS p_size FROM part WHERE p_partkey % 3 <> 0) t USING (p_partkey)
WHERE t.p_size IS NULL OR t.p_size <> s.p_size""")
def q_copy_plan(t: Tables) -> DataFrame:
    s = t.part.select("p_partkey", "p_size")
    there = s.where("p_partkey % 3 <> 0").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int"))
    return ops.copy_plan(s, there, "p_partkey", "p_size")


@query("SELECT r_name, w AS workers, i AS trial FROM region, (SELECT unnest([4, 8, 16]) AS w), (SELECT unnest(range(1, 4))::INTEGER AS i)")
def q_matrix(t: Tables) -> DataFrame:
    workers = t.spark.createDataFrame([(4,), (8,), (16,)], "workers int")
    trials = t.spark.range(1, 4).select(F.col("id").cast("int").alias("trial"))
    return ops.matrix(t.region.select("r_name"), workers, trials)


@query("""
SELECT user_id, event_id, value, next FROM (SELECT user_id, event_id, value, lead(value) OVER w AS next, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE n % 2 = 1 AND next IS NOT NULL""")
def q_pairs(t: Tables) -> DataFrame:
    return jobs.paired(t.events, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "value", "next")


@query("""
SELECT *, total - present AS failed, present >= 0.95 * total AS complete FROM (
  SELECT l_orderkey, count(*) AS total, count(*) FILTER (b > 0) AS present, coalesce(sum(b) FILTER (b > 0), 0)::BIGINT AS bytes
  FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity::BIGINT END AS b FROM lineitem) GROUP BY l_orderkey)""")
def q_gate(t: Tables) -> DataFrame:
    b = F.when(F.col("l_linenumber") % 4 == 0, F.lit(0)).otherwise(F.col("l_quantity").cast("long"))
    return jobs.completeness(t.lineitem.select("l_orderkey", b.alias("bytes")), "l_orderkey")


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS downloaded, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed,
       min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority""")
def q_counters(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.groupBy("o_orderpriority").agg(n("F").alias("downloaded"), n("O").alias("skipped"), n("P").alias("failed"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT label, string_agg(source_n, ',' ORDER BY source_n) AS counts FROM (SELECT label, (vec_id % 3) || ':' || count(*) AS source_n FROM embeddings GROUP BY label, vec_id % 3) GROUP BY label")
def q_image_counts(t: Tables) -> DataFrame:
    per = t.embeddings.groupBy("label", (F.col("vec_id") % 3).alias("folder")).agg(F.count("*").alias("n")).where("n > 0")
    return per.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("folder").cast("string"), F.col("n").cast("string")))), ",").alias("counts"))


@query("""
SELECT l_suppkey, array_to_string((list_sort(list(DISTINCT l_orderkey)))[1:10], ',') AS first_ten, len(list(DISTINCT l_orderkey)) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey""")
def q_failed_ten(t: Tables) -> DataFrame:
    found = ops.first_keys(t.lineitem.where("l_returnflag = 'R'"), ["l_suppkey"], "l_orderkey")
    return found.select("l_suppkey", F.array_join(F.col("first").cast("array<string>"), ",").alias("first_ten"), "n")


@query("SELECT DISTINCT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey < 3")
def q_set_ops(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_regionkey").alias("k")).distinct().unionAll(t.region.where("r_regionkey < 3").select("r_regionkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def q_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 5 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def q_topk(t: Tables) -> DataFrame:
    return ops.top_by(t.part.where("p_size > 5").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 10)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def q_tail(t: Tables) -> DataFrame:
    return ops.top_by(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 10)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey")
def q_first_segments(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linenumber < 3").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, bool_or(l_returnflag <> 'R') AS ok, count(*) - 1 AS retries FROM lineitem GROUP BY l_orderkey, l_linenumber")
def q_retry_final(t: Tables) -> DataFrame:
    return jobs.final_attempts(t.lineitem, ["l_orderkey", "l_linenumber"], F.col("l_returnflag") != "R")


@query("""
SELECT user_id, count(*) AS count, max(ts) AS last_used, arg_max(event_type, ts) FILTER (event_type <> '') AS course_name FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 50""")
def q_history(t: Tables) -> DataFrame:
    return jobs.history(t.events, "user_id", "ts", course_name="event_type")


@query("""
SELECT user_id, count(*) AS count, max(ts) AS last_used, arg_max(event_type, ts) FILTER (event_type <> '') AS course_name FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 50""")
def q_history_merge(t: Tables) -> DataFrame:
    # Look-ups of every second event are stored; the others are merged into the stored state, whose look-ups aren't read again.
    path = f"{shared_folder(t.spark)}/history-{uuid.uuid4().hex}"
    for part in (0, 1):
        state = upsert_history(t.events.where(F.col("event_id") % 2 == part), path, "user_id", "ts", epoch=part, course_name="event_type")
    return jobs.newest_history(state, "user_id")


@query("""
WITH d AS (SELECT conv_id, turn, '### ' || role || chr(10) || text AS p FROM conversations WHERE trim(text) <> ''), j AS (SELECT conv_id, string_agg(p, chr(10) ORDER BY turn) AS w FROM d GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(w) > 2000 THEN substr(w, 1, 2000) || chr(10) || '...(cut)' ELSE w END AS text FROM j""")
def q_concat_cap(t: Tables) -> DataFrame:
    return ops.concat_capped(t.conversations, ["conv_id"], ["turn"], F.concat(F.lit("### "), F.col("role"), F.lit("\n")), F.col("text"), 2000)
