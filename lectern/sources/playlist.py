"""HLS playlists as relations of lines.

Blank lines are skipped, a comment is a line that starts with ``#``, lines after the end mark are ignored. Of a master
playlist ``policy`` takes the variant of the highest bandwidth (``best``: first on ties, none without a bandwidth), the
``first`` or the ``last``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bandwidth, key_uri, resolve_url
from ..operators.timeline import until

END, STREAM, KEY = "#EXT-X-ENDLIST", "#EXT-X-STREAM-INF", "#EXT-X-KEY"


def playlist_lines(playlists: DataFrame, text: str = "text") -> DataFrame:
    """(playlist_id, base_url, pos, line) of the trimmed lines that are not blank."""
    rows = playlists.select("playlist_id", "base_url", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", "\r", ""))).where("line <> ''")


def variants(lines: DataFrame, policy: str = "best") -> DataFrame:
    """(playlist_id, url, bandwidth) of the variant chosen from each master playlist."""
    w = Window.partitionBy("playlist_id").orderBy("pos")
    ahead = lines.withColumn("_1", F.lead("line", 1).over(w)).withColumn("_2", F.lead("line", 2).over(w)).where(F.col("line").startswith(STREAM))
    plain = lambda c: F.when(~F.col(c).startswith("#"), F.col(c))
    found = ahead.withColumn("link", F.coalesce(plain("_1"), plain("_2"))).withColumn("bandwidth", bandwidth(F.col("line"))).where("link is not null")
    if policy == "best":
        found, order = found.where("bandwidth > 0"), [F.desc("bandwidth"), F.asc("pos")]
    else:
        order = [F.asc("pos") if policy == "first" else F.desc("pos")]
    chosen = found.withColumn("_n", F.row_number().over(Window.partitionBy("playlist_id").orderBy(*order))).where("_n = 1")
    return chosen.select("playlist_id", resolve_url(F.col("base_url"), F.col("link")).alias("url"), "bandwidth")


def resolved(lines: DataFrame, links: DataFrame, policy: str = "best", nesting: int = 5) -> DataFrame:
    """(playlist_id, url, depth): the media playlist that each playlist leads to.

    ``links`` gives the id behind a url (url, target). Masters may lead to masters; a chain of more than ``nesting``
    has no answer. Each round is one join, for all playlists at once.
    """
    step = variants(lines, policy).join(links, "url").select("playlist_id", "url", "target")
    masters = step.select(F.col("playlist_id").alias("master")).distinct()
    at = step
    out = None
    for depth in range(1, nesting + 1):
        ended = at.join(masters, at["target"] == masters["master"], "left_anti").select("playlist_id", "url", F.lit(depth).alias("depth"))
        out = ended if out is None else out.unionByName(ended)
        further = step.select(F.col("playlist_id").alias("target"), F.col("url").alias("url2"), F.col("target").alias("target2"))
        at = at.join(further, "target").select("playlist_id", F.col("url2").alias("url"), F.col("target2").alias("target"))
    return out


def segments(lines: DataFrame) -> DataFrame:
    """(playlist_id, idx, url) of a media playlist's segments, idx from 0."""
    rows = until(lines, ["playlist_id"], "pos", F.col("line").startswith(END)).where(~F.col("line").startswith("#"))
    return rows.select("playlist_id", (F.row_number().over(Window.partitionBy("playlist_id").orderBy("pos")) - 1).alias("idx"), resolve_url(F.col("base_url"), F.col("line")).alias("url"))


def rewritten(lines: DataFrame, key_name: str = "key.m3u8key") -> DataFrame:
    """(playlist_id, text) of the local playlist: segments become ``<idx>.ts``, the key line points to a local file."""
    rows = until(lines, ["playlist_id"], "pos", F.col("line").startswith(END))
    w = Window.partitionBy("playlist_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    comment = F.col("line").startswith("#")
    local = F.when(F.col("line").startswith(KEY), F.replace("line", key_uri(F.col("line")), F.lit(key_name))).when(comment, F.col("line"))
    rows = rows.withColumn("_s", F.coalesce(local, F.concat((F.sum((~comment).cast("int")).over(w) - 1).cast("string"), F.lit(".ts"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_s"))), lambda x: x["_s"]), "\n")
    return rows.groupBy("playlist_id").agg(F.concat(body, F.lit(f"\n{END}\n")).alias("text"))
