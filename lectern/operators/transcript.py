"""Transcript rules: line parsing, quality flags, chunk plans and the TXT and SRT forms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp_segment, is_short_line, minute_time, srt_time, strip, transcript_line
from .timeline import largest_gap, until

SUSPECT_LINES, LONG_BREAK, CHUNK_FROM, CHUNK = 100, 300, 1800.0, 1200.0


def parse_lines(lines: DataFrame, key: str = "media_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """(key, pos, start, end, text) of the lines before the first that starts with ``=``; others are dropped."""
    head = until(lines, [key], pos, F.col(line).startswith("="))
    return head.withColumn("_p", transcript_line(F.col(line))).where("_p is not null").select(key, pos, "_p.start", "_p.end", "_p.text")


def quality(segments: DataFrame, key: str = "media_id", pos: str = "pos") -> DataFrame:
    """Per transcript: short lines, largest gap and where, suspect (> 100 short) and long break (> 300 s, not suspect)."""
    short = segments.groupBy(key).agg(F.count_if(is_short_line(strip(F.col("text")))).alias("short_lines"), F.count("*").alias("lines"))
    out = short.join(largest_gap(segments, [key], [pos], "start", "end").withColumnsRenamed({"at": "gap_at"}), key, "left")
    suspect = F.col("short_lines") > SUSPECT_LINES
    return out.select(
        key, "lines", "short_lines", F.coalesce("gap", F.lit(0)).alias("max_gap"), F.coalesce("gap_at", F.lit(0)).alias("gap_at"), suspect.alias("suspect"),
        (~suspect & (F.coalesce("gap", F.lit(0)) > LONG_BREAK)).alias("long_break"))


def chunk_plan(media: DataFrame, duration: str = "duration") -> DataFrame:
    """``media`` with one row a chunk: chunk from 1, offset, length; below the limit one chunk of all."""
    d = F.col(duration).cast("double")
    offsets = F.when(d >= CHUNK_FROM, F.filter(F.transform(F.sequence(F.lit(0), F.floor(d / CHUNK).cast("int")), lambda i: i * CHUNK), lambda o: o < d)).otherwise(F.array(F.lit(0.0)))
    rows = media.select("*", F.posexplode(offsets).alias("_i", "offset"))
    return rows.withColumn("chunk", F.col("_i") + 1).withColumn("length", F.when(d >= CHUNK_FROM, F.least(F.lit(CHUNK), d - F.col("offset"))).otherwise(d)).drop("_i")


def transcribe(
    chunks: DataFrame, load: Callable[[], Callable[[str, float, float], Iterable[tuple[float, float, str]]]], key: str = "media_id", source: str = "source", duration: str = "duration"
) -> DataFrame:
    """(key, chunk, seq, start, end, text) that a speech recogniser finds in the rows of :func:`chunk_plan`.

    ``load`` runs once a task and gives a function of (source, offset, length) that yields (start, end, text) in seconds
    of the chunk. Times are moved by the offset and kept within the medium; texts are stripped and blank ones dropped.
    """
    kind = dict(chunks.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = load()
        for pdf in batches:
            rows = [
                (row.key, row.chunk, row.offset, row.duration, i, float(a), float(b), text)
                for row in pdf.itertuples(index=False) for i, (a, b, text) in enumerate(recognise(row.source, row.offset, row.length))]
            yield pd.DataFrame(rows, columns=["key", "chunk", "offset", "duration", "seq", "a", "b", "text"])

    asked = chunks.select(F.col(key).alias("key"), F.col("chunk").cast("int"), "offset", "length", F.col(duration).cast("double").alias("duration"), F.col(source).alias("source"))
    heard = asked.mapInPandas(run, f"key {kind}, chunk int, offset double, duration double, seq int, a double, b double, text string")
    placed = heard.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("_at", clamp_segment(F.col("a"), F.col("b"), F.col("offset"), F.col("duration")))
    return placed.select(F.col("key").alias(key), "chunk", "seq", "_at.start", "_at.end", "text")


def _joined(segments: DataFrame, key: str, pos: str, item: Column, sep: str) -> DataFrame:
    rows = segments.withColumn("_item", item)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("_item")))), lambda x: x["_item"]), sep).alias("body"))


def to_txt(segments: DataFrame, key: str = "media_id", pos: str = "pos", ruler: str = "=" * 50) -> DataFrame:
    """Timed lines, a ruler, then the plain text."""
    timed = _joined(segments, key, pos, F.concat(F.lit("["), minute_time(F.col("start")), F.lit("-"), minute_time(F.col("end")), F.lit("] "), F.col("text")), "\n")
    plain = _joined(segments, key, pos, F.col("text"), " ").withColumnRenamed("body", "plain")
    return timed.join(plain, key).select(key, F.concat("body", F.lit("\n" + ruler + "\n"), "plain").alias("body"))


def to_srt(segments: DataFrame, key: str = "media_id", pos: str = "pos") -> DataFrame:
    """Numbered blocks from 1 with comma milliseconds."""
    rows = segments.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos)))
    block = F.concat_ws("\n", F.col("_n").cast("string"), F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end"))), F.col("text"), F.lit(""))
    return _joined(rows, key, pos, block, "\n")
