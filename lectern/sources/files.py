"""File relations: artifact scans, history, id lists, course metadata, logs, transcripts. Only Spark's readers touch paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import AUDIO_EXTENSIONS, VIDEO_EXTENSIONS, parent, stem, suffix
from ..operators.jobs import cleaned_history

# Folder names whose files are outputs, never inputs.
SKIPPED_FOLDERS = ("extracted_ppt", "transcripts", "slides", "temp")
SESSION_SCHEMA = (
    "id string, title string, videos array<struct<vga:string,main:string,screen:string,desktop:string,camera:string,video:string>>, video_ids array<bigint>")
HISTORY_SCHEMA = "course_id string, course_name string, professor string, last_used string, count int"


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp4",), *, recursive: bool = True, skip: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """(path, stem, ext, folder, length, mtime) of matching files; contents are never read.

    Without ``recursive`` only files that lie in ``path`` itself, not those of folders below it that look like partitions.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    rows = files.select("path", stem(F.col("path")).alias("stem"), F.lower(F.substring(suffix(F.col("path")), 2, 10)).alias("ext"), parent(F.col("path")).alias("folder"), "length", "mtime")
    out = rows.where(F.col("ext").isin(*extensions))
    if not recursive and not any(c in path for c in "*?[{"):
        here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        out = out.where(F.col("folder") == here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(here).toString())
    for name in skip:
        out = out.where(~F.col("folder").contains(name))
    return out


def scan_media(spark: SparkSession, path: str, **kw) -> DataFrame:
    return scan_files(spark, path, (*AUDIO_EXTENSIONS, *VIDEO_EXTENSIONS), **kw)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """History rows, newest first; a missing or broken file is empty, rows without an id go, defaults are filled."""
    try:
        rows = spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception as e:  # noqa: BLE001 - only a missing path counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], HISTORY_SCHEMA)
    return cleaned_history(rows).orderBy(F.desc("last_used"), "course_id")


def read_ids(spark: SparkSession, path: str, *, comments: bool = True) -> DataFrame:
    """Ids of a list file; blank lines and, if wanted, ``#`` lines are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    return rows.where(~F.col("id").startswith("#")) if comments else rows


def course_info(payload: DataFrame, body: str = "body") -> DataFrame:
    """(course_id, name, professor, ok) of course replies: code 0 or "0" is good, no professor gives a placeholder."""
    schema = "code string, message string, data struct<id:string,name_zh:string,professors:array<struct<name:string>>>"
    r = F.from_json(body, schema)
    return payload.select(r.alias("r")).select(
        F.col("r.data.id").alias("course_id"), F.coalesce("r.data.name_zh", F.lit("")).alias("name"),
        F.coalesce(F.try_element_at(F.col("r.data.professors"), F.lit(1))["name"], F.lit("unknown")).alias("professor"), (F.col("r.code") == "0").alias("ok"))


def checked_sessions(info: DataFrame, sessions: DataFrame, key: str = "course_id") -> DataFrame:
    """``info`` with error: a reply that is not good, or a course whose session list is empty; null if all is well."""
    listed = sessions.groupBy(key).agg(F.count("*").alias("_n"))
    error = F.when(~F.coalesce("ok", F.lit(False)), "bad reply").when(F.coalesce("_n", F.lit(0)) == 0, "no sessions")
    return info.join(listed, key, "left").withColumn("error", error).drop("_n")


def session_lists(payload: DataFrame, body: str = "body", attempt: str = "attempt", key: str = "course_id") -> DataFrame:
    """Sessions of replies that are a list, ``{data: [...]}`` or ``{list: [...]}``; the first non-empty attempt counts."""
    item = "array<struct<id:string,title:string>>"
    # A JSON object parses as a list of one empty session, so the shape is told by its first character.
    is_list = F.ltrim(body).startswith("[")
    inner = F.coalesce(F.get_json_object(body, "$.data"), F.get_json_object(body, "$.list"))
    shapes = F.from_json(F.when(is_list, F.col(body)).when(F.ltrim(inner).startswith("["), inner), item)
    rows = payload.withColumn("_l", shapes).where(F.size("_l") > 0)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(attempt))).where("_n = 1")
    return first.select(key, F.posexplode("_l").alias("pos", "s")).select(key, "pos", "s.*")


def log_tail(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """(pos, line): the last ``n`` lines of a log, the last one first; pos counts back from 0.

    ``path`` is a file, or a folder of rolled files whose names stand in order. Lines are read as rows and ordered by their
    file, block of the file and place in it, so only ``n`` rows a task are held.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    order = [F.desc("file"), F.desc("block"), F.desc("at")]
    place = F.row_number().over(Window.orderBy(*order)) - 1  # n rows
    return lines.orderBy(*order).limit(n).select(place.alias("pos"), F.col("value").alias("line")).orderBy("pos")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, pos, line) of transcript text files."""
    whole = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("media_id"), "value")
    return whole.select("media_id", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line"))


def scene_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Times that a scene filter has logged."""
    return lines.select("*", F.regexp_extract(line, r"pts_time:([0-9.]+)", 1).try_cast("double").alias("ts")).where("ts is not null")


def frames_at(times: DataFrame, frames: DataFrame, media: str = "media_id", fps: str = "fps", *, few: bool = False) -> DataFrame:
    """Frames at given times: number int(ts * fps).

    With ``few``, for media of few times each, rows meet by medium alone and their numbers are compared then: sides that are
    laid out by medium are not shuffled again, but each frame of a medium meets each of its times.
    """
    numbered = times.withColumn("frame_no", F.floor(F.col("ts") * F.col(fps)).cast("int"))
    if not few:
        return numbered.join(frames, [media, "frame_no"])
    # Not an equality, which would become a key of the join.
    same = (F.col("frame_no") <= F.col("_frame")) & (F.col("frame_no") >= F.col("_frame"))
    return numbered.join(frames.withColumnRenamed("frame_no", "_frame"), media).where(same).drop("_frame")


def sampled(frames: DataFrame, fps: float, interval: float = 0.5) -> DataFrame:
    """Every int(fps * interval)-th frame, at least every one."""
    return frames.where(F.col("frame_no") % max(1, int(fps * interval)) == 0)
