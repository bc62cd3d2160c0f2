"""Jobs and trials: segment completeness, retries, rankings and the lookup history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import complete, succeeded
from .catalog import upper_median

HISTORY_MOST = 50


def completeness(segments: DataFrame, job: str, size: str = "bytes") -> DataFrame:
    """Per job: segments, present (non-empty), bytes, failed and whether 95 % are there."""
    got = F.col(size) > 0
    out = segments.groupBy(job).agg(F.count("*").alias("total"), F.count_if(got).alias("present"), F.sum(F.when(got, F.col(size)).otherwise(0)).alias("bytes"))
    return out.withColumn("failed", F.col("total") - F.col("present")).withColumn("complete", complete(F.col("present"), F.col("total")))


def final_attempts(attempts: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Deferred retries: an item succeeds if any attempt did; retries are the attempts after the first."""
    return attempts.groupBy(*keys).agg(F.bool_or(ok).alias("ok"), (F.count("*") - 1).alias("retries"))


def rank_trials(trials: DataFrame, keys: list[str], value: Column, keep: Column | None = None) -> DataFrame:
    """Upper median a configuration, rank from 1 (ties by name) and ratio to the best."""
    rows = trials if keep is None else trials.where(keep)
    med = upper_median(rows.select(*keys, value.alias("_value")), keys, "_value").withColumnRenamed("n", "trials")
    w = Window.orderBy("median", *keys)  # one row a configuration
    best = F.first("median").over(w)
    return med.withColumn("rank", F.row_number().over(w)).withColumn("ratio", F.when(best > 0, F.round(F.col("median") / best, 2)))


def paired(trials: DataFrame, block: str, order: list, value: str) -> DataFrame:
    """Interleaved trials compared with the next of their block."""
    w = Window.partitionBy(block).orderBy(*order)
    return trials.withColumn("next", F.lead(value).over(w)).withColumn("_n", F.row_number().over(w)).where("_n % 2 = 1 and next is not null").drop("_n")


def history_state(events: DataFrame, key: str, at: str, **last: str) -> DataFrame:
    """Mergeable state of look-ups: (key, count, last_used) and, for each field, its last non-empty value with its time.

    A blank or null key is no look-up. Of equal times the greater value stands.
    """
    newest = [F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.col(at).alias("at"), F.col(c).alias("value")))).alias(name) for name, c in last.items()]
    named = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
    return events.where(named).groupBy(key).agg(F.count("*").alias("count"), F.max(at).alias("last_used"), *newest)


def merge_history(stored: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The state of both: counts add up, the newest time and each field's newest non-empty value stand.

    The look-ups behind ``stored`` are not read again. States merge in any order and grouping.
    """
    fields = [c for c in stored.columns if c not in (key, "count", "last_used")]
    return stored.unionByName(delta).groupBy(key).agg(F.sum("count").alias("count"), F.max("last_used").alias("last_used"), *[F.max(c).alias(c) for c in fields])


def newest_history(state: DataFrame, key: str, most: int = HISTORY_MOST) -> DataFrame:
    """The ``most`` newest entries of a state, fields as plain values; ties by key."""
    fields = [c for c in state.columns if c not in (key, "count", "last_used")]
    return state.select(key, "count", "last_used", *[F.col(f"{c}.value").alias(c) for c in fields]).orderBy(F.desc("last_used"), key).limit(most)


def history(events: DataFrame, key: str, at: str, **last: str) -> DataFrame:
    """Upsert of look-ups as one aggregate: count, last time, last non-empty value of each field; newest 50."""
    return newest_history(history_state(events, key, at, **last), key)


def batch_totals(results: DataFrame, slides: str = "slides", status: str = "status", word: str = "ok", segments: str | None = None) -> DataFrame:
    """One row: files, those that succeeded, slides in all and, if given, segments in all; an empty batch gives zeros."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (slides, segments) if c]
    return results.agg(F.count("*").alias("files"), F.count_if(succeeded(F.col(status), word)).alias("succeeded"), *sums)


def retryable(tasks: DataFrame, status: str = "status", failed: int = -1) -> DataFrame:
    """Tasks to run again: those that failed."""
    return tasks.where(F.col(status) == failed)


def last_samples(samples: DataFrame, keys: list[str], order: list[str], value: str, n: int = 30) -> DataFrame:
    """(keys, history): the last ``n`` samples of each key, oldest first."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    few = samples.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    history = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))), lambda x: x["v"])
    return few.groupBy(*keys).agg(history.alias("history"))


def merge_manifest(segments: DataFrame, job: str, idx: str = "idx", size: str = "bytes") -> DataFrame:
    """(job, pos, file, bytes, total): the present segments in merging order, with the bytes of the whole."""
    there = segments.where(F.col(size) > 0)
    whole = Window.partitionBy(job)
    pos = F.row_number().over(whole.orderBy(idx))
    return there.select(job, pos.alias("pos"), F.concat(F.col(idx).cast("string"), F.lit(".ts")).alias("file"), F.col(size).alias("bytes"), F.sum(size).over(whole).alias("total"))


def cleaned_history(rows: DataFrame) -> DataFrame:
    """Entries with a course id that is not blank; missing texts become empty, a missing or zero count 1."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    good = rows.where(F.trim(F.coalesce("course_id", F.lit(""))) != "")
    return good.select("course_id", text("course_name"), text("professor"), text("last_used"), F.coalesce(F.nullif("count", F.lit(0)), F.lit(1)).alias("count"))


def without(rows: DataFrame, key: str, value) -> DataFrame:
    """History without the entry of a key (white space around it is ignored)."""
    return rows.where(~F.col(key).eqNullSafe(F.trim(F.lit(value).cast("string"))))


def cleared(rows: DataFrame) -> DataFrame:
    """An empty history of the same columns."""
    return rows.where(F.lit(False))
