"""Catalog rules: keep-first, missing outputs, inventory, session look-ups and plans of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order (a row limit within the window, pushed below the shuffle)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def missing(expected: DataFrame, present: DataFrame, on) -> DataFrame:
    """Expected rows without an output."""
    return expected.join(present, on, "left_anti")


def missing_by_either(expected: DataFrame, by_stem: DataFrame, by_title: DataFrame, stem: str, title: str) -> DataFrame:
    """Rows that match neither list: two hashed anti joins instead of one nested loop over an OR."""
    return expected.join(by_stem, stem, "left_anti").join(by_title, title, "left_anti")


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median", partitions: int | None = None) -> DataFrame:
    """(keys, out, n): the upper of the two middle values of each key, element n // 2 (from 0) of its sorted values."""
    return carry.nth_values(df, keys, value, lambda n: F.floor(n / 2), partitions).withColumnRenamed(value, out)


def inventory(files: DataFrame, course: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind per course and, as the row with a null course, in total."""
    return files.rollup(course).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def done_flag(videos: Column, *outputs: Column) -> Column:
    """Every output count reaches the video count (counts, not names)."""
    out = F.lit(True)
    for o in outputs:
        out = out & (o >= videos)
    return out


def prefix_map(rows: DataFrame, mapping: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows with every mapping row whose prefix their name starts with.

    Names are cut to each length that a prefix has (one row a length), so this is an equi-join of any size.
    """
    lengths = mapping.select(F.length(prefix).alias("_n")).where("_n is not null").distinct().agg(F.collect_list("_n").alias("_lengths"))
    cut = rows.crossJoin(lengths).withColumn("_n", F.explode("_lengths")).where(F.length(name) >= F.col("_n"))
    return cut.withColumn("_start", F.substr(F.col(name), F.lit(1), F.col("_n"))).join(mapping, F.col("_start") == F.col(prefix)).drop("_lengths", "_n", "_start")


def backfill(videos: DataFrame, audio: DataFrame, on: str) -> DataFrame:
    """Videos that lack audio."""
    return videos.select(on).distinct().join(audio.select(on), on, "left_anti")


def copy_plan(source: DataFrame, target: DataFrame, path: str, size: str) -> DataFrame:
    """Files to copy: absent from the target or of another size there."""
    there = target.select(F.col(path), F.col(size).alias("_there"))
    return source.join(there, path, "left").where(F.col("_there").isNull() | (F.col("_there") != F.col(size))).drop("_there")


def matrix(*axes: DataFrame) -> DataFrame:
    """All combinations of configured axes; by their sizes Spark broadcasts them or not."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(axis)
    return out


def top_by(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def concat_capped(df: DataFrame, keys: list[str], order: list[str], header: Column, text: Column, most: int = 180_000, tail: str = "\n...(cut)") -> DataFrame:
    """Non-empty texts joined in order under their headers, capped with a mark.

    Rows that begin beyond the cap are dropped by a running length before anything is collected.
    """
    rows = df.withColumn("_t", text).where(F.trim("_t") != "").withColumn("_p", F.concat(header, F.col("_t")))
    before = F.coalesce(F.sum(F.length("_p") + 1).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = rows.withColumn("_before", before).where(F.col("_before") <= most + 1)
    parts = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "_p"))).alias("_l"))
    whole = F.array_join(F.transform("_l", lambda x: x["_p"]), "\n")
    return parts.withColumn("text", F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit(tail))).otherwise(whole)).drop("_l")


def first_keys(df: DataFrame, keys: list[str], value: str, n: int = 10) -> DataFrame:
    """(keys, n, first): the number of distinct values of each key and the first ``n`` of them in order."""
    once = df.select(*keys, value).distinct()
    total = once.groupBy(*keys).agg(F.count("*").alias("n"))
    few = once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_n") <= n)
    return total.join(few.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("first")), keys)


def first_match(sessions: DataFrame, wanted: DataFrame, on: str, order: list[str]) -> DataFrame:
    """Of each wanted id the first session that carries it, in the order in which the courses were searched."""
    return keep_first(sessions.join(wanted, on, "left_semi"), [on], [F.asc(c) for c in order])


def counts_by(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, counts): a map from item to its number of rows; items without rows are absent."""
    per = df.groupBy(key, item).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(item, "n")))).alias("counts"))


def selected(items: DataFrame, choice: DataFrame, pos: str) -> DataFrame:
    """Chosen items in the order of their place in the list."""
    return items.join(choice, pos, "left_semi").orderBy(pos)


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Rows in code-point order of a name, as directory walks are sorted."""
    return df.orderBy(F.col(name).cast("binary"))


def extensions(*lists: DataFrame) -> DataFrame:
    """The union of lists as a set."""
    out = lists[0]
    for one in lists[1:]:
        out = out.unionAll(one)
    return out.distinct()
