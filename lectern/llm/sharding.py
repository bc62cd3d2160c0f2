"""Minimax contiguous sharding.

Documents of equal text form an atomic group; groups stand in the order of their smallest doc_id (nulls last, then
text hash). The smallest capacity for which a greedy pass fits the groups into ``shards`` contiguous runs is found by
search, and the cuts are those of the greedy pass at that capacity.

Everything is DataFrame code. Prefix sums come from a range partitioning: sums within each partition and the offsets
of the partitions before it (one row a partition). The search keeps, on the driver, the least and greatest prefix sum of at
most some ten thousand buckets of values; these bound every cut of a greedy pass, so whole ranges of capacities are settled at
once, and one aggregate a round refines the few buckets where cuts may still lie.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table

#: Buckets of prefix sums that one look-up returns.
BUCKETS = 16_384


def cumulative(df: DataFrame, order: list, value: str, out: str, partitions: int | None = None) -> tuple[DataFrame, int, int]:
    """``df`` with the running sum of ``value`` in the given total order, as a stored table; the whole sum and the largest value.

    No global sort task: sums are taken within range partitions, and one row a partition goes to the driver.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).withColumn("_part", F.spark_partition_id())
    local = stored(ranged.withColumn(out, F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))), "local")
    parts = local.groupBy("_part").agg(F.max(out).alias("n"), F.max(value).alias("most")).collect()
    before = _before(local.sparkSession, {r["_part"]: r["n"] for r in parts})
    found = stored(local.join(before, "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before"), "sums")
    release(local)
    return found, sum(r["n"] for r in parts), max((r["most"] for r in parts), default=0)


def _before(spark: SparkSession, sums: dict[int, int]) -> DataFrame:
    """(_part, _before): the sum of all partitions before each; one row a partition, broadcast."""
    rows, total = [], 0
    for part in sorted(sums):
        rows.append((part, total))
        total += sums[part]
    return F.broadcast(spark.createDataFrame(rows, "_part int, _before long"))


class Resolution:
    """What is known of the prefix sums: for each bucket of values the least and the greatest sum in it.

    :meth:`refine` looks into spans of values with one aggregate of some ``BUCKETS`` rows.
    """

    def __init__(self, ends: DataFrame, column: str, total: int) -> None:
        self.ends, self.column = ends, F.col(column)
        self.buckets: list[tuple[int, int]] = [(0, 0)]
        self.refine([(1, total)])

    def refine(self, spans: list[tuple[int, int]]) -> None:
        """Replace the buckets within ``spans`` (of which none overlap) by finer ones."""
        sizes = [b - a + 1 for a, b in spans]
        width = max(1, min(-(-sum(sizes) // BUCKETS), max(sizes) // 2))  # the largest is split in any case
        place, inside, offset = F.lit(None).cast("long"), F.lit(False), 0
        for a, b in spans:
            place = F.when(self.column.between(a, b), F.floor((self.column - a) / width) + offset).otherwise(place)
            inside, offset = inside | self.column.between(a, b), offset + (b - a) // width + 1
        found = self.ends.where(inside).groupBy(place.alias("b")).agg(F.min(self.column).alias("lo"), F.max(self.column).alias("hi")).collect()
        others = [x for x in self.buckets if not any(a <= x[0] and x[1] <= b for a, b in spans)]
        self.buckets = sorted([*others, *((r["lo"], r["hi"]) for r in found)])
        self.starts = [lo for lo, _ in self.buckets]

    def up_to(self, x: int) -> tuple[int, int]:
        """Bounds of the largest prefix sum not above ``x``."""
        lo, hi = self.buckets[bisect_right(self.starts, x) - 1]
        return (hi, hi) if hi <= x else (lo, x if lo < x else lo)

    def path(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the cuts that a greedy pass makes, from 0 on."""
        cuts = [(0, 0)]
        for _ in range(shards - 1):
            cuts.append((self.up_to(cuts[-1][0] + capacity)[0], self.up_to(cuts[-1][1] + capacity)[1]))
        return cuts

    def open_spans(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Buckets in which a greedy pass of a capacity from ``low`` to ``high`` may look for a cut, merged."""
        asked = [(a[0] + low, b[1] + high) for a, b in zip(self.path(low, shards)[:-1], self.path(high, shards)[:-1], strict=True)]
        spans: list[tuple[int, int]] = []
        for lo, hi in self.buckets:
            if lo < hi and any(lo <= y and hi > x for x, y in asked):
                if spans and spans[-1][1] + 1 >= lo:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
        return spans


def _least(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The least number from ``low`` on for which ``holds``, or ``high``."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return high


def minimax_cuts(ends: DataFrame, column: str, total: int, largest: int, shards: int) -> list[int]:
    """Prefix sums after which the greedy pass at the smallest feasible capacity cuts (at most ``shards - 1``).

    A capacity is feasible if what is left after the last cut fits. Known buckets bound each cut from both sides, so a
    binary search on the driver gives the least capacity that may be feasible and the least that surely is; then only the
    buckets where cuts of capacities between the two may lie are refined, until the two meet at exact cuts.
    """
    sums = Resolution(ends, column, total)
    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)  # the latter always fits
    while True:
        low = _least(low, high, lambda c: total - sums.path(c, shards)[-1][1] <= c)
        high = _least(low, high, lambda c: total - sums.path(c, shards)[-1][0] <= c)
        spans = sums.open_spans(low, high, shards)
        if not spans:
            cuts = [lo for lo, _ in sums.path(high, shards)]
            return [c for c in dict.fromkeys(cuts) if 0 < c < total]
        sums.refine(spans)


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row.

    size is the text's UTF-8 bytes plus 1 (null: 1). All null texts are one group, all empty texts another; long texts
    are measured whole. slot counts a shard's rows from 0 in the order of key (nulls last), crc and hash. Repeated rows
    each get a slot. Fewer groups than shards leave the last shards empty; an empty table gives no rows. Other columns,
    whatever their names, are not looked at.
    """
    value = F.col(text)
    slim = docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("crc"),
        F.when(value.isNull(), F.lit(-1)).otherwise(F.xxhash64(value)).alias("g1"), F.when(value.isNull(), F.lit(-1)).otherwise(F.xxhash64(F.lit(1), value)).alias("g2"))
    rows = stored(slim, "slim")
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.min("key").alias("least"))
    order = [F.asc_nulls_last("least"), F.asc("g1"), F.asc("g2")]
    ends, total, largest = cumulative(groups, order, "bytes", "end")
    cuts = minimax_cuts(ends, "end", total, largest, shards) if total else []
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = rows.join(ends.select("g1", "g2", shard.alias("shard")), ["g1", "g2"]).select("key", "size", "crc", "g1", "shard")
    # Row numbers: range partitions in (shard, key) order, sorted inside, with the sizes of those before.
    sort = [F.asc("shard"), F.asc_nulls_last("key"), F.asc_nulls_last("crc"), F.asc("g1")]
    numbered = stored(placed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part"), "shard").agg(F.count("*").alias("n")).collect()  # partitions + shards rows
    sizes, in_part = [0] * shards, dict.fromkeys(sorted({r["_part"] for r in counts}), 0)
    for r in counts:
        sizes[r["shard"]] += r["n"]
        in_part[r["_part"]] += r["n"]
    start = F.element_at(F.array(*[F.lit(sum(sizes[:i])).cast("long") for i in range(shards)]), F.col("shard") + 1)
    out = numbered.withColumn("_part", part).join(_before(docs.sparkSession, in_part), "_part").withColumn("slot", F.col("_before") + place - start)
    release(rows)
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``; edge cases as :func:`assign_shards` states."""
    found = assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document that is left.

    Nulls in any column, empty and long texts, repeated rows, ties, empty tables and other columns: as
    :func:`assign_shards` states.
    """
    return assign_shards(docs)
