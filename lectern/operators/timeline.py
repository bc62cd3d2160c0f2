"""Order-dependent rules. Those that read neighbours, sum, or keep rows a distance apart are scans of range partitions with a
carry at the boundaries (``carry``), so one long key is many tasks. Those whose next step depends on the rows kept before
are scans of each key with a state, or, for the short lists of one row, folds of an array."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import carry


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def largest_gap(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """(keys, gap, at): the largest start minus previous end and the start it precedes; the earliest on ties.

    Only gaps above 0 count; a key without one is not returned. A long key spreads over many tasks.
    """
    rows = carry.previous(carry.ranged(df.select(*dict.fromkeys([*keys, *order, start, end])), keys, order, partitions), {"_end": end}).df
    first = F.min(F.struct((-F.col("gap")).alias("g"), *order, F.col(start).alias("_at")))
    best = rows.withColumn("gap", F.col(start) - F.col("_end")).where("gap > 0").groupBy(*keys).agg(first.alias("b"))
    return best.select(*keys, (-F.col("b.g")).alias("gap"), F.col("b._at").alias("at"))


def _changed(rows: carry.Ranged, value: str) -> carry.Ranged:
    """Rows whose value differs from the row before, in their partitions."""
    return carry.previous(rows, {"_before": value}).with_rows(lambda d: d.where(f"_first or not (_before <=> {value})").drop("_before", "_first"))


def changes(df: DataFrame, keys: list[str], order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before."""
    return _changed(carry.ranged(df, keys, order, partitions), value).df.drop("_part")


def longest_stall(df: DataFrame, keys: list[str], order: list[str], seconds: str, value: str, partitions: int | None = None) -> DataFrame:
    """(keys, stall, at): the longest time between changes, one decimal, earliest on ties; below two samples 0, 0."""
    kept = _changed(carry.ranged(df.select(*dict.fromkeys([*keys, *order, seconds, value])), keys, order, partitions), value)
    steps = carry.previous(kept, {"_at": seconds}).df.where("not _first").withColumn("_s", F.col(seconds) - F.col("_at"))
    best = steps.groupBy(*keys).agg(F.min(F.struct((-F.col("_s")).alias("s"), *order, F.col("_at").alias("_t"))).alias("b"))
    out = df.select(*keys).distinct().join(best.withColumnsRenamed({k: f"_{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], "left")
    return out.select(*keys, F.coalesce(F.round(-F.col("b.s"), 1), F.lit(0.0)).alias("stall"), F.coalesce(F.round("b._t", 1), F.lit(0.0)).alias("at"))


def idle_sessions(df: DataFrame, keys: list[str], order: list[str], seconds: Column, limit: float = 180.0, partitions: int | None = None) -> DataFrame:
    """``df`` with a session number from 0 that grows after more than ``limit`` idle seconds; without keys one timeline."""
    rows = carry.previous(carry.ranged(df.withColumn("_s", seconds), keys, order, partitions), {"_last": "_s"})
    opened = rows.with_rows(lambda d: d.withColumn("_new", F.coalesce((F.col("_s") - F.col("_last") > limit).cast("int"), F.lit(0))))
    return carry.running(opened, "_new", "session").df.drop("_s", "_last", "_first", "_new", "_part")


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str, total: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the number of each row of its key, from 1, and the number of the key's rows. Keys are not null."""
    rows = carry.running(carry.ranged(df.withColumn("_one", F.lit(1)), keys, order, partitions), "_one", number).df.drop("_one", "_part")
    return rows.join(rows.groupBy(*keys).agg(F.max(number).alias(total)), keys)


def until(df: DataFrame, keys: list[str], pos: str, stop: Column) -> DataFrame:
    """Rows before the first row for which ``stop`` holds; all rows if it never does."""
    ends = df.where(stop).groupBy(*keys).agg(F.min(pos).alias("_stop"))
    return df.join(ends, keys, "left").where(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).drop("_stop")


def sorted_rows(df: DataFrame, keys: list[str], order: list[str], *cols: str) -> DataFrame:
    """One row a key with its rows as ``rows``, sorted by ``order``."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in cols if c not in order]))).alias("rows"))


def keep_spaced(rows: Column, value: str, least: float) -> Column:
    """Rows at least ``least`` after the last one kept; the first is kept."""
    none = F.filter(rows, lambda x: F.lit(False))
    return F.aggregate(rows, none, lambda kept, x: F.when((F.size(kept) == 0) | (x[value] - F.try_element_at(kept, F.lit(-1))[value] >= least), F.concat(kept, F.array(x))).otherwise(kept))


def throttle(rows: Column, done: str, total: Column, step: float) -> Column:
    """Rows emitted when ``step`` further than the last emitted (from 0) or complete."""
    none = F.filter(rows, lambda x: F.lit(False))

    def take(kept: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(kept, F.lit(-1))[done].cast("double"), F.lit(0.0))
        return F.when((x[done] >= last + step) | (x[done] == total), F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(rows, none, take)


def keep_unlike(rows: Column, word: str, most: int, memory: int = 1) -> Column:
    """Rows whose hash differs in more than ``most`` bits from each of the last ``memory`` kept."""
    none = F.filter(rows, lambda x: F.lit(False))

    def take(kept: Column, x: Column) -> Column:
        recent = F.slice(kept, F.greatest(F.size(kept) - (memory - 1), F.lit(1)), F.lit(memory))
        seen = F.exists(recent, lambda k: F.bit_count(k[word].bitwiseXOR(x[word])) <= most)
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(rows, none, take)


def adaptive_window(oks: Column, initial: int = 16, up: int = 1, down: int = 2, least: int = 4, most: int = 64) -> Column:
    """Window sizes after each result: up on success, down on failure, within bounds."""
    start = F.array(F.lit(initial))
    step = lambda h, ok: F.concat(h, F.array(F.when(ok, F.least(F.element_at(h, -1) + up, F.lit(most))).otherwise(F.greatest(F.element_at(h, -1) - down, F.lit(least)))))
    return F.aggregate(oks, start, step, lambda h: F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))))


def scan_keys(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Any], feed: Callable[[Any, dict[str, np.ndarray]], dict[str, Any]], schema: str, *cols: str) -> DataFrame:
    """Run a state machine over each key's rows in order, however long a key is: memory is one batch and one state.

    ``make()`` gives a state. ``feed(state, columns)`` gets the next rows of one key as arrays and returns arrays of the
    output columns beside the keys, of any one length.
    """
    kinds = dict(df.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    names = [part.split()[0] for part in schema.split(", ")]
    wanted = [*keys, *dict.fromkeys([*order, *cols])]
    rows = df.select(*wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = [batch.column(i) for i in range(len(keys))]
            change = np.zeros(batch.num_rows, bool)
            for c in heads:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(wanted) if i >= len(keys)}
            at: list[int] = []
            out: dict[str, list] = {n: [] for n in names}
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c[lo].as_py() for c in heads)
                if state is None or key != held:
                    held, state = key, make()
                got = feed(state, {n: v[lo:hi] for n, v in columns.items()})
                size = len(got[names[0]])
                at += [lo] * size
                for n in names:
                    out[n].extend(got[n])
            if at:
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in heads), *(pa.array(out[n], types[n]) for n in names)], [*keys, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    parsed = df.sparkSession.createDataFrame([], full).schema
    types = {f.name: to_arrow_type(f.dataType) for f in parsed if f.name in names}
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, full)


def spaced(df: DataFrame, keys: list[str], order: list[str], value: str, least: float, out: str, partitions: int | None = None) -> DataFrame:
    """(keys, out) of the rows at least ``least`` after the last one kept; the first is kept.

    ``order`` starts with ``value``. The rule is ``value - last >= least`` as doubles round, at every batch and partition.
    """
    rows = df.select(*dict.fromkeys([*keys, *order, out]))
    return carry.greedy(rows, keys, order, value, least, -np.inf, partitions=partitions).select(*keys, out)


def throttled(df: DataFrame, keys: list[str], done: str, total: str, step: float, *cols: str, partitions: int | None = None) -> DataFrame:
    """(keys, done, cols) of the rows emitted when ``step`` further than the last emitted (from 0) or complete."""
    rows = df.select(*dict.fromkeys([*keys, done, *cols]), (F.col(done) == F.col(total)).alias("_whole"))
    return carry.greedy(rows, keys, [done, *cols], done, step, step, "_whole", partitions).select(*keys, done, *cols)


def unlike(df: DataFrame, keys: list[str], order: list[str], word: str, most: int, out: str, memory: int = 1) -> DataFrame:
    """(keys, out) of the rows whose hash differs in more than ``most`` bits from each of the last ``memory`` kept."""
    kind = dict(df.dtypes)[out]

    def feed(state: deque, rows: dict[str, np.ndarray]) -> dict[str, Any]:
        words = rows[word].astype(np.int64).view(np.uint64)
        taken, i = [], 0
        while i < len(words):
            block = words[i : i + 256]
            fresh = np.ones(len(block), bool)
            for kept in state:
                fresh &= np.bitwise_count(block ^ kept) > most
            hit = np.flatnonzero(fresh)
            if not len(hit):
                i += len(block)
                continue
            i += int(hit[0])
            taken.append(i)
            state.append(words[i])
            i += 1
        return {out: rows[out][taken].tolist()}

    return scan_keys(df, keys, order, lambda: deque(maxlen=memory), feed, f"{out} {kind}", word, out)


def windows(df: DataFrame, keys: list[str], order: list[str], ok: str, initial: int = 16, up: int = 1, down: int = 2, least: int = 4, most: int = 64) -> DataFrame:
    """(keys, pos, size): window sizes after each result, up on success, down on failure, within bounds."""

    def feed(state: dict, rows: dict[str, np.ndarray]) -> dict[str, Any]:
        size, out = state["size"], []
        for good in rows[ok].tolist():
            size = min(size + up, most) if good else max(size - down, least)
            out.append(size)
        pos = list(range(state["pos"], state["pos"] + len(out)))
        state["size"], state["pos"] = size, state["pos"] + len(out)
        return {"pos": pos, "size": out}

    return scan_keys(df, keys, order, lambda: {"size": initial, "pos": 1}, feed, "pos long, size int", ok)
