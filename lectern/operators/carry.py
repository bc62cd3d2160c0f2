"""Scans of long timelines over range partitions, with a carry at the boundaries.

Rows are range-partitioned by key and order, so one long key spreads over many tasks. A scan runs twice over the same
partitions: first each partition gives one small summary row (its first key, its last key and the state after it), the
summaries are merged in order on the driver (one row a partition), then the partitions are scanned again, each from the
state that the rows before it leave. Rules say how a state is made, fed with a batch of rows and merged.
"""

from __future__ import annotations

import atexit
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batch = pa.RecordBatch


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lectern-")
        context.setCheckpointDir(base)
        folder, jvm, conf = context.getCheckpointDir(), context._jvm, context._jsc.hadoopConfiguration()

        def leave() -> None:
            try:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # noqa: BLE001 - the JVM may be gone by now
                pass

        atexit.register(leave)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; partitions and their order stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@dataclass
class Ranged:
    """Rows sorted within range partitions by keys and order; ``_part`` numbers the partitions."""

    df: DataFrame
    keys: list[str]

    def with_rows(self, change: Callable[[DataFrame], DataFrame]) -> Ranged:
        """Rows filtered or with more columns; partitions, order and ``_part`` must stay."""
        return Ranged(change(self.df), self.keys)


def ranged(df: DataFrame, keys: list[str], order: list[str | Column], partitions: int | None = None) -> Ranged:
    """Range partitions by keys and order, written once so that every scan sees the same ones."""
    sort = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    dealt = df.repartitionByRange(*([partitions] if partitions else []), *sort).sortWithinPartitions(*sort)
    return Ranged(checkpointed(dealt.withColumn("_part", F.spark_partition_id())), keys)


class Rule:
    """A scan. ``feed`` may see many keys: ``new`` marks the first row of each key that begins in the batch."""

    #: Columns read, and the columns added to every row, as DDL.
    reads: list[str]
    adds: str

    def start(self) -> Any:
        """State at the beginning of a key."""
        raise NotImplementedError

    def unknown(self) -> Any:
        """State where it isn't known what came before."""
        return self.start()

    def feed(self, state: Any, batch: Batch, new: np.ndarray) -> tuple[Any, list[pa.Array]]:
        """State after the batch's last row, and the columns added."""
        raise NotImplementedError

    def merge(self, before: Any, state: Any) -> Any:
        """State after ``before`` and rows that left ``state`` from unknown."""
        raise NotImplementedError


def _place(keys: list[str], batch: Batch, held: bytes | None) -> tuple[np.ndarray, bytes]:
    """Where a key begins in the batch, seen from the key before it, and the key of the last row."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    key = lambda i: pickle.dumps(tuple(batch.column(k)[i].as_py() for k in keys))
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = key(0) != held
    return new, key(n - 1)


def _summaries(rows: Ranged, rule: Rule) -> dict[int, tuple]:
    """(first key, last key, state after the last row) of every partition with rows."""
    keys = rows.keys

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        part = first = held = state = None
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part, (new, last) = batch.column("_part")[0].as_py(), _place(keys, batch, None)
                new[0], state = False, rule.unknown()
                first = pickle.dumps(tuple(batch.column(k)[0].as_py() for k in keys))
            else:
                new, last = _place(keys, batch, held)
            if not several and new.any():
                cut = int(np.argmax(new))  # the first key ends here, and what it left is of no use
                several, batch, new = True, batch.slice(cut), new[cut:]
            state, _ = rule.feed(state, batch, new)
            held = last
        if part is not None:
            told = (first, held if several else first, state)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(told)])], ["part", "told"])

    found = rows.df.select("_part", *keys, *[c for c in rule.reads if c not in keys]).mapInArrow(run, "part int, told binary").collect()  # one row a partition
    return {r["part"]: pickle.loads(r["told"]) for r in sorted(found)}


def carries(rows: Ranged, rule: Rule) -> dict[int, Any]:
    """The state with which each partition begins, if its first key began before it."""
    out, key, state = {}, None, None
    for part, (first, last, end) in _summaries(rows, rule).items():
        if first == key:
            out[part] = state
        state = rule.merge(state if first == key else rule.start(), end) if first == last else end
        key = last
    return out


def scan(rows: Ranged, rule: Rule) -> Ranged:
    """``rows`` with the columns that ``rule`` adds."""
    keys, names = rows.keys, rows.df.columns
    spread = rows.df.sparkSession.sparkContext.broadcast(carries(rows, rule))
    added = T.StructType.fromDDL(rule.adds)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        held, state, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = _place(keys, batch, held)
            if not begun:
                part, begun = batch.column("_part")[0].as_py(), True
                new[0], state = part not in spread.value, spread.value.get(part)
            state, columns = rule.feed(state, batch, new)
            held = last
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *added.names])

    return Ranged(rows.df.mapInArrow(run, T.StructType([*rows.df.schema, *added])), keys)


@dataclass
class Previous(Rule):
    """The named columns of the row before, null at the beginning of a key; ``_first`` tells that there is none."""

    columns: dict[str, str]
    kinds: dict[str, str]
    reads: list[str] = field(init=False)
    adds: str = field(init=False)

    def __post_init__(self) -> None:
        self.reads = [*dict.fromkeys(self.columns.values())]
        self.adds = ", ".join([*(f"{out} {self.kinds[c]}" for out, c in self.columns.items()), "_first boolean"])

    def start(self) -> tuple | None:
        return None

    def feed(self, state: tuple | None, batch: Batch, new: np.ndarray) -> tuple[Any, list[pa.Array]]:
        none = new.copy()
        none[0] |= state is None
        at, out = pa.array(np.arange(len(new)), mask=none), []
        for i, c in enumerate(self.columns.values()):
            values = batch.column(c)
            before = pa.array([None if state is None else state[i]], values.type)
            out.append(pa.concat_arrays([before, values]).take(at))
        return tuple(batch.column(c)[-1].as_py() for c in self.columns.values()), [*out, pa.array(none)]

    def merge(self, before: tuple | None, state: tuple | None) -> tuple | None:
        return before if state is None else state


@dataclass
class Running(Rule):
    """``out``: the sum of an integer column over a key's rows up to this one; nulls count 0."""

    column: str
    out: str
    reads: list[str] = field(init=False)
    adds: str = field(init=False)

    def __post_init__(self) -> None:
        self.reads, self.adds = [self.column], f"{self.out} long"

    def start(self) -> int:
        return 0

    def feed(self, state: int, batch: Batch, new: np.ndarray) -> tuple[int, list[pa.Array]]:
        v = batch.column(self.column).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(v)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
        sums = sums - np.where(begin < 0, -(state or 0), sums[begin] - v[begin])
        return int(sums[-1]), [pa.array(sums)]

    def merge(self, before: int, state: int) -> int:
        return before + state


@dataclass
class LastSeen(Rule):
    """``out``: the id of the last row up to this one for which ``flag`` holds, null before the first."""

    flag: str
    id: str
    out: str
    reads: list[str] = field(init=False)
    adds: str = field(init=False)

    def __post_init__(self) -> None:
        self.reads, self.adds = [self.flag, self.id], f"{self.out} long"

    def start(self) -> int | None:
        return None

    def feed(self, state: int | None, batch: Batch, new: np.ndarray) -> tuple[int | None, list[pa.Array]]:
        flag = batch.column(self.flag).to_numpy(zero_copy_only=False)
        place = np.arange(len(new))
        at = np.maximum.accumulate(np.where(flag, place, -1))
        begin = np.maximum.accumulate(np.where(new, place, -1))
        none = (at < 0) | (at < begin)
        held = (begin < 0) & none & (state is not None)
        ids = batch.column(self.id).to_numpy(zero_copy_only=False)
        out = np.where(held, state or 0, ids[np.maximum(at, 0)])
        none &= ~held
        return (None if none[-1] else int(out[-1])), [pa.array(out, pa.int64(), mask=none)]

    def merge(self, before: int | None, state: int | None) -> int | None:
        return before if state is None else state


def previous(rows: Ranged, columns: dict[str, str]) -> Ranged:
    """``rows`` with columns of the row before (``out: column``) and ``_first``."""
    return scan(rows, Previous(columns, dict(rows.df.dtypes)))


def running(rows: Ranged, column: str, out: str) -> Ranged:
    return scan(rows, Running(column, out))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the given doubles, each next double the next integer; the map is its own inverse."""
    bits = np.ascontiguousarray(x).view(np.int64)
    return np.where(bits >= 0, bits, np.int64(-(1 << 63)) - bits)


def due(v: np.ndarray, least: float) -> np.ndarray:
    """The smallest double x for which ``x - v >= least`` holds as doubles round."""
    v = np.asarray(v, float)
    t = v + least
    wide = 4 * (np.spacing(np.abs(v)) + np.spacing(np.abs(t)) + np.spacing(abs(least)))
    low, high = _ordered(t - wide), _ordered(t + wide)  # the rule fails at low and holds at high
    for _ in range(64):
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        x = _ordered(middle).view(np.float64)
        holds = x - v >= least
        high, low = np.where(holds, middle, high), np.where(holds, low, middle)
    return _ordered(high).view(np.float64)


#: Entries into a partition that a summary may tell apart; beyond them the successors of all rows are doubled.
MOST_ENTRIES = 1_000


class TooMany(Exception):
    """More entries into a partition than a summary may hold."""


@dataclass
class Greedy(Rule):
    """``_kept``: whether a row is kept, being at least ``least`` after the last one kept, or ``forced``.

    Rows of a key ascend by ``value``. The state is the value from which the next row is kept. From unknown it is a step
    function: chains that enter by different rows soon meet, so one step stands for many entries.
    """

    value: str
    least: float
    begin: float
    forced: str | None = None
    most: int = MOST_ENTRIES
    adds: str = "_kept boolean"
    reads: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.reads = [self.value, *([self.forced] if self.forced else [])]

    def start(self) -> float:
        return self.begin

    def unknown(self) -> dict:
        return {"upto": np.zeros(0), "due": np.zeros(0), "limit": None, "open": True, "many": False}

    def _rows(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        v = batch.column(self.value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        forced = batch.column(self.forced).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) if self.forced else np.zeros(len(v), bool)
        return v, forced

    @staticmethod
    def _next(code: np.ndarray, v: np.ndarray, forced: np.ndarray, at: np.ndarray, x: np.ndarray, after: np.ndarray) -> np.ndarray:
        """For probes of keys ``at`` and values ``x``: the first row of the key from ``x`` on, or forced, after row ``after``; n if none."""
        n = len(v)
        kind = np.r_[np.zeros(len(x), np.int8), np.ones(n, np.int8)]
        order = np.lexsort((kind, np.r_[x, v], np.r_[at, code]))
        row = np.where(order >= len(x), order - len(x), n)
        following = np.minimum.accumulate(row[::-1])[::-1]
        found = np.empty(len(order), np.int64)
        found[order] = following
        found = found[: len(x)]
        force = np.append(np.minimum.accumulate(np.where(forced, np.arange(n), n)[::-1])[::-1], n)
        found = np.minimum(found, force[np.minimum(after + 1, n)])
        return np.where((found < n) & (code[np.minimum(found, n - 1)] == at), found, n)

    def feed(self, state: Any, batch: Batch, new: np.ndarray) -> tuple[Any, list[pa.Array]]:
        v, forced = self._rows(batch)
        n, t = len(v), due(v, self.least)
        if isinstance(state, dict) and not new[0]:
            if new.any():
                raise ValueError("rows of unknown beginning are of one key")
            return self._steps(state, v, t, forced), [pa.nulls(n, pa.bool_())]
        code, begins = np.cumsum(new), np.flatnonzero(new)
        x = np.r_[t, np.full(len(begins), self.begin), [] if new[0] else [state]]
        at = np.r_[code, code[begins], [] if new[0] else [0]].astype(np.int64)
        after = np.r_[np.arange(n), begins - 1, [] if new[0] else [-1]].astype(np.int64)
        jump = np.append(self._next(code, v, forced, at, x, after), n)
        reached = np.zeros(n + 1, bool)
        reached[jump[n:-1]] = True
        jump = np.append(jump[:n], n)
        while (jump < n).any():
            reached[jump[np.flatnonzero(reached)]] = True
            jump = jump[jump]
        kept = reached[:n]
        last = np.flatnonzero(kept & (code == code[-1]))
        end = float(t[last[-1]]) if len(last) else (self.begin if len(begins) else state)
        return end, [pa.array(kept)]

    def _steps(self, state: dict, v: np.ndarray, t: np.ndarray, forced: np.ndarray) -> dict:
        if state["many"]:
            return state
        n, code = len(v), np.zeros(len(v), np.int64)
        limit = max(float(t[0]), self.begin) if state["limit"] is None else state["limit"]
        jump = self._next(code, v, forced, code, t, np.arange(n))
        end = np.where(jump == n, np.arange(n), jump)
        while (end != end[end]).any():
            end = end[end]
        upto, later = state["upto"], state["due"]
        if len(later):
            into = self._next(code, v, forced, np.zeros(len(later), np.int64), later, np.full(len(later), -1))
            later = np.where(into < n, t[end[np.minimum(into, n - 1)]], later)
        still = state["open"]
        if still:
            stops = np.flatnonzero((v >= limit) | forced)
            take = int(stops[0]) + 1 if len(stops) else n
            here = v[:take].copy()
            if len(stops) and forced[take - 1]:
                here[-1] = np.inf  # whatever is due, a chain enters here
            upto, later, still = np.r_[upto, here], np.r_[later, t[end[:take]]], not len(stops)
        if len(later):
            lasts = np.append(later[1:] != later[:-1], True)
            upto, later = upto[lasts], later[lasts]
        if len(later) > self.most:
            return self.unknown() | {"many": True}
        return {"upto": upto, "due": later, "limit": limit, "open": still, "many": False}

    def merge(self, before: float, state: Any) -> float:
        if not isinstance(state, dict):
            return state
        if state["many"]:
            raise TooMany(f"more than {self.most} entries into a partition")
        k = int(np.searchsorted(state["upto"], before))
        return float(state["due"][k]) if k < len(state["due"]) else before


def successors(rows: Ranged, value: str, id: str, least: float, forced: str | None) -> DataFrame:
    """(id, next): for every row the row that a chain visits after it, by scans of range partitions in falling order.

    ``rows`` ascend by ``value`` and ``id``, which is unique.
    """
    threshold = F.pandas_udf(lambda v: pd.Series(due(v.to_numpy(), least)), "double")  # type: ignore[call-overload]
    keys = rows.keys
    seen = rows.df.select(*keys, F.col(value).cast("double").alias("x"), F.lit(True).alias("row"), F.col(id).alias("id"))
    asked = seen.withColumn("x", threshold("x")).withColumn("row", F.lit(False))
    falling = ranged(seen.unionByName(asked), keys, [F.desc("x"), F.desc("row"), F.desc("id")])
    found = scan(falling, LastSeen("row", "id", "next")).df.where("not row").select("id", "next")
    if forced is None:
        return found
    back = ranged(rows.df.select(*keys, F.col(value).alias("x"), F.coalesce(F.col(forced), F.lit(False)).alias("row"), F.col(id).alias("id")), keys, [F.desc("x"), F.desc("id")])
    force = previous(scan(back, LastSeen("row", "id", "seen")), {"force": "seen"}).df.select("id", "force")
    return found.join(force, "id").select("id", F.least("next", "force").alias("next"))


def reached(heads: DataFrame, jumps: DataFrame) -> DataFrame:
    """All ids on the chains from ``heads`` (id) along ``jumps`` (id, next): pointer doubling, log n rounds."""
    found = checkpointed(heads.select("id"))
    jumps = checkpointed(jumps.where("next is not null"))
    while not jumps.isEmpty():
        found = checkpointed(found.union(found.join(jumps, "id").select(F.col("next").alias("id"))))
        far = jumps.select(F.col("id").alias("next"), F.col("next").alias("far"))
        jumps = checkpointed(jumps.join(far, "next").select("id", F.col("far").alias("next")))
    return found


def greedy(df: DataFrame, keys: list[str], order: list[str], value: str, least: float, begin: float, forced: str | None = None, partitions: int | None = None, most: int = MOST_ENTRIES) -> DataFrame:
    """Rows of ``df`` that a greedy chain keeps: the first from ``begin`` on, then each at least ``least`` after the last kept.

    ``order`` starts with ``value``; rows whose value is null or NaN are never kept. A row for which ``forced`` holds is
    kept in any case. One long key is spread over many tasks: partitions tell how chains cross them, and where chains
    cross by too many entries, the successors of all rows are doubled instead. Both give the same rows.
    """
    if not least > 0:
        raise ValueError("least must be above 0")
    if order[0] != value:
        raise ValueError("rows are ordered by the value first")
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = ranged(fine, keys, [*order], partitions)
    names = df.columns
    try:
        return scan(rows, Greedy(value, least, begin, forced, most)).df.where("_kept").select(*names)
    except TooMany:
        pass
    numbered = rows.with_rows(lambda d: checkpointed(d.withColumn("_id", F.monotonically_increasing_id())))
    first = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    heads = numbered.df.where((F.col(value).cast("double") >= begin) | first).groupBy(*keys).agg(F.min("_id").alias("id"))
    found = reached(heads, successors(numbered, value, "_id", least, forced))
    return numbered.df.join(found.select(F.col("id").alias("_id")), "_id", "left_semi").select(*names)


def nth_values(df: DataFrame, keys: list[str], value: str, place: Callable[[Column], Column], partitions: int | None = None) -> DataFrame:
    """(keys, value, n): of each key's ``n`` sorted values the one at ``place(n)``, counted from 0; exact.

    Equal values are counted before they are sorted. The counts are range-partitioned by key and value, so a key with very
    many values is many tasks; running sums tell which value covers the place. Null values don't count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    rows = running(ranged(counted, keys, [value], partitions), "_n", "_upto").df
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    totals = rows.groupBy(*keys).agg(F.sum("_n").alias("n")).withColumnsRenamed(names)
    wanted = place(F.col("n"))
    hit = rows.join(totals, [F.col(k).eqNullSafe(F.col(o)) for k, o in names.items()] or F.lit(True))
    return hit.where((wanted < F.col("_upto")) & (wanted >= F.col("_upto") - F.col("_n"))).select(*keys, value, "n")
