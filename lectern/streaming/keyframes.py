"""Key frames of live frame streams: the machine of ``operators.slides`` kept as state a medium.

``transformWithStateInPandas`` needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` must be
``ROCKSDB`` below.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.slides import WINDOW, Machine, advance

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A machine as a row: hash compared against, flags as bits with their number, in a passage, slide that waits, counters.
STATE = "seen bigint, flags int, flagged int, video boolean, wait_ts double, wait_word bigint, calm int, at bigint, last bigint"
HELD = "ts double, word bigint"
#: Event time of a sample at 0 seconds; the first watermark is 0 and would take that sample for late.
EPOCH_MS = 86_400_000


def _millis(t: float) -> int:
    return math.floor(t * 1000) + EPOCH_MS


def to_row(m: Machine) -> tuple:
    wait = m.wait or (None, None)
    return m.seen, sum(f << i for i, f in enumerate(m.flags)), len(m.flags), m.video, wait[0], wait[1], m.calm, m.at, m.last


def from_row(row: tuple) -> Machine:
    seen, flags, flagged, video, ts, word, calm, at, last = row
    bits = deque((bool(flags >> i & 1) for i in range(flagged)), maxlen=WINDOW)
    return Machine(seen, bits, video, None if ts is None else (ts, word), calm, at, last)


class Keyframes(StatefulProcessor):
    """State a medium: one machine and, if samples may come late, those that wait for the watermark."""

    def __init__(self, media: str, ts: str, word: str, bits: int, late: bool, ttl_seconds: int | None):
        self.media, self.ts, self.word, self.bits, self.late, self.ttl = media, ts, word, bits, late, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {} if self.ttl is None else {"ttlDurationMs": 1000 * self.ttl}
        self.machine = handle.getValueState("machine", STATE, **ttl)
        if self.late:
            self.held = handle.getListState("held", HELD)

    def _run(self, key: tuple, samples: list[tuple[float, int]]) -> pd.DataFrame:
        """Feed samples in time order; hashes are held as signed words."""
        m = from_row(tuple(self.machine.get())) if self.machine.exists() else Machine()
        mask, taken = (1 << self.bits) - 1, []
        for t, w in sorted(samples):
            taken += advance(m, t, w & mask, self.bits)
        row = to_row(m)
        signed = lambda w: w if w is None or w < 1 << 63 else w - (1 << 64)
        self.machine.update((signed(row[0]), *row[1:5], signed(row[5]), *row[6:]))
        return pd.DataFrame({self.media: pd.Series([key[0]] * len(taken), dtype=object), self.ts: pd.Series(taken, dtype="float64")})

    def _samples(self, rows: Iterator[pd.DataFrame]) -> list[tuple[float, int]]:
        return [(float(t), int(w)) for b in rows for t, w in zip(b[self.ts], b[self.word], strict=True)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        samples = self._samples(rows)
        if not self.late:
            yield self._run(key, samples)
            return
        for t, w in samples:
            self.held.appendValue((t, w))
        for t in {t for t, _ in samples}:
            self.handle.registerTimer(_millis(t) + 1)
        yield self._run(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = [(float(t), int(w)) for t, w in self.held.get()]
        now, later = [x for x in held if _millis(x[0]) < due], [x for x in held if _millis(x[0]) >= due]
        if now:
            if later:
                self.held.put(later)
            else:
                self.held.clear()
        yield self._run(key, now)

    def close(self) -> None:
        pass


def stream_keyframes(frames: DataFrame, media: str, ts: str, word: str, bits: int = 64, *, late: str | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """(media, ts) of the slides of a stream of frames, the rows that ``operators.slides.keyframes`` gives of all of it.

    Frames of a medium come in time order, in whatever micro-batches. With ``late`` (an interval) they may come out of order
    by that much: each waits until the watermark has passed it, and earlier ones that come after that are dropped. With
    ``ttl_seconds`` (not together with ``late``) a medium without frames for so long is forgotten and begins anew.
    """
    if late is not None and ttl_seconds is not None:
        raise ValueError("state expires by processing time, late frames wait by event time: choose one")
    rows = frames.select(media, F.col(ts).cast("double").alias(ts), F.col(word).cast("long").alias(word))
    if late is not None:
        rows = rows.withColumn("_time", F.timestamp_millis(F.floor(F.col(ts) * 1000) + EPOCH_MS)).withWatermark("_time", late)
    schema = T.StructType([frames.schema[media], T.StructField(ts, T.DoubleType())])
    mode = "EventTime" if late is not None else "None" if ttl_seconds is None else "ProcessingTime"
    return rows.groupBy(media).transformWithStateInPandas(Keyframes(media, ts, word, bits, late is not None, ttl_seconds), schema, "Append", mode)
