"""Live progress as streams: latest state, idle detection and stalls by event time or by state and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

IDLE_SECONDS, STALL_SECONDS, MOST_RESTARTS = 180, 600, 20


def as_events(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Zone-less times become instants, with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def latest(df: DataFrame, job: str, ts: str, *cols: str) -> DataFrame:
    """Newest sample of each job; an update-mode aggregate."""
    return df.groupBy(job).agg(F.max(F.struct(ts, *cols)).alias("s")).select(job, "s.*")


def activity(df: DataFrame, job: str, ts: str, idle: int = IDLE_SECONDS) -> DataFrame:
    """Spells of activity: a gap of more than ``idle`` seconds ends one (a gap of exactly that does not)."""
    w = F.session_window(ts, f"{idle} seconds")
    return df.groupBy(job, w.alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("begin"), F.max(ts).alias("last")).drop("w")


def windowed(df: DataFrame, ts: str, length: str = "5 minutes", slide: str | None = None, *keys: str) -> DataFrame:
    """Counts in tumbling or sliding windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w, *keys).agg(F.count("*").alias("events")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), *keys, "events")


def idle_alarms(df: DataFrame, job: str = "job_id", ts: str = "ts", idle: int = IDLE_SECONDS) -> DataFrame:
    """(job, at): an alarm when a job was silent for more than ``idle`` seconds, without waiting for its next sample.

    The alarm is a processing-time timer that every sample sets anew.
    """
    kind = dict(df.dtypes)[job]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({job: [key[0]], "at": [pd.Timestamp(last, unit="s") + pd.Timedelta(seconds=idle)]})
            return
        last = max([max(t.timestamp() for t in b[ts]) for b in batches if len(b)] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutDuration(idle * 1000)

    return df.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, at timestamp", "last double", "append", "ProcessingTimeTimeout")


def supervise(
    df: DataFrame, job: str = "job_id", ts: str = "ts", size: str = "log_bytes", stall: int = STALL_SECONDS, most: int = MOST_RESTARTS, *, exited: str | None = None, done: str | None = None,
    timer: bool = False,
) -> DataFrame:
    """(job, ts, restart): a restart whenever the log did not grow for more than ``stall`` seconds, at most ``most``.

    ``exited`` and ``done`` name optional boolean columns: a job that exited is restarted at once, one that is done
    never again. With ``timer`` a job that falls silent altogether is restarted by a processing-time timer, which every
    sample and restart set anew. State a job: last size, when it grew, restarts (-1: done). Samples are taken in time
    order within a micro-batch.
    """
    kind = dict(df.dtypes)[job]
    never = [False]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, grew, n = state.get if state.exists else (-1, None, 0)
        out = []
        if timer and state.hasTimedOut:
            if 0 <= n < most:
                n, grew = n + 1, (grew or 0.0) + stall
                out.append((key[0], pd.Timestamp(grew, unit="s"), n))
        else:
            rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
            flags = [rows[c].fillna(False).astype(bool) if c else never * len(rows) for c in (exited, done)]
            for at, now, gone, over in zip(rows[ts], rows[size], *flags, strict=True):
                t = at.timestamp()
                if n < 0 or over:
                    n = -1
                elif gone and n < most:
                    n, grew, last = n + 1, t, int(now)
                    out.append((key[0], at, n))
                elif grew is None or now != last:
                    last, grew = int(now), t
                elif t - grew > stall and n < most:
                    n, grew = n + 1, t
                    out.append((key[0], at, n))
        state.update((last, grew, n))
        if timer and 0 <= n < most:
            state.setTimeoutDuration(stall * 1000)
        yield pd.DataFrame(out, columns=[job, ts, "restart"])

    return df.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, {ts} timestamp, restart int", "last long, grew double, n int", "append", "ProcessingTimeTimeout" if timer else "NoTimeout")


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that are gathered while it runs (rows if none are named), and the handle that reads them."""
    seen = Observation(name)
    columns = [column.alias(label) for label, column in metrics.items()] or [F.count(F.lit(1)).alias("rows")]
    return df.observe(seen, *columns), seen


class ProgressListener(StreamingQueryListener):
    """Calls ``report(current, total, message)`` after every micro-batch; total is null, as a stream has no end."""

    def __init__(self, report: Callable[[int, int | None, str], None]):
        self.report, self.rows = report, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        self.report(0, None, "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802 - Spark's name
        self.rows += event.progress.numInputRows
        self.report(self.rows, None, f"batch {event.progress.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802 - Spark's name
        self.report(self.rows, None, "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802 - Spark's name
        self.report(self.rows, None, "ended" if event.exception is None else f"failed: {event.exception}")


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there into a memory table and return it; for tests and back-fills."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def for_each_batch(df: DataFrame, write, checkpoint: str, mode: str = "update"):
    """Start a stream whose micro-batches go to ``write(batch, epoch)`` (exactly once if it is idempotent by epoch)."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).start()
