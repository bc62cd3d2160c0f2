"""Helpers that the pipeline operators share: tables in the shared folder, keys and query settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOTS: dict[str, str] = {}
#: Paths of the tables stored so far.
_TABLES: list[str] = []
#: Rows and bytes per Arrow batch handed to Python. Texts may be very long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_root(spark: SparkSession) -> str:
    """Folder for written tables: below ``spark.checkpoint.dir``; a temporary one only in local mode."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="lectern-")
        root = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        _ROOTS[app] = root

        def leave() -> None:
            try:
                _delete(spark, root)
            except Exception:  # noqa: BLE001 - the JVM may be gone by now
                pass

        atexit.register(leave)
    return _ROOTS[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back: lineage ends here.

    Tables of numbers alone are written without a codec: hashes don't compress, and the direct buffers of a codec for
    each of many small files outlive their tasks.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    numbers = all(isinstance(f.dataType, T.NumericType | T.BooleanType) for f in schema)
    df.write.parquet(path, compression="none" if numbers else None)
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    _TABLES.append(path)
    return out


@contextmanager
def released(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables stored within the block are removed at its end, but for those put into the list it gives."""
    before, kept = len(_TABLES), []
    try:
        yield kept
    finally:
        stay = {df._table_path for df in kept}
        for path in [p for p in _TABLES[before:] if p not in stay]:
            _delete(spark, path)
        _TABLES[before:] = [p for p in _TABLES[before:] if p in stay]


def release(df: DataFrame | None) -> None:
    """Remove a table made by :func:`stored` that no later plan reads."""
    if df is not None and hasattr(df, "_table_path"):
        _delete(df.sparkSession, df._table_path)


#: Rows and bytes of files up to which a table is broadcast.
SMALL_ROWS, SMALL_BYTES = 200_000, 8 << 20


def sized(df: DataFrame, label: str, most: int = SMALL_ROWS) -> DataFrame:
    """Write a table of narrow keys and mark it for broadcast if it has few rows and bytes; else joins shuffle."""
    kept = stored(df, label)
    return F.broadcast(kept) if kept.count() <= most and _size(kept.sparkSession, kept._table_path) <= SMALL_BYTES else kept


def _size(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def bounded_sample(df: DataFrame, groups: list[str], order: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each group, those of least ``order``; the limit is applied before rows are shuffled."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def tuned(spark: SparkSession) -> SparkSession:
    """Arrow batches of few rows and bytes, as texts may be long; values the user has set are kept."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, str(value))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def hash_fraction(*cols: str | Column, seed: int) -> Column:
    """A reproducible uniform number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), F.lit(1 << 30)) / float(1 << 30)
