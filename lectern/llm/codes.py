"""Vector codes: every vector becomes the indexes of its parts' nearest entries in integer codebooks.

Components are scaled and floored to integers, vectors are cut into equal consecutive parts, and each part position has a
codebook of integer entries. A round broadcasts the codebooks (parts x entries x width integers), computes all squared
distances of an Arrow batch by |x|^2 - 2 x.c + |c|^2 with int64 matrix products, and takes the first smallest. Tasks add
up the parts of each entry; one grouped shuffle merges these sums, so a round returns one row a codebook component to the
driver however many vectors there are. All numbers are exact integers: neither batches nor partitions change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored, table, tuned

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def integer_vectors(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """Stored (id, label, v) of the vectors that are finite, and the length of every v, a multiple of ``parts``.

    A vector shorter than the longest, or than the next multiple of ``parts``, counts zeros behind its end. A component
    whose distances could leave 64 bits raises an error; it is never clipped.
    """
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    found = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & finite)
    longest = found.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    length = -(-longest // parts) * parts
    most = isqrt((1 << 62) // max(1, length)) // 2
    whole = F.transform("x", lambda x: F.when(F.abs(x) * scale <= most, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"components above {most / scale} overflow"))))
    return stored(found.select("id", "label", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("x"))).alias("v")), "integers"), length


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The batch's vectors as parts x rows x width."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, parts, -1).transpose(1, 0, 2)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equal ones) and its squared distance, both parts x rows."""
    far = (x * x).sum(2)[:, :, None] - 2 * np.matmul(x, books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    at = far.argmin(2)
    return at, np.take_along_axis(far, at[:, :, None], 2)[:, :, 0]


def first_books(rows: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids (null the largest).

    An id counts once, with the least of its vectors; fewer ids make fewer entries.
    """
    ids = [r["id"] for r in rows.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    known = [i for i in ids if i is not None]
    wanted = F.col("id").isin(known) | F.col("id").isNull() if len(known) < len(ids) else F.col("id").isin(known)
    least = {r["id"]: r["v"] for r in rows.where(wanted).groupBy("id").agg(F.min("v").alias("v")).collect()}
    return np.array([least[i] for i in ids], np.int64).reshape(len(ids), parts, length // parts).transpose(1, 0, 2)


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts nearest to it; unused entries stay."""
    spread = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, parts)
                one = (nearest(x, spread.value)[0][:, :, None] == np.arange(entries)).astype(np.int64)
                sums += np.matmul(one.transpose(0, 2, 1), x)
                counts += one.sum(1)
        part, entry = np.nonzero(counts)
        at = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()), pa.array(at, pa.int32()), pa.array(sums[part, entry].ravel()), pa.array(np.repeat(counts[part, entry], width))],
            ["part", "entry", "at", "s", "n"])

    sums = rows.select("v").mapInArrow(add, "part int, entry int, at int, s long, n long").groupBy("part", "entry", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.select("part", "entry", "at", F.expr("(s - pmod(s, n)) div n").alias("mean")).collect():  # parts x entries x width rows at most
        out[r["part"], r["entry"], r["at"]] = r["mean"]
    spread.unpersist()
    return out


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every finite vector, and the codebooks (parts x entries x width).

    Vectors that are null or hold null or non-finite components take no part. Empty vectors and those of other lengths are
    filled up with zeros (:func:`integer_vectors`). Repeated rows are rows of their own; a null key or label is kept. With
    fewer ids than entries the codebooks are smaller; an empty table gives no rows. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = tuned(vectors.sparkSession)
    rows, length = integer_vectors(vectors, key, vector, label, parts, scale)
    books = first_books(rows, length, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_books(rows, books)
    spread = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = nearest(_matrix(batch, parts), spread.value)
                digits = np.ascontiguousarray(at.T).astype(np.uint8).tobytes().hex()
                codes = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes), pa.array(far.sum(0))], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all integers by part, entry and position, joined with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``: vec_id, code, error, label_error, codebooks_sha256; edge cases as :func:`compress` states."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = stored(coded, "codes")
    totals = sized(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] x FROM kept, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 e, x c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) x, arg_min(e, d * {entries} + e) e, min(d) d FROM (
  SELECT vec_id, cut.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) d FROM cut JOIN c{k} ON cut.p = c{k}.p) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) c FROM c{k} o LEFT JOIN (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) c FROM (SELECT p, e, j, sum(x[j]) s, count(*) n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) j FROM a{k}) GROUP BY p, e, j) GROUP BY p, e) m ON o.p = m.p AND o.e = m.e)""")
    return f"""WITH {', '.join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) code, CAST(sum(d) AS BIGINT) error FROM a{rounds} GROUP BY vec_id),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label"""


#: The same rounds in SQL, over unique ids and vectors of one length that ``PARTS`` divides.
OP11_SQL = _sql()
