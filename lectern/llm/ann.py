"""Approximate nearest neighbours: inverted file with product-quantised residuals, exact rerank.

Coarse centroids and the residual codebooks are fitted on a bounded sample (``sample_rows``, or 40 a list, drawn by a hash of id and vector); every row
is indexed. A list is described by its size and by the variance of its residuals, so that the number of its rows that
beat a score can be foretold from the normal law. A query visits lists in the order of the neighbours expected in them.
What counts as a neighbour is told by the score that k rows are expected to reach, or by the query's scores in a pilot
sample if those are higher. The law orders the lists well but, on rows with long tails, is far off in its counts. So
where to stop is measured: up to ``CHECKED`` queries, drawn by hash, are compared with all rows by brute force, and a
query stops where, of their true neighbours, ``recall`` would be found. Vectors that form clusters thus cost a few lists
each; vectors without structure cost as many lists as the recall needs, all of them if need be.

Lists are laid out in cells of bounded size: short lists share a cell, a long one spans several, by hash of the vector.
Queries travel to the cells; a cell that more than ``cell_queries`` queries visit is dealt to as many copies as it needs.
In a list the asymmetric distance tables tell which rows may reach the query's floor (a score that clearly more than k
rows of the pilot's scale reach): those whose estimate, raised by the row's own quantisation error times a slack that the
same queries measure, reaches it. They get exact inner products in double precision. Equal vectors count once in a shortlist and stand for their
k + 1 smallest ids, so a vector that a third of all rows share crowds nothing out and is thinned to those ids before any
shuffle. Rows equal in id and vector are one row; an id with several vectors is listed once, at its best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_fraction, sized, stored, table

#: Rows of the sample at least, and for each list.
SAMPLE_ROWS, FIT_ROWS, SUBSPACES, CODES = 16_384, 40, 16, 64
#: Sampled rows that tell a query which scores to expect; queries that are compared with all rows.
PILOT_ROWS, CHECKED = 8192, 256
#: Standard errors of a row's code that its estimate may lie below a floor, at least; share of true neighbours within the slack.
SLACK, WITHIN = 2.5, 0.995
#: Pairs of a query and a row whose vectors are held at a time.
PAIRS = 1 << 16


def _kmeans(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations from distinct sampled rows; an emptied cluster keeps its centre."""
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(steps):
        near = assign(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        c[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0) / n[n > 0, None]
    return c


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Probability that a standard normal number exceeds ``z`` (a polynomial good to seven digits, relative ones far out)."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = np.exp(-0.5 * a * a) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = np.where(a > 5, np.exp(-0.5 * a * a) * 0.3989422804 * a / (a * a + 1), p)
    return np.where(z >= 0, p, 1 - p)


@dataclass(frozen=True)
class IvfPq:
    coarse: np.ndarray  # (lists, dim)
    codebooks: list[np.ndarray]  # SUBSPACES arrays (codes, width)
    bounds: np.ndarray  # column bounds of the subspaces
    shape: np.ndarray  # (dim, dim) covariance of the residuals, of mean variance 1
    pilot: np.ndarray  # (rows, dim) sampled rows
    scale: np.ndarray  # (lists,) root mean square of the list's residuals; codes are of residuals divided by it

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 5) -> IvfPq:
        rng = np.random.default_rng(seed)
        coarse = _kmeans(sample.astype(np.float32), lists, 8, rng).astype(np.float64)
        at, dim = assign(sample, coarse), sample.shape[1]
        residual = (sample - coarse[at]).astype(np.float32)
        n, square = np.bincount(at, minlength=len(coarse)), np.bincount(at, np.einsum("ij,ij->i", residual, residual), len(coarse)) / dim
        whole = float(square.sum()) / len(sample)
        scale = np.sqrt(np.where(square > 0, square / np.maximum(n, 1), whole or 1.0)).astype(np.float32)
        residual /= scale[at][:, None]
        bounds = np.linspace(0, dim, min(SUBSPACES, dim) + 1).round().astype(int)
        books = [_kmeans(residual[:, a:b], CODES, 6, rng) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        shape = (residual.T @ residual).astype(np.float64)
        trace = float(np.trace(shape))
        shape = shape * (dim / trace) if trace > 0 else np.eye(dim)
        pilot = sample[rng.choice(len(sample), min(len(sample), PILOT_ROWS), replace=False)].astype(np.float32)
        return cls(coarse, books, bounds, shape, pilot, scale)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the mean squares of the residuals."""
        residual = (x - self.coarse[at]).astype(np.float32)
        square = np.einsum("ij,ij->i", residual, residual, dtype=np.float64) / residual.shape[1]
        residual /= self.scale[at][:, None]
        codes = np.stack([assign(residual[:, a:b], book) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.codebooks, strict=True)], axis=1).astype(np.uint8)
        return codes, square

    def decode(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        parts = [book[codes[:, s]] for s, book in enumerate(self.codebooks)]
        return self.coarse[at] + np.concatenate(parts, axis=1) * self.scale[at].astype(np.float64)[:, None]

    def errors(self, x: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Standard error of each row's estimated product with a query of length 1."""
        return np.linalg.norm(x - self.decode(codes, at), axis=1) / math.sqrt(x.shape[1])

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each subspace the products of its codes and the queries: (codes, queries)."""
        return [book @ queries[:, a:b].T.astype(np.float32) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.codebooks, strict=True)]

    def expected(self, q: np.ndarray, sizes: np.ndarray, spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, lists): the rows of each list expected to be among a query's k nearest; each query's floor."""
        mean = q @ self.coarse.T
        sd = np.sqrt(np.maximum(np.einsum("qd,de,qe->q", q, self.shape, q), 0)[:, None] * spread[None, :])
        sd = np.maximum(sd, np.maximum(1e-9 * np.abs(mean).max(axis=1, keepdims=True), 1e-150))
        low, high = (mean - 8 * sd).min(axis=1), (mean + 8 * sd).max(axis=1)
        for _ in range(24):
            t = (low + high) / 2
            many = (sizes * _upper_tail((t[:, None] - mean) / sd)).sum(axis=1) > k
            low, high = np.where(many, t, low), np.where(many, high, t)
        # The score of the pilot's row at about the k-th place, with some room; the query itself may be in the pilot.
        near, far = (math.ceil(a * k * len(self.pilot) / max(1, sizes.sum())) + 2 for a in (1.5, 3))
        floor = np.full(len(q), -np.inf)
        if far < len(self.pilot):
            seen = np.partition(-(q.astype(np.float32) @ self.pilot.T), (near, far), axis=1)
            low, floor = np.maximum(low, -seen[:, near]), -seen[:, far].astype(np.float64)
        return sizes * _upper_tail((low[:, None] - mean) / sd), floor

    def order(self, q: np.ndarray, sizes: np.ndarray, spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, lists) in the order of visits: lists, share of the neighbours expected from each one on; each query's floor."""
        e, floor = self.expected(q, sizes, spread, k)
        order = np.argsort(-e, axis=1, kind="stable")
        e = np.take_along_axis(e, order, axis=1)
        missed = np.cumsum(e[:, ::-1], axis=1)[:, ::-1]
        return order, missed / np.clip(missed[:, :1], 1e-300, k), floor

    def stop(self, q: np.ndarray, sizes: np.ndarray, spread: np.ndarray, k: int, recall: float, query: np.ndarray, at: np.ndarray) -> float:
        """Share of missing neighbours at which to stop, so that ``recall`` of the true neighbours is visited.

        ``query`` (row of ``q``) and ``at`` (list) tell the true neighbours; those of a query's first lists are visited anyway.
        """
        if not len(query):
            return 0.0
        shares = []
        for lo in range(0, len(q), 256):
            order, missed, _ = self.order(q[lo : lo + 256], sizes, spread, k)
            n = sizes[order]
            missed = np.where(np.cumsum(n, axis=1) - n < k + 1, np.inf, missed)
            here = (query >= lo) & (query < lo + 256)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            shares.append(missed[query[here] - lo, place[query[here] - lo, at[here]]])
        ranked = np.sort(np.concatenate(shares))
        return float(min(1.0, ranked[math.floor((1 - recall) * len(ranked))]))

    def probes(self, q: np.ndarray, sizes: np.ndarray, spread: np.ndarray, k: int, recall: float, share: float | None, stop: float | None = None) -> tuple[np.ndarray, ...]:
        """Query number, list, least rows of the shortlist and floor of every visit.

        Lists are visited while the share of missing neighbours is ``stop`` or more (default: 1 - ``recall``, as the law has
        it). The first lists of a query, that hold k + 1 rows together if there are so many, have a shortlist of 2 k + 2
        rows whatever the floor: they make sure that k rows are found.
        """
        out: list[tuple[np.ndarray, ...]] = []
        lists = len(self.coarse)
        block = max(1, (1 << 21) // max(lists, len(self.pilot) // 4))
        for lo in range(0, len(q), block):
            part = q[lo : lo + block]
            order, missed, floor = self.order(part, sizes, spread, k)
            if share is not None:
                order = np.argsort(-(part @ self.coarse.T), axis=1, kind="stable")
                visit, base = np.broadcast_to(np.arange(lists) < min(lists, max(8, math.ceil(share * lists))), order.shape), np.ones(order.shape, bool)
            else:
                n = sizes[order]
                base = np.cumsum(n, axis=1) - n < k + 1
                visit = (missed >= (1 - recall if stop is None else stop)) | base
            i, j = np.nonzero(visit & (sizes[order] > 0))
            out.append((i + lo, order[i, j].astype(np.int32), np.where(base[i, j], 2 * k + 2, 0).astype(np.int32), floor[i]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centre."""
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, max(1, len(x)), 4096)])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class Found:
    """Scored pairs of queries and rows."""

    query: np.ndarray
    key: np.ndarray
    score: np.ndarray

    @classmethod
    def of(cls, parts: list[Found]) -> Found:
        if not parts:
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("query", "key", "score")))

    def best(self, k: int, once: bool) -> Found:
        """The k best keys of each query, best first, ties to the smaller key; with ``once`` a key may come repeatedly and counts once."""
        q, i, s = self.query, self.key, self.score
        if once:
            order = np.lexsort((-s, i, q))
            q, i, s = q[order], i[order], s[order]
            first = np.ones(len(q), bool)
            first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
            q, i, s = q[first], i[first], s[first]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        near = np.arange(len(q)) - np.searchsorted(q, q) < k
        return Found(q[near], i[near], s[near])


def search_list(
    index: IvfPq, at: int, q: np.ndarray, qid: np.ndarray, want: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, codes: np.ndarray, error: np.ndarray, k: int, slack: float = SLACK,
) -> Found:
    """Exact scores of the shortlisted rows of one list for each query that visits it."""
    order = np.argsort(xid, kind="stable")
    x, xid, codes, error = x[order], xid[order], codes[order], error[order]
    _, first, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    group = group.ravel()
    fresh = np.ones(len(xid), bool)  # rows equal in id and vector count once
    fresh[1:] = (xid[1:] != xid[:-1]) | (group[1:] != group[:-1])
    several = len(np.unique(xid)) < int(fresh.sum())  # one id under different vectors
    rows, members = np.flatnonzero(fresh), group[fresh]
    by = np.argsort(members, kind="stable")  # ids ascend within a group
    bounds = np.searchsorted(members[by], np.arange(len(first) + 1))
    place = np.arange(len(by)) - bounds[members[by]]
    wide = int(min(k + 1, np.diff(bounds).max(initial=1)))
    ids, held = np.zeros((len(first), wide), np.int64), np.zeros((len(first), wide), bool)
    kept = place < wide
    ids[members[by][kept], place[kept]] = xid[rows][by][kept]
    held[members[by][kept], place[kept]] = True
    x, codes, error = x[first], codes[first], error[first]
    need = np.full(len(q), len(x)) if several else np.minimum(len(x), want)
    scale = float(index.scale[at])
    bar = ((floor - q @ index.coarse[at]) / scale).astype(np.float32)
    # What an estimate may lack: the slack, and the rounding of single precision.
    room, length = (slack * error / scale + 1e-5).astype(np.float32), np.linalg.norm(q, axis=1).astype(np.float32)
    out = []
    block = max(16, min(1024, (1 << 21) // max(1, len(x))))
    for lo in range(0, len(q), block):
        part = slice(lo, lo + block)
        rough = np.zeros((len(x), len(q[part])), np.float32)
        for s, t in enumerate(index.tables(q[part])):
            rough += t[codes[:, s]]
        rough += room[:, None] * length[part]
        likely = rough >= bar[part]
        for size in np.unique(need[part][need[part] > likely.sum(axis=0)]).tolist():
            of = np.flatnonzero(need[part] == size)
            top = np.argpartition(-rough[:, of], size - 1, axis=0)[:size]
            likely[top.ravel(), np.broadcast_to(of, top.shape).ravel()] = True
        row, query = np.nonzero(likely)
        query = query + lo
        score = np.concatenate([np.einsum("pd,pd->p", x[row[a : a + PAIRS]], q[query[a : a + PAIRS]]) for a in range(0, max(1, len(row)), PAIRS)])
        good = (score >= floor[query]) | (need[query] > 0)
        row, query, score = row[good], query[good], score[good]
        key = ids[row]
        good = held[row] & (key != qid[query][:, None])
        query, score = (np.broadcast_to(c[:, None], key.shape)[good] for c in (qid[query], score))
        out.append(Found(query, key[good], score))
    return Found.of(out)


def _cells(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each list and the number of cells it spans; short neighbours share a cell."""
    begin, spans, cells, left = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for at, n in enumerate(sizes.tolist()):
        if n > room:
            spans[at] = -(-n // room)
            begin[at], cells, left = cells, cells + spans[at], 0
        elif n:
            if n > left:
                cells, left = cells + 1, room
            begin[at], left = cells - 1, left - n
    return begin, spans


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding", *, k: int = 20, lists: int | None = None, recall: float = 0.97,
    probe: float | None = None, sample_rows: int = SAMPLE_ROWS, cell_rows: int = 8192, cell_queries: int = 8192,
) -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest by inner product, nearest first, ties to the smaller key.

    ``queries`` (same columns; default: all rows) never meet the row of their own key. ``recall`` is the share of
    neighbours that the visited lists hold, as measured on up to ``CHECKED`` queries; ``probe`` instead visits that share of the lists.
    Vectors that are null, zero, of another length than most, or that hold a null or non-finite component, and rows
    without a key take no part. Repeated rows count once; of different vectors under one key a query takes the
    smallest, and a neighbour counts once with its best score. Fewer keys than k give fewer ranks; an empty table gives
    none. Other columns, whatever their names, are not looked at; long vectors only need more time.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    def clean(df: DataFrame) -> DataFrame:
        kind = df.schema[vector].dataType
        narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
        df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>" if narrow else "array<double>").alias("v")).where("id is not null and v is not null")
        # Null if an element is null, true if one is NaN.
        whole = "not array_contains(v, cast('NaN' as {0}))".format("float" if narrow else "double")
        return df.where(f"{whole} and array_max(v) < double('infinity') and array_min(v) > double('-infinity') and (array_max(v) <> 0 or array_min(v) <> 0)")

    rows = clean(vectors)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count_distinct(F.xxhash64("id", "v")).alias("n"), F.count_distinct("id").alias("ids")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", key)
    dim, total = shape["dim"], shape["n"]
    several = shape["ids"] != total  # some key has several vectors
    rows = rows.where(F.size("v") == dim)
    asked = clean(vectors if queries is None else queries).where(F.size("v") == dim)
    asked = asked.groupBy("id").agg(F.min("v").alias("v")) if queries is None or asked.groupBy("id").count().where("count > 1").head(1) else asked
    count = lists or max(16, min(4096, round(math.sqrt(total))))
    wanted = max(sample_rows, FIT_ROWS * count)
    drawn = rows.withColumn("u", hash_fraction("id", "v", seed=3)).where(F.col("u") < max(min(1.0, wanted / total), 64 / total))
    # The limit holds where repeated rows are drawn together; the least hash stands in where none is drawn.
    sample = drawn.orderBy("u", "id").limit(2 * wanted).groupBy("v").agg(F.min("id").alias("id")).toArrow()
    sample = sample if sample.num_rows else rows.orderBy(hash_fraction("id", "v", seed=3), "id").limit(64).select("v", "id").toArrow()
    learned = _matrix(sample.sort_by("id").column("v"))
    # Vectors are divided by a power of two near their size, which changes no digit, so that single precision holds any scale.
    most = float(np.abs(learned).max())
    unit = 2.0 ** round(math.log2(most * math.sqrt(float(np.square(learned / most).mean()))))
    index = IvfPq.fit(learned / unit, count)
    shared = spark.sparkContext.broadcast(index)
    kind = "array<float>" if "float" in dict(rows.dtypes)["v"] else "array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: IvfPq = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1)) / unit
                at = assign(x, own.coarse)
                codes, square = own.encode(x, at)
                error = own.errors(x, at, codes).astype(np.float32)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), packed, pa.array(square), pa.array(error)], ["id", "v", "h", "list", "codes", "square", "error"])

    indexed = stored(rows.select("id", "v", F.xxhash64("v").alias("h")).mapInArrow(place, f"id long, v {kind}, h long, list int, codes binary, square double, error float"), "index")
    # A vector that very many rows share is thinned to its k + 1 smallest ids: the limit applies before the shuffle.
    hot = sized(indexed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 4 * (k + 1)).select("h"), "hot")
    if hot.head(1):
        from pyspark.sql import Window

        order = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
        few = indexed.join(hot, "h", "left_semi").dropDuplicates(["h", "v", "id"]).withColumn("_n", order).where(F.col("_n") <= k + 1).drop("_n")
        indexed = stored(indexed.join(hot, "h", "left_anti").unionByName(few), "thinned")

    def measured(sizes: np.ndarray, spread: np.ndarray) -> tuple[float, float]:
        """Where queries stop and the slack of estimates, from the true neighbours of at most ``CHECKED`` queries."""
        few = asked.select("id", "v").orderBy(hash_fraction("id", "v", seed=11), "id").limit(CHECKED).toArrow()
        if not few.num_rows:
            return 1 - recall, SLACK
        asking = spark.sparkContext.broadcast((np.asarray(few.column("id")), _matrix(few.column("v")) / unit))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, (qid, q) = shared.value, asking.value
            length = np.linalg.norm(q, axis=1)
            held = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.float64)]  # query, key, score, list, lack
            bar = np.full(len(q), -np.inf)
            seen = 0
            for whole in batches:
                lo = 0
                while lo < whole.num_rows:
                    batch = whole.slice(lo, max(64, min(1024, seen)))  # short pieces until the bars are up
                    lo, seen = lo + batch.num_rows, seen + batch.num_rows
                    ids, x, at = batch.column(0).to_numpy(), _matrix(batch.column(1)) / unit, batch.column(2).to_numpy()
                    codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
                    score = q @ x.T
                    who, row = np.nonzero((score > bar[:, None]) & (qid[:, None] != ids))
                    rough = np.einsum("pd,pd->p", own.decode(codes, at)[row], q[who])
                    lack = (score[who, row] - rough) / np.maximum(length[who] * batch.column(4).to_numpy()[row], 1e-150)
                    held = [np.concatenate(c) for c in zip(held, (who, ids[row], score[who, row], at[row].astype(np.int64), lack), strict=True)]
                    for order, once in ((np.lexsort((-held[2], held[1], held[0])), True), (None, False)):  # a key counts once, at its best
                        order = np.lexsort((held[1], -held[2], held[0])) if order is None else order
                        held = [c[order] for c in held]
                        same = held[0][1:] == held[0][:-1]
                        keep = np.append(True, ~(same & (held[1][1:] == held[1][:-1])))[: len(held[0])] if once else np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) < k
                        held = [c[keep] for c in held]
                    full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) == k)
                    bar[full] = held[2][np.searchsorted(held[0], full, side="right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["query", "key", "score", "list", "lack"])

        from pyspark.sql import Window

        found = indexed.select("id", "v", "list", "codes", "error").mapInArrow(compare, "query long, key long, score double, list long, lack double")
        found = found.groupBy("query", "key").agg(F.max(F.struct("score", "list", "lack")).alias("m")).select("query", "key", "m.*")
        near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
        true = found.withColumn("n", near).where(F.col("n") <= k).select("query", "list", "lack").toArrow()  # k rows a query
        if not true.num_rows:
            return 1 - recall, SLACK
        query, at, lack = (np.asarray(c) for c in true.columns)
        return index.stop(asking.value[1], sizes, spread, k, recall, query, at), max(SLACK, float(np.quantile(lack, WITHIN)))

    sizes, spread = np.zeros(len(index.coarse)), np.zeros(len(index.coarse))
    for r in indexed.groupBy("list").agg(F.count_distinct("id").alias("n"), F.avg("square").alias("s")).collect():  # one row a list
        sizes[r["list"]], spread[r["list"]] = r["n"], r["s"]
    room = max(256, min(cell_rows, math.ceil(sizes.sum() / 24)))
    begin, spans = _cells(sizes, room)
    stop, slack = measured(sizes, spread)
    facts = spark.sparkContext.broadcast((sizes, spread, begin, spans))
    layout = F.broadcast(spark.createDataFrame([(i, int(b), int(n)) for i, (b, n) in enumerate(zip(begin, spans, strict=True))], "list int, begin int, spans int"))  # at most 4,096 lists
    laid = indexed.join(layout, "list").select("id", "v", "list", "codes", "error", (F.col("begin") + F.pmod("h", "spans")).cast("int").alias("cell"))

    def search(asked: DataFrame, share: float | None) -> DataFrame:
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, (sizes, spread, begin, spans) = shared.value, facts.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    batch = whole.slice(lo, 1024)
                    who, at, want, floor = own.probes(_matrix(batch.column(1)) / unit, sizes, spread, k, recall, share, stop)
                    n = spans[at]
                    cell = np.repeat(begin[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    who, at, want, floor = (np.repeat(a, n) for a in (who, at, want, floor))
                    order = np.lexsort((at, cell, who))
                    who, at, want, floor, cell = who[order], at[order], want[order], floor[order], cell[order]
                    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (cell[1:] != cell[:-1])])) if len(who) else np.zeros(0, np.int64)
                    offsets = pa.array(np.append(first, len(who)).astype(np.int32))
                    take = pa.array(who[first])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(cell[first].astype(np.int32)),
                         *(pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (at, want, floor.astype(np.float32)))], ["id", "v", "cell", "lists", "want", "floor"])

        visits = asked.select("id", "v").mapInArrow(visit, f"id long, v {kind}, cell int, lists array<int>, want array<int>, floor array<float>")
        right = laid.withColumn("part", F.lit(0))
        left = visits.withColumn("part", F.lit(0))
        if asked.count() > cell_queries:
            visits = stored(visits, "visits")
            crowded = visits.groupBy("cell").agg(F.ceil(F.count("*") / cell_queries).cast("int").alias("copies")).where("copies > 1")
            crowded = sized(crowded, "crowded")
            right = laid.join(crowded, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
            left = visits.join(crowded, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["query", "key", "score"]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            own: IvfPq = shared.value
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            x, xid, at, error = _matrix(right.column("v")) / unit, np.asarray(right.column("id")), np.asarray(right.column("list")), np.asarray(right.column("error"))
            q, qid, asks = _matrix(left.column("v")) / unit, np.asarray(left.column("id")), left.column("lists").combine_chunks()
            who = np.repeat(np.arange(len(q)), np.diff(np.asarray(asks.offsets)))
            lists, want, floor = (np.asarray(left.column(c).combine_chunks().flatten()) for c in ("lists", "want", "floor"))
            out = []
            for one in np.unique(at).tolist():
                on, rows = lists == one, np.flatnonzero(at == one)
                if on.any():
                    out.append(search_list(own, one, q[who[on]], qid[who[on]], want[on], floor[on], x[rows], xid[rows], codes[rows], error[rows], k, slack))
            best = Found.of(out).best(k, several)
            return pa.table([pa.array(best.query), pa.array(best.key), pa.array(best.score * unit * unit)], names=names)

        found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(scan, "query long, key long, score double")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Found.of([])
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = Found.of([held, Found(*(np.asarray(c) for c in batch.columns))])
                goes_on = held.query == held.query[-1]
                yield emit(Found(held.query[~goes_on], held.key[~goes_on], held.score[~goes_on]))
                held = Found(held.query[goes_on], held.key[goes_on], held.score[goes_on]).best(k, several)
            yield emit(held)

        def emit(found: Found) -> pa.RecordBatch:
            best = found.best(k, several)
            rank = (np.arange(len(best.query)) - np.searchsorted(best.query, best.query) + 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(rank), pa.array(best.key), pa.array(best.score)], ["query_id", "rank", "vec_id", "score"])

        return found.repartition("query").sortWithinPartitions("query").mapInArrow(merge, schema)

    out = search(asked, probe)
    if several:
        # Keys with several vectors: a query whose visited lists hold too few different keys is asked again of all lists.
        out = stored(out, "neighbours")
        full = out.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, shape["ids"] - 1)).select(F.col("query_id").alias("id"))
        again = asked.join(full, "id", "left_anti")
        if again.head(1):
            again = stored(again, "again")
            out = out.join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(search(again, 1.0))
    return out.withColumnRenamed("vec_id", key)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of every vector whose id is divisible by 20.

    Nulls, unusable vectors, repeated rows, ties and empty tables: as :func:`nearest` states.
    """
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
