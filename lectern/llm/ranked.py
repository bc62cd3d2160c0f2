"""Ranked lexical search with a two-level quantised index.

The index has a row a document: the hashes of its terms, one byte of impact a term, and the term counts. An impact byte is a
term's share of the score, before its weight, in steps of ``STEP``, rounded up; so the weighted sum of the bytes is never
below the exact score and less than the sum of the weights above it. A search takes the items in blocks of bounded size
and reads the index once a block. A task holds, for each item, the best ``k`` documents it has seen: the k-th of their
exact scores and of the lower bounds of the batch is a lower bound of the k-th score, and every document whose upper bound
reaches it is scored again in 64-bit integers. What a task returns is ``k`` rows an item, merged in two grouped steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, stored, table, tuned
from .textkernel import ALNUM, LOWER, slices, word_hashes, word_spans

K = 10
#: Score of a term before its weight is below 1,000,000: 255 steps cover it.
STEP = 3922
#: Terms of the items of a block, and scores of a batch's documents that are held at a time.
BLOCK_TERMS, CELLS = 200_000, 1 << 20
#: Distinct terms of all items up to which they are broadcast.
FEW_TERMS = 200_000


def bag(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term hash and count of every distinct term of every text, and the terms of each text with repeats."""
    starts, ends, owner = word_spans(buf, offsets, ALNUM)
    keys = word_hashes(LOWER[buf], starts, ends, 0)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], keys[first].view(np.int64), np.diff(np.append(first, len(keys))), np.bincount(owner, minlength=len(offsets) - 1)


def term_counts(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for _, buf, offsets in slices(batches, "text"):
            owner = word_spans(buf, offsets, ALNUM)[2]
            docs, total = docs + int((np.diff(owner, prepend=-1) != 0).sum()), total + len(owner)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "total"])

    row = texts.select("text").mapInArrow(count, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    return row["docs"] or 0, row["total"] or 0


def term_share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact score of a term before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Index:
    """``rows``: id, m (length norm), terms, impacts and counts of every document with a term."""

    rows: DataFrame
    docs: int
    total: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The stored index of all documents. Null texts and texts without a term are not in it; long texts count whole.

    Repeated rows are documents of their own; a null key is kept. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    n, total = term_counts(rows)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in slices(batches, "text"):
            owner, terms, tf, length = bag(buf, offsets)
            some = np.flatnonzero(length)
            if not len(some):
                continue
            m = 100 - 90 + (90 * length * n) // total
            impacts = -(-term_share(tf, m[owner]) // STEP)
            at = np.searchsorted(owner, some)
            ends = np.append(at, len(owner)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(some)), pa.array(m[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(terms)),
                pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(impacts.astype(np.uint8).tobytes())]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))], ["id", "m", "terms", "impacts", "counts"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL("m long, terms array<long>, impacts binary, counts array<int>")])
    return Index(stored(rows.mapInArrow(build, schema), "lexical-index"), n, total)


def item_terms(items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Stored (item, mark, term) of the distinct terms of every distinct item; ``mark`` tells texts of one key apart."""
    rows = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    rows = rows.withColumn("mark", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in slices(batches, "text"):
            owner, terms, _, _ = bag(buf, offsets)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(2).take(at), pa.array(terms)], ["item", "mark", "term"])

    schema = T.StructType([T.StructField("item", rows.schema["item"].dataType), *T.StructType.fromDDL("mark long, term long")])
    return stored(rows.mapInArrow(cut, schema).distinct(), "item-terms")


def weights(index: Index, wanted: DataFrame) -> DataFrame:
    """Stored (item, mark, term, w) of the items' terms that some document holds."""
    terms, postings = stored(wanted.select("term").distinct(), "terms"), index.rows.select(F.explode("terms").alias("term"))
    if terms.count() <= FEW_TERMS:
        postings, terms = postings.join(F.broadcast(terms), "term"), None
    df = postings.groupBy("term").agg(F.count("*").alias("df"))  # many terms are counted before they are joined, so no hot term is shuffled
    df = df if terms is None else df.join(terms, "term")
    w = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return stored(wanted.join(sized(df, "df"), "term").select("item", "mark", "term", w.alias("w")).where("w > 0"), "weights")


class Block:
    """Terms of a block of items: for each term the items that hold it and their weights."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, w: np.ndarray, n: int) -> None:
        order = np.argsort(terms, kind="stable")
        self.terms, self.begin = np.unique(terms[order], return_index=True)
        self.begin = np.append(self.begin, len(terms))
        self.items, self.w, self.n = items[order], w[order], n


class Best:
    """The best ``k`` documents of every item: by score, then by id, null ids last."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.item, self.score, self.id, self.null = (np.zeros(0, np.int64) for _ in range(4))

    def bounds(self, lower: np.ndarray) -> np.ndarray:
        """A lower bound of each item's k-th score, from the scores held and the bounds of further documents x items."""
        held = np.zeros((self.k, self.n), np.int64)
        at = np.arange(len(self.item)) - np.searchsorted(self.item, self.item)
        held[at, self.item] = self.score
        both = np.concatenate([held, lower])
        return np.maximum(1, np.partition(both, len(both) - self.k, axis=0)[len(both) - self.k])

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, score, ids, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        order = order[np.arange(len(item)) - np.searchsorted(item, item) < self.k]
        self.item, self.score, self.id, self.null = np.sort(item[np.arange(len(item)) - np.searchsorted(item, item) < self.k]), score[order], ids[order], null[order]


def expand(block: Block, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``terms``, item and weight of every item that holds one of these terms."""
    if not len(block.terms):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
    hit = np.flatnonzero(block.terms[at] == terms)
    low, n = block.begin[at[hit]], block.begin[at[hit] + 1] - block.begin[at[hit]]
    entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(hit, n), block.items[entry], block.w[entry]


def rescored(block: Block, best: Best, owner: np.ndarray, terms: np.ndarray, impacts: np.ndarray, counts: np.ndarray, m: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
    """Take some documents into ``best``: bounds by impact bytes, then exact scores of those that reach the k-th."""
    place, item, w = expand(block, terms)
    doc, cells = owner[place], len(m) * block.n
    cell = doc * block.n + item
    upper = STEP * np.bincount(cell, w * impacts[place], cells).astype(np.int64).reshape(len(m), block.n)
    lower = upper - STEP * np.bincount(cell, w, cells).astype(np.int64).reshape(len(m), block.n)
    close = upper >= best.bounds(lower)
    of = np.flatnonzero(close.ravel()[cell])
    exact = np.zeros(cells, np.int64)
    np.add.at(exact, cell[of], w[of] * term_share(counts[place[of]].astype(np.int64), m[doc[of]]))
    found = np.flatnonzero(exact)
    best.add(found % block.n, exact[found], ids[found // block.n], null[found // block.n])


def _blocks(found: DataFrame, most: int) -> Iterator[tuple[list[tuple], Block]]:
    """Blocks of items of about ``most`` terms each: the items' keys, and their terms."""
    blocks = max(1, math.ceil(found.count() / most))
    for b in range(blocks):
        rows = (found.where(F.pmod(F.xxhash64(F.lit(31), "item", "mark"), F.lit(blocks)) == b) if blocks > 1 else found).toArrow()
        keys = list(zip(rows.column("item").to_pylist(), rows.column("mark").to_pylist(), strict=True))
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        yield list(names), Block(np.array([names[k] for k in keys], np.int64), rows.column("term").to_numpy(), rows.column("w").to_numpy(), len(names))


def _best_rows(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, item_key: str = "item_id", item_text: str = "text", k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, mark, rank, id, score): the ``k`` best documents of every item with a score above 0, ties by ascending id.

    Null items and items whose terms no document holds have no rows. Repeated rows of an item count once; texts that
    share a key are ranked apart (``mark``). A null id of a document comes after all others of its score. Long items are
    read whole. Empty tables give no rows. Other columns are not looked at.
    """
    spark = index.rows.sparkSession
    found = weights(index, item_terms(items, item_key, item_text))
    kinds = {"item": found.schema["item"].dataType, "id": index.rows.schema["id"].dataType}
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    parts = []
    for names, block in _blocks(found, block_terms):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            best = Best(block.n, k)
            step = max(1, CELLS // max(1, block.n))
            for whole in batches:
                for lo in range(0, whole.num_rows if block.n else 0, step):
                    batch = whole.slice(lo, step)
                    lists, marks = batch.column("terms"), batch.column("impacts")
                    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                    bytes_of = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).astype(np.int64)
                    ids, null = batch.column("id").fill_null(0).to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                    rescored(block, best, np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), bytes_of, batch.column("counts").flatten().to_numpy(), batch.column("m").to_numpy(), ids, null)
            yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.id, mask=best.null.astype(bool)), pa.array(best.score)], ["at", "id", "score"])

        told = index.rows.select(F.col("id").cast("long"), "m", "terms", "impacts", "counts").mapInArrow(run, schema)
        told = _best_rows(told.withColumn("salt", F.spark_partition_id() % 64), [F.col("at"), F.col("salt")], k)
        told = _best_rows(told.drop("rank", "salt"), [F.col("at")], k)
        known = spark.createDataFrame([(i, *key) for i, key in enumerate(names)], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("item", kinds["item"]), T.StructField("mark", T.LongType())]))
        parts.append(told.join(F.broadcast(known), "at").select("item", "mark", "rank", F.col("id").cast(kinds["id"]).alias("id"), "score"))
    return reduce(DataFrame.union, parts)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of every ``benchmark`` item's best documents; edge cases as :func:`search` states."""
    index = build_index(table(tuned(spark), sf_dir, "documents"))
    found = search(index, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents
), lengths AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) n FROM docs WHERE len(w) > 0),
facts AS (SELECT count(*) nd, CAST(sum(n) AS BIGINT) l FROM lengths),
norms AS (SELECT r, doc_id, 100 - 90 + ((90 * n * nd) // l) m FROM lengths, facts),
postings AS (SELECT r, t, count(*) tf FROM (SELECT r, unnest(w) t FROM docs) GROUP BY r, t),
terms AS (SELECT DISTINCT item_id, t FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark)),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) w FROM (SELECT t, count(*) df FROM postings GROUP BY t), facts),
scores AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
  FROM terms JOIN weights USING (t) JOIN postings USING (t) JOIN norms USING (r) GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM scores JOIN norms USING (r) WHERE score > 0) WHERE rank <= 10"""
