"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by their number of distinct five-word shingles, a partition holding l to u of them with u below
2 l. A text that holds a share t of an item's shingles lacks at most m = floor((1 - t) u) of them. The partition therefore
gets bottom-k MinHash signatures of k = m + h values, of which at least h must be met in a text; h grows with the
partition's size (u / 8, at most t l), so that long items need several hits before a text is verified against them,
and no match is missed, however long the text. Every text is read once, without a shuffle: its shingle hashes are looked
up in the signatures, and each text and item that meet often enough are compared on the shingles themselves.

Words are maximal runs of ASCII letters, digits and non-ASCII characters; A-Z are lower-cased.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, stored, table, tuned
from .textkernel import ALNUM, LOWER, running, slices, spans_of, word_hashes, word_spans

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Items and bytes of items that one pass over the texts holds; more items take more passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_FILTER_BITS = 22


def item_shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    words = _WORD.findall(text.lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass(frozen=True)
class Shingles:
    """Every run of ``width`` words that lies in one text: its hash, text number and first word, with the words' spans."""

    keys: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offsets: np.ndarray, width: int) -> Shingles:
        low = LOWER[buf]
        starts, ends, owner = word_spans(low, offsets, ALNUM)
        if len(starts) < width:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), starts, ends)
        words = word_hashes(low, starts, ends, 0)
        first = np.arange(len(words) - width + 1)
        first = first[owner[first] == owner[first + width - 1]]
        return cls(spans_of(running(words, 1), first, first + width, 1), owner[first], first, starts, ends)


@dataclass
class Sketches:
    """Sorted signature values with the items they stand for, a bit filter before them, and the items' texts."""

    width: int
    threshold: float
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    filter: np.ndarray = field(default_factory=lambda: np.zeros(1 << _FILTER_BITS, bool))
    texts: list[bytes] = field(default_factory=list)
    need: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: list = field(default_factory=list)
    memo: dict[int, tuple[set, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list, width: int, threshold: float, hits: int = 8) -> Sketches:
        self = cls(width, threshold)
        partitions: dict[int, list[tuple[int, np.ndarray]]] = {}
        for key, text in rows:
            raw = text.encode()
            keys = np.unique(Shingles.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), width).keys)
            if len(keys):
                partitions.setdefault(len(keys).bit_length(), []).append((len(self.ids), keys))
                self.ids.append(key)
                self.texts.append(raw)
        self.need = np.ones(len(self.ids), np.int64)
        values, owners = [], []
        for members in partitions.values():
            least, most = min(len(h) for _, h in members), max(len(h) for _, h in members)
            need = max(1, min(math.ceil(threshold * least - 1e-9), 1 + most // hits))
            k = math.floor((1 - threshold) * most + 1e-9) + need
            for at, h in members:
                self.need[at] = need
                values.append(h[:k])
                owners.append(np.full(min(k, len(h)), at))
        if values:
            self.hashes, self.items = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.items = self.hashes[order], self.items[order]
            self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return self

    def item(self, i: int) -> tuple[set, np.ndarray]:
        """The item's shingles and their hashes."""
        if i not in self.memo:
            if len(self.memo) >= 1024:
                self.memo.clear()
            raw = self.texts[i]
            self.memo[i] = item_shingles(raw, self.width), np.unique(Shingles.of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), self.width).keys)
        return self.memo[i]

    def candidates(self, s: Shingles) -> np.ndarray:
        """(pairs, 2) of text and item numbers that share as many signature values as the item's partition asks for."""
        maybe = self.filter[(s.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        keys, owner = s.keys[maybe], s.owner[maybe]
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[once], owner[once]
        lo = np.searchsorted(self.hashes, keys, "left")
        n = np.searchsorted(self.hashes, keys, "right") - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs, hits = np.unique(np.stack([np.repeat(owner, n), self.items[at]], axis=1), axis=0, return_counts=True)
        return pairs[hits >= self.need[pairs[:, 1]]]

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, matched, shingles) of every pair that reaches the threshold."""
        s = Shingles.of(buf, offsets, self.width)
        for d, i in self.candidates(s).tolist():
            grams, hashes = self.item(i)
            a, b = np.searchsorted(s.owner, [d, d + 1])
            here = a + np.flatnonzero(np.isin(s.keys[a:b], hashes))
            _, once = np.unique(s.keys[here], return_index=True)
            # Hashes tell the places, the words themselves decide.
            found = {tuple(LOWER[buf[s.starts[w] : s.ends[w]]].tobytes() for w in range(f, f + self.width)) for f in s.first[here[once]].tolist()}
            m = len(grams & found)
            if m >= self.threshold * len(grams) - 1e-9:
                yield d, i, m, len(grams)


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", *, width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(key, item key, matched, shingles, containment) of every text and item with containment >= ``threshold``.

    Null and empty texts and items, and those of fewer than ``width`` words, match nothing. Long texts are searched whole.
    Repeated rows of either table each get their own result rows; there are no ties to break. An empty table gives no
    rows. Other columns, whatever their names, are not looked at. Items are processed in blocks of bounded size, one pass
    over the texts each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Rows that repeat an item are counted, not carried: however many there are, a block holds the item once.
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("text is not null").groupBy("item", "text").agg(F.count("*").alias("rows"))
    items = stored(items, "items")
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(total["n"] / BLOCK_ITEMS), math.ceil(total["bytes"] / BLOCK_BYTES))
    schema = T.StructType([
        T.StructField(key, docs.schema["key"].dataType), T.StructField(item_key, items.schema["item"].dataType),
        T.StructField("matched", T.LongType()), T.StructField("shingles", T.LongType()), T.StructField("containment", T.DoubleType())])

    def search(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(Sketches.of([((r["item"], r["rows"]), r["text"]) for r in block.collect()], width, threshold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s: Sketches = shared.value
            for part, buf, offsets in slices(batches, "text"):
                keys = part.column(0)
                rows = [(keys[d].as_py(), s.ids[i][0], m, n, m / n) for d, i, m, n in s.matches(buf, offsets) for _ in range(s.ids[i][1])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names)

        names = [key, item_key, "matched", "shingles", "containment"]
        return docs.mapInArrow(run, schema)

    arrow = [_arrow(schema[key].dataType), _arrow(schema[item_key].dataType), pa.int64(), pa.int64(), pa.float64()]
    parts = [search(items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items) for b in range(blocks)]
    return reduce(DataFrame.union, parts)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, matched, shingles, containment of every contaminated document and item.

    Edge cases as :func:`contained_items` states.
    """
    tuned(spark)
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), dg AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) AS g FROM docs)
), ig AS (
  SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) AS g FROM items)
), n AS (SELECT item_id, count(*) AS shingles FROM ig GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, matched, shingles, matched::DOUBLE / shingles AS containment
FROM m JOIN n USING (item_id) WHERE matched >= 0.8 * shingles - 1e-9
"""


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item go on, columns as they are; the others go.

    The decision is made in one pass beside the text, so whole rows never shuffle. Rows alike in doc_id and text are decided
    alike, a null doc_id is a key like others; null and empty texts hold nothing and go on; long texts are searched whole.
    No items, or no documents, leave the table as it is. Columns, whatever their names, stay as they are.
    """
    tuned(spark)
    names = docs.columns
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    dirty = sized(contained_items(keyed, table(spark, sf_dir, "benchmark"), key="key").select("key").distinct(), "dirty").alias("x")
    rows = docs.alias("d")
    return rows.join(dirty, F.struct(F.col("d.doc_id"), F.xxhash64("d.text").alias("h")).eqNullSafe(F.col("x.key")), "left_anti").select(*[F.col(f"d.`{c}`") for c in names])
