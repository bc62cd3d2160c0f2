"""SimHash near-duplicates, candidates thinned by pivot distance tables.

Distinct fingerprints are keyed by equal bit blocks (pigeonhole: of ``blocks`` blocks at least ``match`` are equal when
at most ``radius`` bits differ and blocks - match >= radius), so no link is lost. A group of a key above ``cell`` rows is
keyed again by equal parts of its other bits, and what is still above is cut into pairs of chunks. Within a cell the Hamming distances to ``PIVOTS`` reference fingerprints are computed
once per row; a pair whose largest coordinate difference exceeds the radius is discarded (triangle inequality), the
survivors are verified bit by bit. Only a spanning forest of each cell's links leaves it, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, stored, table, tuned
from .components import connected_components

PIVOTS = 16
_PIVOT_SEED = 20240229
#: Shingles unpacked to bits and bytes of text cut to words at a time.
_CHUNK, _PIECE = 1 << 17, 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, from pieces of about ``_PIECE`` bytes cut at blanks."""
    lo = 0
    while lo < len(text):
        hi = lo + _PIECE
        if hi < len(text):
            cut = _BLANK.search(text, hi)
            hi = cut.start() if cut else len(text)
        yield text[lo:hi].lower().split()
        lo = hi


def shingle_hashes(text: bytes, width: int = 3) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased, piece by piece; fewer words: of all; none: nothing."""
    digest = xxhash.xxh64_intdigest
    carried: list[bytes] = []
    any_run = False
    for words in _word_pieces(text):
        words = carried + words
        if len(words) >= width:
            any_run = True
            joined = memoryview(b" ".join(words))
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: len(words) - width + 1].tolist()
            yield np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        carried = words[max(0, len(words) - width + 1) :]
    if carried and not any_run:
        yield np.array([digest(b" ".join(carried), 42)], np.uint64)


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in more than half of the hashes; none: 0."""
    total, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        for i in range(0, len(h), _CHUNK):
            total += np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """``docs`` with the 64-bit SimHash of the text (as a signed long) in place of the text. Null counts as empty."""
    keep = [c for c in docs.columns if c not in (text, out)]
    docs = docs.select(*keep, text)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            prints = [fingerprint(shingle_hashes(t.as_py() or b"", width)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.array(prints, np.uint64).view(np.int64))], [*keep, out])

    return docs.mapInArrow(run, schema)


class Forest:
    """Union-find over the rows of one cell; labels are flat after each batch."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """The given links that joined two trees."""
        kept = []
        apart = self.label[i] != self.label[j]
        if not apart.any():
            return kept
        i, j = i[apart], j[apart]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for a, b, x, y in zip(i.tolist(), j.tolist(), self.label[i].tolist(), self.label[j].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
        old = np.array(list(parent), dtype=np.int64)
        if len(old):
            to = np.arange(len(self.label))
            to[old] = [find(x) for x in parent]
            self.label = to[self.label]
        return kept


def links_by_shift(key: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the rows (sorted by key) whose keys are equal and whose prints differ in <= radius bits."""
    rng = np.random.default_rng(_PIVOT_SEED)
    pivots = rng.integers(0, 1 << 64, PIVOTS, dtype=np.uint64)
    distances = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    last = np.cumsum(size)[group]  # rows are sorted, so a group's rows end here
    forest, out = Forest(len(key)), []
    rows = np.arange(len(key))
    shift = 1
    while True:
        rows = rows[rows + shift < last[rows]]
        if not len(rows):
            return out
        near = np.abs(distances[rows] - distances[rows + shift]).max(axis=1) <= radius
        i = rows[near]
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= radius]
        out += forest.add(i, i + shift)
        shift += 1


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def near_links(prints: DataFrame, radius: int = 3, *, blocks: int = 4, match: int = 1, cell: int = 1024) -> DataFrame:
    """(src, dst) links of distinct fingerprints (column fp, long): a spanning forest of every cell's links.

    ``blocks=4, match=1`` suits up to some 10^7 fingerprints, ``blocks=6, match=3`` (32-bit keys) more; both are exact.
    """
    if blocks - match < radius:
        raise ValueError("blocks - match must reach the radius")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks, finer = [], []
    for chosen in combinations(range(blocks), match):
        own = [bit for b in chosen for bit in range(edges[b], edges[b + 1])]
        rest = [bit for bit in range(64) if bit not in own]
        parts = [round(len(rest) * i / (radius + 1)) for i in range(radius + 2)]
        masks.append(_mask(own))
        finer.append([_mask(rest[i:j]) for i, j in zip(parts[:-1], parts[1:], strict=True)])
    anded = lambda m: F.col("fp").bitwiseAND(F.lit(m).cast("long"))
    keyed = prints.select("fp", F.posexplode(F.array(*[anded(m) for m in masks])).alias("table", "block"))
    keyed = keyed.select("fp", "table", F.xxhash64("table", "block").alias("key"))
    # The prints of a large group differ in at most `radius` of the other bits, so they agree in one of radius + 1 parts of those.
    crowded = lambda df: df.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = sized(crowded(keyed).select("key", F.lit(True).alias("_large")), "large")
    marked = keyed.join(large, "key", "left")
    parts_of = F.element_at(F.array(*[F.array(*[anded(m) for m in ms]) for ms in finer]), F.col("table") + 1)
    split = marked.where("_large").select("fp", "key", F.posexplode(parts_of).alias("part", "value")).select("fp", F.xxhash64("key", "part", "value").alias("key"))
    largest = sized(crowded(split).select("key", F.ceil(F.col("n") / (cell // 2)).cast("int").alias("chunks")), "largest")
    whole = marked.where("_large is null").select("fp", "key", F.lit(1).alias("chunks"))
    parted = whole.unionByName(split.join(largest, "key", "left").select("fp", "key", F.coalesce("chunks", F.lit(1)).alias("chunks")))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "chunks").cast("int"))
    # A cell is a pair of chunks (low, high); a row goes to every cell that its chunk is part of.
    cells = parted.select("fp", F.explode(F.expr("transform(sequence(0, chunks - 1), c -> xxhash64(key, least(own, c), greatest(own, c)))")).alias("cell"))
    cells = cells.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            got = np.array(links_by_shift(key, fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[got[:, 0]]), pa.array(fp[got[:, 1]])], ["src", "dst"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0  # the last group may go on
            if cut > 1 << 13:
                yield links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            held_key, held_fp = key, fp
        if len(held_key):
            yield links(held_key, held_fp)

    return cells.mapInArrow(run, "src long, dst long")


def _classes(docs: DataFrame, key: str, text: str, radius: int, **kw) -> DataFrame:
    """(key, fp, root, component_id) of every row; root, the class's fingerprint, tells apart classes of one smallest key."""
    rows = stored(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    roots = stored(connected_components(near_links(prints, radius, **kw)), "roots")
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, **kw) -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the smallest key reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other; long texts are read whole, in pieces. A null
    key stays null and is never a component's id unless no other key is reachable. Repeated rows get a row each. Links are
    decided by bits alone, so there are no ties. An empty table gives none. Other columns, whatever their names, are not
    looked at.
    """
    return _classes(docs, key, text, radius, **kw).select(key, "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document; edge cases as :func:`near_duplicates` states."""
    found = near_duplicates(table(tuned(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one of smallest doc_id.

    Rows without a doc_id can't be told from each other by it; of a class in which no row has one, and of repeated
    doc_ids within a class, one row each stays: the first by fingerprint, then by two hashes of all its columns. A doc_id
    that several texts carry stays once in each class whose smallest it is. Null and empty texts are a class of their own
    and of what links to it; long texts are read whole; an empty table gives no rows. Columns, whatever their names, stay
    as they are.
    """
    tuned(spark)
    names = docs.columns
    found = _classes(docs.select("doc_id", "text"), "doc_id", "text", 3)
    gone = found.where("not (doc_id <=> component_id)").select("doc_id")
    twice = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "twice")
    leave = sized(gone.union(twice).distinct(), "leave").alias("x")
    rows = docs.alias("d")
    columns = [F.col(f"d.`{c}`") for c in names]
    sole = rows.where("d.doc_id is not null").join(leave, F.col("d.doc_id") == F.col("x.doc_id"), "left_anti").select(*columns)
    if twice.isEmpty():
        return sole
    again = rows.join(twice.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left_semi")
    again = again.select(F.struct(*columns).alias("row"), F.col("d.doc_id").alias("id"), F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"), F.col("d.text").alias("body"))
    again = with_fingerprint(again, "body", "fp")
    classes = found.select("fp", "root", "component_id").distinct()
    best = again.join(classes, "fp").where("id <=> component_id")
    first = best.groupBy("root").agg(F.min_by("row", F.struct("fp", "h1", "h2")).alias("row"))
    return sole.unionByName(first.select("row.*"))
