"""Fuzzy line dedup by MinHash.

A line (text between line feeds, as it stands) is the set of its runs of ``SHINGLE`` characters, a shorter line the
set of itself. Equal lines are one node. MinHash signatures of ``BANDS`` x ``ROWS`` values give band keys; at a Jaccard
similarity of 0.8 a pair shares a key with probability 1 - (1 - 0.8^3)^8 = 0.997. Keys held by two or more different
lines survive; only their lines' texts are fetched, by a scan filtered with a bit table of bounded size. In cells of
bounded size the exact Jaccard similarity of each pair is computed, a spanning forest of the links leaves the cell, and
distributed union-find makes components. Of each component the first line, by (key, text hash, line number), is kept.

A band that many lines of one small piece of text share already is known to be shared: its rows are dealt out by id and
only a marker meets the rows that other pieces have of it, so no task reads a hot band alone. A band of more lines than a
cell is first verified in chunks that each hold the band's ``PIVOTS`` too; lines alike one template thus become one
component in time linear in their number. Only lines outside the band's largest component are then compared with all others.

Lines are identified by 64-bit hashes for linking and by 128 bits for equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sized, stored, table, tuned
from .components import connected_components
from .simhash import Forest
from .textkernel import running, spans_of

SHINGLE, BANDS, ROWS, THRESHOLD = 8, 8, 3, 0.8
#: Lines of a crowded band that every chunk of it holds; lines of one piece of text that make a band hot.
PIVOTS, HOT = 8, 16
_RNG = np.random.default_rng(97)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Most words of 64 bits in the table of line ids (16 MB).
_FILTER_WORDS = 1 << 21


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts; start, end, text number and line number of every non-empty line."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    feeds = np.flatnonzero(points == 10)
    starts, ends = np.concatenate([[0], feeds + 1]), np.append(feeds, len(points))
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.searchsorted(begin, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, begin)[owner]
    full = ends > starts
    return points, starts[full], ends[full], owner[full], number[full]


def _pieces(batches: Iterator[pa.RecordBatch], at: int, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str], int]]:
    """Batches cut to about ``most`` characters, with the number of the first line; a null text counts as empty.

    A piece holds whole rows, or whole lines of one longer row.
    """
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        lo = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(lo, i - lo), texts[lo:i], 0
                lo, size = i, 0
            if len(t) > 2 * most:  # lo == i
                begin = line = 0
                while len(t) - begin > 2 * most and (feed := t.find("\n", begin + most)) >= 0:
                    part = t[begin:feed]
                    yield batch.slice(i, 1), [part], line
                    begin, line = feed + 1, line + part.count("\n") + 1
                yield batch.slice(i, 1), [t[begin:]], line
                lo = i + 1
                continue
            size += len(t) + 1
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:], 0


def shingle_values(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, line after line, and where each line's begin."""
    counts = np.maximum(ends - starts - (SHINGLE - 1), 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(starts - first[:-1], counts) + np.arange(first[-1])
    till = np.minimum(at + SHINGLE, np.repeat(ends, counts))
    return spans_of(running(points, 0), at, till, 0), first[:-1]


def signatures(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(lines, BANDS) band keys."""
    values, first = shingle_values(points, starts, ends)
    x = (values >> np.uint64(32)).astype(np.uint32)
    y = np.empty_like(x)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), np.uint64(b + 1))
        for r in range(b * ROWS, b * ROWS + ROWS):
            np.bitwise_xor(x, _XOR[r], out=y)
            np.multiply(y, _MUL[r], out=y)
            key = (key ^ np.minimum.reduceat(y, first).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return keys


def line_ids(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, ...]:
    return tuple(spans_of(running(points, w), starts, ends, w).view(np.int64) for w in which)


def hot_keys(keys: np.ndarray) -> np.ndarray:
    """Sorted keys that occur ``HOT`` times or more; a count of their first 16 bits rules most out."""
    bucket = keys.view(np.uint64) >> np.uint64(48)
    full = np.bincount(bucket.astype(np.int64), minlength=1 << 16) >= HOT
    if not full.any():
        return keys[:0]
    found, n = np.unique(keys[full[bucket]], return_counts=True)
    return found[n >= HOT]


def _shared(own: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Numbers of common values of all pairs of rows, from products of blocks of the row by value matrix."""
    value, row = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column, held = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(value)))
    common = held[column] > 1  # a value of one row alone is common to no pair
    column, row = (np.cumsum(held > 1) - 1)[column[common]], row[common]
    out = np.zeros((len(own), len(own)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        m = np.zeros((len(own), 2048), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def links_in_cell(key: np.ndarray, lines: list[str], threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of one key with Jaccard similarity >= threshold; rows are sorted by key."""
    points, starts, ends, _, _ = cut(lines)
    values, first = shingle_values(points, starts, ends)
    edges = [*first.tolist(), len(values)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        values[a:b].sort()
    once = np.ones(len(values), bool)
    once[1:] = values[1:] != values[:-1]
    once[first] = True
    sizes = np.add.reduceat(once.astype(np.int64), first)
    sets = np.split(values[once], np.cumsum(sizes)[:-1])
    out: list[tuple[int, int]] = []
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        n = sizes[lo:hi]
        if hi - lo == 2:
            if threshold * n.max() > n.min():
                continue
            both = np.concatenate(sets[lo:hi])
            both.sort()
            both = int(np.count_nonzero(both[1:] == both[:-1]))
            if both >= threshold * (int(n.sum()) - both) - 1e-9:
                out.append((lo, lo + 1))
            continue
        shared = _shared(sets[lo:hi], n)
        i, j = np.nonzero(np.triu(shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-6, 1))
        out += [(lo + a, lo + b) for a, b in Forest(hi - lo).add(i, j)]
    return out


def _bit_table(ids: DataFrame, n: int) -> np.ndarray:
    """A bit for each of some ``n`` ids (ids are hashes): at most ``_FILTER_WORDS`` rows reach the driver."""
    words = min(_FILTER_WORDS, 1 << max(10, (n // 8).bit_length()))
    word = F.shiftrightunsigned("id", 6).bitwiseAND(F.lit(words - 1))
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    got = ids.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[np.asarray(got.column("w"), np.int64)] = np.asarray(got.column("bits"), np.int64)
    return out.view(np.uint64)


def gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``least`` rows or more: those of a session for long texts are short, and narrow rows cost by the batch."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, id) of the rows of bands that hold two different ids.

    Input rows (band, kind, id) are sorted; kind 0 marks a band as shared, 1 is a row of a hot band, 2 any other row. Of
    a band that goes on in the next batch only its last id, its first row and whether it is shared are held.
    """
    band_, first, last, shared = None, None, None, False
    for batch in batches:
        band, kind, ids = (c.to_numpy() for c in batch.columns)
        if not len(band):
            continue
        plain = kind == 2
        begins = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(np.append(begins, len(band)))
        which = np.repeat(np.arange(len(begins)), size)
        # The first id of the band, here or in the batch before; a marker or a row of another id makes it shared.
        at = np.where(plain, np.arange(len(band)), len(band))
        lead = np.minimum.reduceat(at, begins)
        lead_id = np.where(lead < len(band), ids[np.minimum(lead, len(band) - 1)], 0)
        goes_on = band_ is not None and band[0] == band_
        if goes_on and first is not None:
            lead_id[0] = first
        many = np.bitwise_or.reduceat((kind == 0) | (plain & (ids != lead_id[which])), begins)
        late = None
        if goes_on:
            if many[0] and not shared and first is not None:
                late = first
            many[0] |= shared
        keep = (kind == 1) | (plain & many[which])
        fresh = np.ones(len(band), bool)
        fresh[1:] = (band[1:] != band[:-1]) | (ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1])
        if goes_on and plain[0] and last == ids[0]:
            fresh[0] = False
        keep &= fresh
        out_band, out_ids = band[keep], ids[keep]
        if late is not None:
            out_band, out_ids = np.append(out_band, band_), np.append(out_ids, late)
        new = not goes_on or len(begins) > 1
        band_, shared = band[-1], bool(many[-1])
        if lead[-1] < len(band):
            first = lead_id[-1] if new or first is None else first
            last = ids[-1] if plain[-1] else last
        elif new:
            first, last = None, None
        if len(out_band):
            yield pa.RecordBatch.from_arrays([pa.array(out_band), pa.array(out_ids)], ["band", "id"])


def fuzzy_links(docs: DataFrame, text: str = "text", *, threshold: float = THRESHOLD, cell: int = 512) -> DataFrame:
    """(src, dst) links between line ids whose lines reach the similarity and share a band key: their components are
    those of all such links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text")).where("text is not null")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts, _ in _pieces(batches, 0):
            points, starts, ends, _, _ = cut(texts)
            if not len(starts):
                continue
            ids = line_ids(points, starts, ends, (0,))[0]
            _, once = np.unique(ids, return_index=True)
            fresh = np.array([i for i, v in zip(once.tolist(), ids[once].tolist(), strict=True) if v not in seen], np.int64)
            if len(seen) < 500_000:  # repeats beyond are sent again and met after the shuffle
                seen.update(ids[fresh].tolist())
            if len(fresh):
                keys = signatures(points, starts[fresh], ends[fresh]).view(np.int64).ravel()
                own = np.repeat(ids[fresh], BANDS)
                marked = hot_keys(keys)
                kind = np.full(len(keys), 2, np.int8)
                if len(marked):
                    kind[np.isin(keys, marked)] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(keys, marked)), pa.array(np.append(kind, np.zeros(len(marked), np.int8))), pa.array(np.append(own, np.zeros(len(marked), np.int64)))], ["band", "kind", "id"])

    pairs = rows.mapInArrow(bands, "band long, kind byte, id long")
    pairs = pairs.repartition(F.when(F.col("kind") == 1, F.xxhash64("band", "id")).otherwise(F.col("band"))).sortWithinPartitions("band", "kind", "id")
    alive = stored(pairs.mapInArrow(lambda batches: shared_rows(gathered(batches)), "band long, id long"), "bands")
    total = alive.count()
    ids = alive.select("id").distinct()
    bits = spark.sparkContext.broadcast(_bit_table(ids, total))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        seen: set[int] = set()
        for _, texts, _ in _pieces(batches, 0):
            points, starts, ends, _, _ = cut(texts)
            if not len(starts):
                continue
            own = line_ids(points, starts, ends, (0,))[0]
            u = own.view(np.uint64)
            some = np.flatnonzero((known[(u >> np.uint64(6)) & np.uint64(len(known) - 1)] >> (u & np.uint64(63))) & np.uint64(1))
            _, once = np.unique(own[some], return_index=True)
            some = np.array([i for i in some[once].tolist() if own[i] not in seen], np.int64)
            if len(seen) < 500_000:
                seen.update(own[some].tolist())
            if len(some):
                joined = "\n".join(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[some]), pa.array([joined[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], pa.string())], ["id", "line"])

    lines = rows.mapInArrow(fetch, "id long, line string")
    known = stored(lines.join(ids, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")), "lines")
    crowded = alive.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = sized(crowded.select("band", F.ceil(F.col("n") / (cell // 2)).cast("int").alias("chunks")), "large")
    split = bool(large.head(1))
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_, ids_, lines_ = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def links(c: np.ndarray, i: np.ndarray, x: list[str]) -> pa.RecordBatch:
            got = np.array(links_in_cell(c, x, threshold), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(i[got[:, 0]]), pa.array(i[got[:, 1]])], ["src", "dst"])

        for batch in batches:
            cell_, ids_ = np.concatenate([cell_, batch.column(0).to_numpy()]), np.concatenate([ids_, batch.column(1).to_numpy()])
            lines_ += batch.column(2).to_pylist()
            done = int(np.searchsorted(cell_, cell_[-1], side="left")) if len(cell_) else 0
            if done > 512:
                yield links(cell_[:done], ids_[:done], lines_[:done])
                cell_, ids_, lines_ = cell_[done:], ids_[done:], lines_[done:]
        if len(cell_):
            yield links(cell_, ids_, lines_)

    def links_of(cells: DataFrame) -> DataFrame:
        # Bands often hold the same set of lines: a cell with the same lines as another is verified once.
        mark = cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s1"), F.sum(F.xxhash64("id", F.lit(3)).cast("decimal(20,0)")).alias("s2"))
        unique = mark.where("n > 1").groupBy("n", "s1", "s2").agg(F.min("cell").alias("cell")).select("cell")
        joined = cells.join(unique, "cell", "left_semi").join(known, "id").select("cell", "id", "line").repartition("cell").sortWithinPartitions("cell", "id")
        return joined.mapInArrow(verify, "src long, dst long")

    if not split:
        return links_of(alive.select("id", F.col("band").alias("cell")))
    few = alive.join(large, "band", "left_anti").select("id", F.col("band").alias("cell"))
    # Repeated rows of a hot band that several pieces sent count once; a band's pivots are its least ids by hash.
    many = stored(alive.join(large, "band").distinct(), "crowded")
    order = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("id"), "id"))
    pivots = stored(many.withColumn("_n", order).where(F.col("_n") <= PIVOTS).drop("_n"), "pivots")
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), "chunks").cast("int")
    own = many.select("id", F.xxhash64("band", chunk).alias("cell"))
    with_pivots = pivots.select("id", F.explode(F.expr("transform(sequence(0, chunks - 1), c -> xxhash64(band, c))")).alias("cell"))
    first = stored(links_of(few.unionByName(own.unionByName(with_pivots).distinct())), "links")
    roots = connected_components(first)
    labelled = stored(many.join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root")), "labelled")
    largest = labelled.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    largest = stored(largest.select("band", F.col("m.root").alias("main"), (F.col("n") - F.col("m.n")).alias("strays"), "n").where("strays > 0"), "largest")
    if not largest.head(1):
        return first
    half = cell // 2
    parted = labelled.join(sized(largest, "largest"), "band").withColumn("stray", F.col("root") != F.col("main"))
    hashed = F.xxhash64("id", F.lit(7))
    parted = parted.withColumn("s", F.ceil(F.col("strays") / half).cast("int")).withColumn("c", F.greatest(F.ceil((F.col("n") - F.col("strays")) / half), F.lit(1)).cast("int"))
    # A cell is a chunk of strays with another one (numbers below s) or with a chunk of the main component (from s on).
    at = F.when(F.col("stray"), F.pmod(hashed, "s")).otherwise(F.col("s") + F.pmod(hashed, "c")).cast("int")
    meets = F.when(F.col("stray"), F.expr("sequence(0, s + c - 1)")).otherwise(F.expr("sequence(0, s - 1)"))
    spread = parted.select("id", "band", at.alias("at"), F.explode(meets).alias("to"))
    rest = spread.select("id", F.xxhash64("band", F.least("at", "to"), F.greatest("at", "to"), F.lit(1)).alias("cell"))
    return first.unionByName(links_of(rest))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(key, k, line, h1, h2) of every non-empty line; k tells texts of one key apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, line in _pieces(batches, 2):
            points, starts, ends, owner, number = cut(texts)
            number = number + line
            if len(starts):
                h1, h2 = line_ids(points, starts, ends)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(h1), pa.array(h2)], ["key", "k", "line", "h1", "h2"])

    schema = T.StructType([docs.schema["key"], *(T.StructField(n, t) for n, t in (("k", T.LongType()), ("line", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType())))])
    return docs.select("key", F.xxhash64("text").alias("k"), "text").mapInArrow(work, schema)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """(key, k, removed array<int>): line numbers from 0 that are not the first of their component.

    ``k`` is xxhash64 of the text. Rows equal in key and text count as one document. Empty lines are never removed;
    null and empty texts have no lines; long texts are read whole, in pieces of whole lines. A null key is a key of its
    own and sorts first; ties of a key go by text hash. An empty table gives no rows. Other columns, whatever their
    names, are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    roots = sized(connected_components(fuzzy_links(rows, threshold=threshold)).withColumnsRenamed({"node": "h1"}), "line-roots")
    lines = stored(_occurrences(rows), "occurrences").join(roots, "h1", "left")
    lines = lines.select("key", "k", "line", F.coalesce("root", "h1").alias("g1"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("g2"))
    here = F.struct("key", "k", "line")
    firsts = lines.groupBy("g1", "g2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("not (first <=> last)").drop("last")
    firsts = sized(firsts.withColumnsRenamed({"g1": "f1", "g2": "f2"}), "first-lines")
    later = lines.join(firsts, (F.col("g1") == F.col("f1")) & (F.col("g2") == F.col("f2"))).where(~here.eqNullSafe(F.col("first")))
    return later.groupBy(F.col("key").alias(key), "k").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def remove_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with removed lines cut out of the text.

    Null texts stay null, texts without a removed line stay as they are; rows alike in key and text lose the same lines.
    Long texts are cut whole, an empty table gives no rows. Other columns, whatever their names, stay. Ties: as
    :func:`repeated_lines` states.
    """
    found = repeated_lines(docs, key, text, **kw).select(F.struct(F.col(key).alias("id"), "k").alias("id"), "removed").alias("f")
    rows = docs.alias("d")
    whole = F.col(f"d.`{text}`")
    same = F.struct(F.col(f"d.`{key}`").alias("id"), F.xxhash64(whole).alias("k")).eqNullSafe(F.col("f.id"))
    # The lines are bound once as a variable; numbers of removed lines are taken out by hash, not searched for each line.
    numbers = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col("f.removed"))
    parts = F.transform(F.array(F.split(whole, "\n", -1)), lambda s: F.transform(numbers(s), lambda i: F.get(s, i)))[0]
    left = F.when(F.col("f.removed").isNull(), whole).otherwise(F.array_join(parts, "\n")).alias(text)
    return rows.join(found, same & whole.isNotNull(), "left").select(*[left if c == text else F.col(f"d.`{c}`") for c in docs.columns])


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed_lines, first_removed, last_removed of every document that loses a line; edge cases as :func:`repeated_lines`."""
    found = repeated_lines(table(tuned(spark), sf_dir, "documents"))
    return found.select("doc_id", F.size("removed").alias("removed_lines"), F.element_at("removed", 1).alias("first_removed"), F.element_at("removed", -1).alias("last_removed"))
