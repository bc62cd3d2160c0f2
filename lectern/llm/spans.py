"""Substring dedup over sliding sentence spans.

A text is cut into sentences: after a word that ends in one of ``.!?`` with no other mark before it (``!!`` after every
word is shouting, not a sentence), and sentences of more than ``longest`` words into pieces. With ``within`` the pieces
begin before every word whose md5 is least among some ``within`` consecutive words of the text, so equal words are cut
alike wherever they begin; line feeds are then blanks like others. Without it a sentence also ends at a line feed and
pieces have ``longest`` words.

Every run of ``run`` consecutive sentences or pieces is hashed to 128 bits; with ``extend`` a run of fewer than
``min_words`` words goes on until it has so many, else it is left out. With ``whole`` a text too short for any run is a
span of its own. Spans are joined globally; the first occurrence of a span, by (doc_id, text hash, place), keeps its
sentences and every sentence covered by another occurrence is removed.

The query takes ``within=8, min_words=20, extend, whole``. Of repeated words the parts of sentences at either end may be
lost, if the sentences go on differently; any run of three whole sentences or pieces between them is found. Within a
sentence that is long in both texts, cuts 7 words from either end depend on the repeated words alone.

Counts and firsts are pre-aggregated before the shuffle, and the join back to occurrences has plain exchanges on both
sides, so a passage that a third of all texts share is split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, tuned
from .textkernel import BLANK, running, slices, spans_of, word_hashes, word_spans

RUN, MIN_WORDS, LONGEST = 3, 12, 20
#: What the query and its SQL take.
QUERY = {"run": 3, "min_words": 20, "within": 8, "extend": True, "whole": True}
_MEMO: dict[int, int] = {}
_IS_WORD = ~BLANK
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".!?,;:"]] = True


def word_order(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of each word's md5; words met before are remembered by their hash."""
    words, first, which = np.unique(word_hashes(buf, starts, ends, 0), return_index=True, return_inverse=True)
    if len(_MEMO) > 500_000:
        _MEMO.clear()
    values = []
    for w, at in zip(words.tolist(), first.tolist(), strict=True):
        v = _MEMO.get(w)
        if v is None:
            v = _MEMO[w] = int.from_bytes(md5(buf[starts[at] : ends[at]].tobytes()).digest()[:8], "big")
        values.append(v)
    return np.array(values, np.uint64)[which.ravel()]


def sentences(buf: np.ndarray, offsets: np.ndarray, longest: int, within: int = 0) -> tuple[np.ndarray, ...]:
    """Words (starts, ends, text number) and the first word of each sentence, one past the last appended."""
    starts, ends, owner = word_spans(buf, offsets, _IS_WORD)
    if not len(starts):
        return starts, ends, owner, np.zeros(1, np.int64)
    opens = np.ones(len(starts), bool)
    last = ends[:-1] - 1
    stop = _STOP[buf[last]] & (last > starts[:-1]) & ~_MARK[buf[np.maximum(last - 1, 0)]]
    opens[1:] = (owner[1:] != owner[:-1]) | stop
    if within:
        size = np.diff(np.append(np.flatnonzero(opens), len(starts)))
        long = np.repeat(size > longest, size)
        words = word_order(buf, starts, ends)
        if len(words) >= within:
            least = np.lib.stride_tricks.sliding_window_view(words, within).argmin(axis=1) + np.arange(len(words) - within + 1)
            least = least[owner[: len(least)] == owner[within - 1 :]]
            opens[least[long[least]]] = True
        return starts, ends, owner, np.append(np.flatnonzero(opens), len(starts))
    feeds = np.flatnonzero(buf == 10)
    opens[1:] |= np.searchsorted(feeds, starts[1:]) != np.searchsorted(feeds, ends[:-1])
    at = np.flatnonzero(opens)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    return starts, ends, owner, np.append(np.flatnonzero(place % longest == 0), len(starts))


def _runs(docs: DataFrame, run: int, min_words: int, longest: int, extend: bool, within: int, whole: bool) -> DataFrame:
    """(h1, h2, key, k, pos, n) of every qualifying run of n sentences; k tells texts of one key apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in slices(batches, "text"):
            starts, ends, owner, first = sentences(buf, offsets, longest, within)
            n = len(first) - 1
            if n < (1 if whole else run):
                continue
            at = np.arange(max(0, n - run + 1))
            till = at + run
            if extend:
                till = np.maximum(till, np.searchsorted(first, first[at] + min_words))
                at, till = at[till <= n], till[till <= n]
            units = owner[first[:-1]]
            fits = (owner[first[at]] == owner[first[till] - 1]) & (first[till] - first[at] >= min_words)
            at, till = at[fits], till[fits]
            if whole:
                opens = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
                closes = np.append(opens[1:], n)
                short = ~np.isin(units[opens], units[at])
                at, till = np.concatenate([at, opens[short]]), np.concatenate([till, closes[short]])
            if not len(at):
                continue
            out = []
            for which in (0, 1):
                marks = spans_of(running(word_hashes(buf, starts, ends, which), 1 - which), first[:-1], first[1:], 1 - which)
                out.append(spans_of(running(marks, which), at, till, which).view(np.int64))
            doc = owner[first[at]]
            base = np.searchsorted(units, np.arange(len(offsets) - 1))  # sentence number of a text's first
            columns = [pa.array(out[0]), pa.array(out[1]), part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array((at - base[doc]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array((till - at).astype(np.int32))] if varied else []), schema.fieldNames())

    fields = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), docs.schema["key"], T.StructField("k", T.LongType()), T.StructField("pos", T.IntegerType())]
    varied = extend or whole
    schema = T.StructType(fields + ([T.StructField("n", T.IntegerType())] if varied else []))
    return docs.select("key", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k"), "text").mapInArrow(work, schema)


def repeated_sentences(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, run: int = RUN, min_words: int = MIN_WORDS, longest: int = LONGEST, extend: bool = False, within: int = 0, whole: bool = False
) -> DataFrame:
    """(key, k, removed array<int>): sentence numbers from 0 that non-first spans cover, for texts that have any.

    ``k`` is xxhash64 of the text. Rows equal in key and text count as one document. Null texts and those without a word
    have no spans; those too short for a run have one with ``whole``, else none. Long texts are read whole. Ties of a
    key go by text hash, and a null key is a key of its own and sorts first. An empty table gives no rows. Other columns,
    whatever their names, are not looked at. With ``within`` numbers count the pieces cut by content.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    spans = _runs(rows, run, min_words, longest, extend, within, whole)
    here = F.struct("key", "k", "pos")
    firsts = spans.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("not (first <=> last)").drop("last")
    firsts = stored(firsts, "firsts").withColumnsRenamed({"h1": "g1", "h2": "g2"})
    later = spans.join(firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(~F.struct("key", "k", "pos").eqNullSafe(F.col("first")))
    covers = later.groupBy("key", "k").agg(F.collect_set(F.struct("pos", "n") if extend or whole else F.col("pos")).alias("at"))
    covered = lambda p: F.sequence(p["pos"], p["pos"] + p["n"] - 1) if extend or whole else F.sequence(p, p + (run - 1))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("at", covered))))
    return covers.select(F.col("key").alias(key), "k", numbers.alias("removed"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with removed sentences cut out of the text (each with the blanks up to the next).

    Null texts stay null, texts without a repeat stay as they are; rows alike in key and text lose the same sentences. Long
    texts are cut whole, an empty table gives no rows. Other columns, whatever their names, stay. Ties: as
    :func:`repeated_sentences` states.
    """
    names, longest, within = docs.columns, kw.get("longest", LONGEST), kw.get("within", 0)
    free = next(f"_gone{i}" for i in range(len(names) + 1) if f"_gone{i}" not in names)
    found = repeated_sentences(docs, key, text, **kw).select(F.struct(F.col(key).alias("id"), "k").alias("id"), "removed").alias("f")
    rows = docs.alias("d")
    same = F.struct(F.col(f"d.`{key}`").alias("id"), F.xxhash64(F.col(f"d.`{text}`")).alias("k")).eqNullSafe(F.col("f.id"))
    joined = rows.join(found, same & F.col(f"d.`{text}`").isNotNull(), "left").select(*[F.col(f"d.`{c}`") for c in names], F.col("f.removed").alias(free))
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone and texts[i]:
                    raw = np.frombuffer(texts[i].encode(), np.uint8)
                    starts, _, _, first = sentences(raw, np.array([0, len(raw)]), longest, within)
                    bounds = np.append(starts[first[:-1]], len(raw))
                    keep = np.ones(len(raw), bool)
                    for s in gone:
                        keep[bounds[s] : bounds[s + 1]] = False
                    texts[i] = raw[keep].tobytes().decode()
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, docs.schema)


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed_sentences, first_removed, last_removed of every document that loses a sentence or piece.

    Nulls, empty, short and long texts, ties, repeated rows and empty tables: as :func:`repeated_sentences` states.
    """
    found = repeated_sentences(table(tuned(spark), sf_dir, "documents"), **QUERY)
    return found.select(
        "doc_id", F.size("removed").alias("removed_sentences"), F.element_at("removed", 1).alias("first_removed"), F.element_at("removed", -1).alias("last_removed"))


# Documents of one doc_id and different texts are ordered by a hash in Spark and by text here: the two agree where
# doc_id is unique.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS t, doc_id, w FROM (
  SELECT DISTINCT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL)
), words AS (SELECT t, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
least AS (SELECT DISTINCT t, j FROM (
  SELECT t, i, n, i + instr(m, arg) // 33 AS j FROM (
    SELECT t, i, n, string_agg(md5(word), ' ') OVER p AS m, min(md5(word)) OVER p AS arg FROM words WINDOW p AS (PARTITION BY t ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)))
  WHERE i <= n - 7
), stops AS (
  SELECT *, (i = 1 OR coalesce(regexp_matches(lag(word) OVER (PARTITION BY t ORDER BY i), '[^.!?,;:][.!?]$'), FALSE)) AS o FROM words
), sentence AS (SELECT *, sum(o::INTEGER) OVER (PARTITION BY t ORDER BY i) AS s FROM stops),
opened AS (
  SELECT x.t, x.i, x.n, x.word, x.o OR (least.j IS NOT NULL AND count(*) OVER (PARTITION BY x.t, x.s) > 20) AS o
  FROM sentence x LEFT JOIN least ON least.t = x.t AND least.j = x.i
), numbered AS (SELECT t, i, n, word, (sum(o::INTEGER) OVER (PARTITION BY t ORDER BY i) - 1)::BIGINT AS pos FROM opened),
units AS (SELECT t, pos, min(i) AS i, any_value(n) AS n, string_agg(word, chr(1) ORDER BY i) AS u FROM numbered GROUP BY t, pos),
ends AS (SELECT t, i, pos FROM units UNION ALL SELECT t, max(n) + 1, max(pos) + 1 FROM units GROUP BY t),
long AS (SELECT a.t, a.i, a.pos, b.pos AS far FROM units a ASOF JOIN ends b ON a.t = b.t AND a.i + 20 <= b.i),
runs AS (SELECT long.t, long.pos, e.pos AS stop FROM long JOIN ends e ON e.t = long.t AND e.pos = greatest(long.far, long.pos + 3)),
spans AS (SELECT * FROM runs UNION ALL SELECT t, 0, max(pos) FROM ends WHERE t NOT IN (SELECT t FROM runs) GROUP BY t),
bodies AS (
  SELECT s.t, s.pos, s.stop, md5(string_agg(u.u, chr(2) ORDER BY u.pos)) AS body
  FROM (SELECT *, unnest(range(pos, stop)) AS part FROM spans) s JOIN units u ON u.t = s.t AND u.pos = s.part GROUP BY ALL
), ranked AS (
  SELECT t, pos, stop, row_number() OVER (PARTITION BY body ORDER BY t, pos) AS k FROM bodies
), gone AS (SELECT DISTINCT t, unnest(range(pos, stop)) AS n FROM ranked WHERE k > 1)
SELECT any_value(doc_id) AS doc_id, count(*)::INTEGER AS removed_sentences, min(n)::INTEGER AS first_removed, max(n)::INTEGER AS last_removed FROM gone JOIN d USING (t) GROUP BY t
"""
