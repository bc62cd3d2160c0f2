"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams, the
longest length of which any is known; a word with none known adds nothing. The model is a fitted classifier: it
learns every word and n-gram of a bounded sample of labelled rows (``sample_rows`` per language, by expectation; drawn
by hash), and holds them as sorted 64-bit hashes with one entry for each language that has the token, so its size is
bounded by the sample whatever the corpus is. Predictions read whole texts in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc_mod, hash_fraction, stored, table, tuned

_WORD = re.compile(r"[^\W\d_]+")
UND = "und"
NGRAMS = (5, 4, 3, 2, 1)


def words_of(text: str) -> Counter:
    """Lower-cased words of letters with their counts."""
    found = Counter(_WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n, letters = found.pop(w), "".join(c for c in w if c.isalpha())
        if letters:
            found[letters] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass(frozen=True)
class LanguageModel:
    """Per-language natural log frequencies of words and of n-grams by length."""

    langs: tuple[str, ...]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]

    def vector(self, word: str) -> np.ndarray | None:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in NGRAMS:
            level = self.grams[n]
            found = [v for g in grams_of(word, n) if (v := level.get(g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return None


def hashes(tokens: list[str]) -> np.ndarray:
    """XXH64 with seed 42 of the tokens' UTF-8, as Spark's xxhash64 gives it."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(t.encode(), 42) for t in tokens), np.uint64, len(tokens))


@dataclass(frozen=True)
class Level:
    """Tokens of one kind: sorted hashes, one entry a language, and what a language without the token scores."""

    hashes: np.ndarray
    langs: np.ndarray
    above: np.ndarray  # log frequency less that of an absent token
    absent: np.ndarray  # (languages,)

    @classmethod
    def of(cls, h: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int) -> Level:
        total = np.bincount(lang, n, langs)
        order = np.lexsort((lang, h))
        h, lang, n = h[order], lang[order], n[order]
        return cls(h, lang.astype(np.int32), np.log((n + 0.1) / 0.1).astype(np.float64), np.log(0.1 / (total + 1.0)))

    def add(self, tokens: list[str], row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the sum of its known tokens' vectors and their number; ``row`` is each token's."""
        h = hashes(tokens)
        lo = np.searchsorted(self.hashes, h, "left")
        n = np.searchsorted(self.hashes, h, "right") - lo
        known = np.bincount(row, n > 0, rows)
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        langs = len(self.absent)
        total = np.bincount(np.repeat(row, n) * langs + self.langs[at], self.above[at], rows * langs).reshape(rows, langs)
        return total + known[:, None] * self.absent, known


@dataclass(frozen=True)
class PackedModel:
    """A :class:`LanguageModel` as arrays: levels by kind, 0 for words and n for n-grams."""

    langs: tuple[str, ...]
    levels: dict[int, Level]

    def typical(self) -> np.ndarray:
        """For each language the mean log odds that the words learned for it speak against the likest other language."""
        words, n = self.levels[0], len(self.langs)
        first = np.flatnonzero(np.concatenate([[True], words.hashes[1:] != words.hashes[:-1]]))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words.hashes))))
        above = np.zeros((len(first), n))
        above[row, words.langs] = words.above
        seen = 0.1 * np.exp(words.above) - 0.1
        out = np.zeros(n)
        for k in range(n):
            of = words.langs == k
            odds = (above[row[of]][:, [k]] + words.absent[k]) - (above[row[of]] + words.absent)
            out[k] = np.delete((seen[of] @ odds) / seen[of].sum(), k).min(initial=np.inf) if of.any() else 0.0
        return out

    def vectors(self, words: list[str]) -> np.ndarray:
        """(words, languages): log frequencies of each word; 0 where neither it nor an n-gram of it is known."""
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out
        left = np.arange(len(words))
        for kind in (0, *NGRAMS):
            tokens = [[words[i]] if kind == 0 else grams_of(words[i], kind) for i in left.tolist()]
            row = np.repeat(np.arange(len(left)), [len(t) for t in tokens])
            total, known = self.levels[kind].add([t for ts in tokens for t in ts], row, len(left))
            hit = known > 0
            out[left[hit]] = total[hit] / known[hit, None]
            left = left[~hit]
            if not len(left):
                break
        return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pd.DataFrame]:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["lang", "token", "n"])

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > 100_000:
            yield from flush()
    yield from flush()


def _gram_counts(words: DataFrame) -> DataFrame:
    """N-grams of the distinct words, weighted by their counts."""
    padded = F.concat(F.lit("^"), F.col("token"), F.lit("$"))

    def level(n: int):
        of = padded if n > 1 else F.col("token")
        starts = F.filter(F.sequence(F.lit(1), F.length(of)), lambda i: i <= F.length(of) - (n - 1))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("kind"), F.substring(of, i, F.lit(n)).alias("token")))

    grams = words.select("lang", "n", F.explode(F.concat(*[level(n) for n in NGRAMS])).alias("g"))
    return grams.groupBy("lang", F.col("g.kind").alias("kind"), F.col("g.token").alias("token")).agg(F.sum("n").alias("n"))


#: Languages learned: the most frequent ones, as vectors have a number for each.
MOST_LANGUAGES = 512


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, sample_rows: int = 3000) -> PackedModel:
    """Fit on rows whose text and language are given; nulls are left out. No labelled row gives an empty model.

    A language is learned from at most ``sample_rows`` rows, drawn by a hash of key and text: a null key, and a key of very
    many rows, are sampled like others, and rows that repeat are drawn together up to the bound. Of more than
    ``MOST_LANGUAGES`` languages the most frequent are learned (ties in code-point order). Repeated rows count each, long
    texts whole. All tokens of the sample are kept, however many there are.
    """
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return PackedModel((), {})
    langs = tuple(sorted(sizes))
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 1.2 * sample_rows / v))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    drawn = given.withColumn("u", hash_fraction("key", "text", seed=11)).where(F.col("u") < share[F.col("lang")])
    sample = bounded_sample(drawn, ["lang"], F.col("u"), sample_rows)
    words = stored(sample.select("lang", "text").mapInPandas(_count, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n")), "words")
    counts = words.select("lang", F.lit(0).alias("kind"), "token", "n").unionByName(_gram_counts(words))
    got = counts.select(F.col("kind").cast("byte"), number[F.col("lang")].cast("short").alias("lang"), F.xxhash64("token").alias("h"), "n").toArrow()  # tokens of a bounded sample, 19 bytes each
    kind, lang_, h, n = (np.asarray(got.column(c)) for c in ("kind", "lang", "h", "n"))
    levels = {k: Level.of(h[kind == k].view(np.uint64), lang_[kind == k], n[kind == k], len(langs)) for k in (0, *NGRAMS)}
    return PackedModel(langs, levels)


def predict(docs: DataFrame, model: PackedModel, text: str = "text", *, pred: str = "lang_pred", score: str = "score", margin: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its posterior probability; the text column is dropped.

    A null text, one without a letter or any text under an empty model gets ``und`` with score 0. Ties go to the
    language first in code-point order, as does a text of which nothing is known (score: one over the languages).
    ``margin`` names a column for the mean log odds a word against the runner-up, which, unlike the posterior, does not
    grow with the text (``und``: 0; one language: that of an unknown text, 0). Texts are read whole, rows one by one, so
    repeated rows get a row each; an empty table gives none. Existing columns named as the results are replaced.
    """
    names = [pred, score, *([margin] if margin else [])]
    docs = docs.drop(*[c for c in names if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text]
    at = docs.columns.index(text)
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, k) for c, k in zip(names, kinds, strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: PackedModel = shared.value
        memo: dict[str, int] = {}
        vectors = np.zeros((0, max(1, len(m.langs))))
        most = max(20_000, 1_000_000 // max(1, len(m.langs)))  # words remembered; forgetting costs time alone
        for batch in batches:
            if len(memo) > most:
                memo, vectors = {}, vectors[:0]
            found = [words_of(value) if value and m.langs else None for value in batch.column(at).to_pylist()]
            fresh = list(dict.fromkeys(w for words in found if words for w in words if w not in memo))
            memo.update(zip(fresh, range(len(memo), len(memo) + len(fresh)), strict=True))
            vectors = np.concatenate([vectors, m.vectors(fresh)]) if fresh else vectors
            labels, scores, margins = [], [], []
            for words in found:
                label, best, apart = UND, 0.0, 0.0
                if words:
                    counts = np.fromiter(words.values(), np.float64, len(words))
                    total = counts @ vectors[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]
                    k = int(np.argmax(total))
                    label, best = m.langs[k], float(1 / np.exp(total - total[k]).sum())
                    apart = float(total[k] - np.partition(total, -2)[-2]) / float(counts.sum()) if len(total) > 1 else 0.0
                labels.append(label)
                scores.append(best)
                margins.append(apart)
            columns = [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *columns[: len(names)]], [*keep, *names])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, training: DataFrame | None = None, **kw) -> DataFrame:
    """Train on ``training`` (default: ``docs``) and predict for ``docs``."""
    return predict(docs, train(docs if training is None else training, **kw))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from rows that are not held out.

    Nulls, empty and long texts, ties, repeated rows and empty tables: as :func:`train` and :func:`predict` state.
    """
    docs = table(tuned(spark), sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    rows = docs.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def stage_langid(spark: SparkSession, docs: DataFrame, sf_dir: str, share: float = 0.1, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Documents in one clear language, of ``languages`` if those are given; a null lang becomes the predicted one.

    A document is rejected if it has no letter, or if its words speak on average (log odds a word) less than ``share`` of
    what the language's own words do against the likest other language: texts that mix languages, or a single word that
    several share. With one learned language there is no other and only ``und`` goes. Null and empty texts go; long texts
    are read whole; repeated rows are judged alike; an empty table gives none. Other columns, whatever their names, stay.
    """
    tuned(spark)
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    names = docs.columns
    mark = next(f"_lang{i}" for i in range(len(names) + 1) if not any(c.startswith(f"_lang{i}") for c in names))
    whole = docs.withColumn(f"{mark}_text", F.col("text"))
    told = predict(whole, model, f"{mark}_text", pred=mark, score=f"{mark}_score", margin=f"{mark}_margin")
    kept = told.where(F.col(mark) != UND)
    if len(model.langs) > 1:
        least = F.create_map(*[F.lit(x) for k, v in zip(model.langs, model.typical().tolist(), strict=True) for x in (k, share * v)])
        kept = kept.where(F.col(f"{mark}_margin") >= least[F.col(mark)])
    if languages is not None:
        kept = kept.where(F.col(mark).isin(*languages))
    return kept.select(*[F.coalesce("lang", F.col(mark).cast(docs.schema["lang"].dataType)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in names])
