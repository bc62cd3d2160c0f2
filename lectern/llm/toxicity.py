"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings, fitted on a bounded sample of labelled rows. For each
training text that mentions an identity term two counterfactuals are made: every such term is swapped for another of its
group, and for a blank. The squared changes of the logit are penalised (the first makes the groups alike, the second
keeps them alike at nought), so a neutral mention of a group does not move the score. Features are those whose share
differs between the classes (root of the log likelihood ratio); their number is bounded, so the model is small enough to
broadcast whatever the corpus is. Scoring reads whole texts in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, crc_mod, hash_fraction, stored, table, tuned

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)
#: Bounds of the fit: labelled rows a class and a key, features kept, least documents and z of a feature.
SAMPLE_ROWS, KEY_ROWS, MAX_FEATURES, MIN_DOCS, MIN_Z = 6000, 16, 2000, 4, 4.5

# Identity terms by group; a term is swapped for the next of its group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "arab", "mexican", "chinese", "indian", "turkish"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def counterfactual(words: set[str]) -> set[str]:
    """The words with every identity term swapped."""
    return {SWAP.get(w, w) for w in words}


def masked(words: set[str]) -> set[str]:
    """The words with every identity term blanked."""
    return {w for w in words if w not in SWAP}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def logit(self, words: set[str]) -> float:
        found = {f for w in words for f in features_of(w) if f in self.weights}
        return self.bias + sum(self.weights[f] for f in sorted(found))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pd.DataFrame]:
        names = counts[0].keys() | counts[1].keys()
        if names:
            yield pd.DataFrame([(f, counts[0][f], counts[1][f]) for f in names], columns=["feature", "n0", "n1"])
        for c in counts:
            c.clear()

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            counts[int(toxic)].update({f for w in distinct_words(text) for f in features_of(w)})
        if sum(map(len, counts)) > 200_000:
            yield from flush()
    yield from flush()


def _fit(rows: list[tuple[np.ndarray, ...]], y: np.ndarray, weight: np.ndarray, n: int, l2: float, swap_penalty: float, steps: int = 400) -> np.ndarray:
    """Weights and bias (last) by Adam on the weighted log loss, an l2 term and the counterfactual penalty."""

    def csr(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts) if parts else np.zeros(0, np.int64)

    at, col = csr([x for x, *_ in rows])
    swapped = [(np.setdiff1d(x, c), np.setdiff1d(c, x)) for x, *others in rows for c in others]
    moved = [i for i, (a, b) in enumerate(swapped) if len(a) or len(b)]
    plus, minus = csr([swapped[i][0] for i in moved]), csr([swapped[i][1] for i in moved])
    w, b = np.zeros(n), float(np.log(max(weight[y == 1].sum(), 1e-9) / max(weight[y == 0].sum(), 1e-9)))
    theta = np.append(w, b)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(at, theta[col], len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        grad = np.append(np.bincount(col, g[at], n) + l2 * theta[:-1], g.sum())
        if moved:
            d = np.bincount(plus[0], theta[plus[1]], len(moved)) - np.bincount(minus[0], theta[minus[1]], len(moved))
            d *= 2 * swap_penalty / len(moved)
            grad[:-1] += np.bincount(plus[1], d[plus[0]], n) - np.bincount(minus[1], d[minus[0]], n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *, sample_rows: int = SAMPLE_ROWS,
    max_features: int = MAX_FEATURES, l2: float = 1e-5, swap_penalty: float = 1.0,
) -> ToxicityModel:
    """Fit on labelled texts. A key with several labels counts as toxic if one of them says so; nulls are left out.

    The sample of keys is bounded (by expectation), so it is broadcast to the texts. Of their texts at most
    ``KEY_ROWS`` a key and then ``sample_rows`` a class are taken, least hash first, so a key of very many rows does not
    fill the sample, and what reaches the driver is bounded by rows. Without labels of both classes, as in empty tables, the model scores the share of toxic labels everywhere. Long texts are
    read whole; repeated rows of a document count each; features that tie at the bound are taken in code-point order.
    """
    spark = docs.sparkSession
    given = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)").groupBy("key").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, 40.0 if sizes.get(1) else -40.0)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_rows / sizes[1]))).otherwise(F.lit(min(1.0, sample_rows / sizes[0])))
    sample = F.broadcast(stored(given.where(hash_fraction("key", seed=23) < share), "labelled"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(sample, "key").withColumn("u", hash_fraction("key", "text", seed=29))
    texts = bounded_sample(bounded_sample(texts, ["key"], F.col("u"), KEY_ROWS), ["toxic"], F.col("u"), sample_rows).select("text", "toxic")
    texts = stored(texts, "labelled-texts")
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return ToxicityModel({}, 40.0 if n.get(1) else -40.0)
    counts = texts.mapInPandas(_count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = float(n[0] + n[1])
    seen = F.col("n0") + F.col("n1")

    def part(found, row, column):
        return F.when(found > 0, found * F.log(found * total / (row * column))).otherwise(0.0)

    cells = [part(F.col(f"n{k}"), seen, F.lit(float(n[k]))) + part(F.lit(n[k]) - F.col(f"n{k}"), total - seen, F.lit(float(n[k]))) for k in (0, 1)]
    z = F.sqrt(F.greatest(2 * (cells[0] + cells[1]), F.lit(0.0)))
    top = counts.where(F.col("n0") + F.col("n1") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(max_features)
    names = [r["feature"] for r in top.collect()]
    names = sorted({*names, *(f"={t}" for t in SWAP)})
    index = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = index.value
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = distinct_words(text)
                x, c, m = ([of[f] for f in sorted({f for w in ws for f in features_of(w)} & of.keys())] for ws in (words, counterfactual(words), masked(words)))
                out.append((int(toxic), x, c, m))
            yield pd.DataFrame(out, columns=["toxic", "x", "c", "m"])

    encoded = texts.mapInPandas(encode, "toxic int, x array<int>, c array<int>, m array<int>").collect()  # a bounded sample of short index lists
    encoded.sort(key=lambda r: (r["toxic"], r["x"]))
    y = np.array([r["toxic"] for r in encoded], float)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    theta = _fit([tuple(np.array(r[k], np.int64) for k in "xcm") for r in encoded], y, weight, len(names), l2, swap_penalty)
    return ToxicityModel({f: float(w) for f, w in zip(names, theta[:-1], strict=True) if abs(w) > 1e-6}, float(theta[-1]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is toxic in place of the text; null and empty texts get the base.

    Long texts are read whole, repeated rows get a row each, an empty table gives none; an existing column of the
    result's name is replaced, the others stay.
    """
    keep = [c for c in docs.columns if c not in (text, out)]
    docs = docs.select(*keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for value in batch.column(len(keep)).to_pylist():
                found: set[str] = set()
                for w in distinct_words(value):
                    hit = memo.get(w)
                    if hit is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        hit = memo[w] = tuple(f for f in features_of(w) if f in m.weights)
                    if hit:
                        found.update(hit)
                z = m.bias + sum(m.weights[f] for f in sorted(found))
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], [*keep, out])

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns labels of rows that are not held out.

    Edge cases as :func:`train` and :func:`score` state.
    """
    docs, labels = table(tuned(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    rows = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return score(rows, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
