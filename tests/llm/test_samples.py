"""Samples of the fitted operators are bounded by rows, whatever the keys; the toxicity fit against another solver."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, common, decontam, langid, lines, simhash, spans, toxicity

from .conftest import DOCS, prose

WORDS = {"aa": [f"k{a}l{b}" for a in "aeiou" for b in "aeiou"], "bb": [f"t{a}r{b}" for a in "aeiou" for b in "aeiou"]}


@pytest.fixture
def taken(monkeypatch):
    """Rows of every sample that an operator takes."""
    out = []

    def watched(df, *args):
        found = common.bounded_sample(df, *args)
        out.append(found.count())
        return found

    for module in (langid, toxicity):
        monkeypatch.setattr(module, "bounded_sample", watched)
    return out


@pytest.mark.parametrize("key", [7, None, "each"])
def test_languages_are_learned_whatever_the_keys(spark, taken, key):
    rng = random.Random(1)
    rows = [(i if key == "each" else key, " ".join(rng.choices(WORDS[lang], k=6)), lang, "x", 0) for i, lang in enumerate(["aa", "bb"] * 1500)]
    rows += [rows[0]] * 1000  # one row, very many times
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df, sample_rows=100)
    assert 150 <= taken[0] <= 200 and model.langs == ("aa", "bb")
    got = langid.predict(df.select("text", F.col("lang").alias("truth")), model).collect()
    assert sum(r["truth"] == r["lang_pred"] for r in got) >= 0.99 * len(got)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, "ka lo", f"x{i % 5}", None, 0) for i in range(23)]
    assert langid.train(spark.createDataFrame(rows, DOCS)).langs == ("x0", "x1", "x2")


def toxic_rows(n=1600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(WORDS["aa"] + WORDS["bb"] + ["women", "muslims", "gay", "old"], k=12)
        if toxic and rng.random() < 0.9:
            words += rng.sample(["vilest", "vilely", "rotten", "rotter"], 2)
        if rng.random() < 0.03:
            words.append("rotten")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_a_hot_key_does_not_fill_the_toxic_sample(spark, taken):
    rows = toxic_rows()
    docs = [(i, t, None, None, 0) for i, t, _ in rows] + [(0, f"{rows[0][1]} copy{j}", None, None, 0) for j in range(3000)]
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), sample_rows=200)
    assert max(taken[1:]) <= 400 and taken[0] <= 400 * 1.3 + toxicity.KEY_ROWS
    got = toxicity.score(spark.createDataFrame(docs[: len(rows)], DOCS).select("doc_id", "text"), model).collect()
    truth = {i: y for i, _, y in rows}
    hits = Counter((truth[r["doc_id"]], r["score"] >= 0.5) for r in got)
    assert hits[1, True] > 0.8 * (hits[1, True] + hits[1, False]) and hits[0, True] < 0.1 * hits[0, False]


def test_toxic_features_and_fit_against_another_solver(spark):
    rows = toxic_rows(800, 5)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t, _ in rows], DOCS)
    l2, pull = 1e-3, 1.0
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), l2=l2, swap_penalty=pull)
    y = np.array([r[2] for r in rows], float)
    bags = [toxicity.distinct_words(t) for _, t, _ in rows]
    full = lambda ws: {f for w in ws for f in (f"={w}", *(f"{w[:n]}*" for n in (3, 4, 5, 6, 7) if len(w) > n))}
    sets = [full(b) for b in bags]
    n = len(rows)

    def z(f):
        """Root of the log likelihood ratio of the table feature x class."""
        cells = Counter((f in s, int(c)) for s, c in zip(sets, y, strict=True))
        margin = lambda i, v: sum(k for c, k in cells.items() if c[i] == v)
        return math.sqrt(max(0.0, 2 * sum(k * math.log(k * n / (margin(0, a) * margin(1, b))) for (a, b), k in cells.items())))

    seen = Counter(f for s in sets for f in s)
    names = sorted({f for f, k in seen.items() if k >= toxicity.MIN_DOCS and z(f) >= toxicity.MIN_Z} | {f"={t}" for t in toxicity.SWAP})
    assert set(model.weights) <= set(names) and {"=rotten", "=vilest", "vile*", "rott*"} <= set(model.weights)
    at = {f: i for i, f in enumerate(names)}

    def vector(words):
        x = np.zeros(len(names))
        x[[at[f] for f in full(words) if f in at]] = 1
        return x

    x = np.array([vector(b) for b in bags])
    moves = np.array([d for b, v in zip(bags, x, strict=True) for other in ({toxicity.SWAP.get(w, w) for w in b}, b - toxicity.SWAP.keys()) if (d := v - vector(other)).any()])
    design = np.hstack([x, np.ones((n, 1))])
    ridge = np.zeros((len(names) + 1,) * 2)
    ridge[:-1, :-1] = l2 * np.eye(len(names)) + 2 * pull * moves.T @ moves / len(moves)

    def objective(theta):
        m = design @ theta
        return float(np.mean(np.logaddexp(0, m) - y * m) + 0.5 * theta @ ridge @ theta)

    theta = np.zeros(len(names) + 1)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-design @ theta))
        grad = design.T @ (p - y) / n + ridge @ theta
        theta -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / n + ridge + 1e-9 * np.eye(len(theta)), grad)
    assert np.abs(grad).max() < 1e-6
    own = np.append([model.weights.get(f, 0.0) for f in names], model.bias)
    assert objective(own) <= objective(theta) * 1.002 + 1e-6
    assert np.abs(design @ own - design @ theta).max() < 0.25 and abs(own[at["=women"]]) < 0.05


def test_sample_of_the_index_is_bounded_and_stable(spark):
    rng = np.random.default_rng(2)
    hot = [(5, v.tolist()) for v in rng.normal(size=(900, 8))]
    df = spark.createDataFrame(hot + [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    asked = df.where("vec_id = 120")
    runs = [ann.nearest(df.repartition(p), asked, k=5, sample_rows=10, lists=4).select("rank", "vec_id", "score").orderBy("rank").collect() for p in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 5


def test_repeated_items_are_one_item(spark):
    rng = random.Random(4)
    text = prose(rng, 30)
    docs = spark.createDataFrame([(1, "x " + text + " y", None, None, 0)], DOCS)
    items = spark.range(5000).select(F.lit(9).cast("long").alias("item_id"), F.lit(text).alias("text"))
    got = decontam.contained_items(docs, items)
    assert got.count() == 5000 and got.distinct().count() == 1


def test_small_tables_alone_are_broadcast(spark, monkeypatch):
    few = spark.range(50).selectExpr("id", "repeat(md5(cast(id as string)), 50) as s")
    plan = lambda df: df.join(spark.range(9), "id")._jdf.queryExecution().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan(common.sized(few, "t")) or "strategy=broadcast" in plan(common.sized(few, "t"))
    monkeypatch.setattr(common, "SMALL_BYTES", 100)
    assert "strategy=broadcast" not in plan(common.sized(few, "t"))


def test_lines_and_spans_take_very_long_texts(spark):
    rng = random.Random(8)
    long = "\n".join(prose(rng, 40) for _ in range(4000))  # 160,000 words
    docs = spark.createDataFrame([(1, long, None, None, 0), (2, long + " end", None, None, 0), (3, prose(rng, 60), None, None, 0)], DOCS)
    assert [r["doc_id"] for r in spans.repeated_sentences(docs, **spans.QUERY).collect()] == [2]
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}[2] == 1
    assert lines.repeated_lines(docs).where("doc_id = 3").count() == 0
