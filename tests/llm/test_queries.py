"""The registered queries themselves: columns, types and contract on a written folder, their SQL in DuckDB, brute force."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import ann, common, decontam, langid, lines, mixing, queries, simhash, spans, toxicity

from .conftest import DOCS, corpus, prose
from .test_pair_ops import brute_print, roots
from .test_text_ops import brute_decontam, texts_by_language


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two languages (unique ids), labels, items and vectors."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(17)
    rows = [(i, t, lang, rng.choice(["x", "y", "Z", None]), len(t)) for i, t, lang, _, _ in texts_by_language(100)]
    extra = [r for r in corpus(3, 40) if r[0] is not None and r[0] not in (5,)]
    rows += [(1000 + r[0], r[1], rng.choice(["en", "es"]), r[3], r[4]) for r in extra]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 5 == 0)) for r in rows[:100]], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(rows[3][1].split()[2:20])), (1, " ".join(rows[3][1].split()[2:20])), (2, "none of these words here at all"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    x = np.random.default_rng(5).normal(size=(300, 16))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows, items, x


def run(spark, folder, name):
    return queries.queries()[name](spark, folder[0])


def crc(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_columns_and_types(spark, folder):
    want = {
        "op1_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    }
    for name, columns in want.items():
        assert dict(run(spark, folder, name).dtypes) == columns, name


@pytest.mark.parametrize("name", ["op3_spans", "op5_decontam", "op7_mixing"])
def test_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    df = run(spark, folder, name)
    want = c.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    at = [want.columns.index(x) for x in order]
    got = sorted(tuple(r[x] for x in order) for r in df.collect())
    if name == "op5_decontam":  # the SQL counts an item once, the operator each of its repeated rows
        got = sorted(set(got))
    assert sorted(df.columns) == sorted(want.columns) and got == sorted(tuple(r[i] for i in at) for r in want.fetchall()) and got


def test_language_query_against_brute_force(spark, folder):
    """The definition, word by word: log frequencies of all training texts, else the longest known n-grams."""
    train = [(t, lang) for i, t, lang, *_ in folder[1] if t is not None and lang is not None and crc(i, 4) != 2]
    langs = sorted({lang for _, lang in train})
    counts = {k: {lang: Counter() for lang in langs} for k in (0, *langid.NGRAMS)}
    for t, lang in train:
        for w, n in langid.words_of(t).items():
            counts[0][lang][w] += n
            for k in langid.NGRAMS:
                for g in langid.grams_of(w, k):
                    counts[k][lang][g] += n

    def log(kind, token):
        if not any(token in counts[kind][x] for x in langs):
            return None
        return [math.log((counts[kind][x][token] + 0.1) / (counts[kind][x].total() + 1)) for x in langs]

    def vector(word):
        if (v := log(0, word)) is not None:
            return v
        for k in langid.NGRAMS:
            found = [v for g in langid.grams_of(word, k) if (v := log(k, g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return [0.0] * len(langs)

    got = {r["doc_id"]: r for r in run(spark, folder, "op1_langid").collect()}
    assert len(got) == len(folder[1])
    for i, text, *_ in folder[1]:
        words = langid.words_of(text) if text else None
        assert got[i]["held_out"] == (crc(i, 4) == 2)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = sum(n * np.array(vector(w)) for w, n in words.items())
        odds = np.exp(total - total.max())
        if abs(total[0] - total[1]) > 1e-6:
            assert got[i]["lang_pred"] == langs[int(np.argmax(total))]
        assert got[i]["score"] == pytest.approx(float(odds.max() / odds.sum()), abs=1e-6)


def test_packed_model_equals_the_plain_one(spark, folder):
    docs = common.table(spark, folder[0], "documents")
    packed = langid.train(docs)
    plain = langid.LanguageModel(("a", "b"), {"x": np.array([1.0, 2.0])}, {k: {} for k in langid.NGRAMS})
    assert plain.vector("x")[1] == 2.0 and plain.vector("y") is None and packed.vectors([]).shape == (0, 2)
    # Every word of a sample below the bound is known, however rare and long: none of the old limits is left.
    rare = [(i, " ".join(f"{chr(97 + i % 26) * 70}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)), "l" + str(i % 2)) for i in range(40)]
    model = langid.train(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    assert len(np.unique(model.levels[0].hashes)) == len({w for _, t, _ in rare for w in t.split()}) and len(model.levels[5].hashes) > 1000


def test_toxicity_query_against_its_definition(spark, folder):
    docs, labels = (common.table(spark, folder[0], t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(common.crc_mod("doc_id", 3) != 1))
    got = {r["doc_id"]: r for r in run(spark, folder, "op2_toxicity").collect()}
    for i, text, *_ in folder[1]:
        z = model.logit(toxicity.distinct_words(text))
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == (crc(i, 3) == 1)


def test_sharding_query(spark, folder):
    got = run(spark, folder, "op6_sharding").collect()
    text = {r[0]: r[1] for r in folder[1]}
    assert len(got) == len(text) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_simhash_query(spark, folder):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, folder, "op8_simhash").collect()}
    prints = {r[0]: brute_print(r[1]) for r in folder[1]}
    least = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert got == {i: (f"{p:016x}", least[i]) for i, p in prints.items()}


def test_nearest_query_ranks_and_scores(spark, folder):
    x = folder[3].astype(np.float32).astype(np.float64)
    got = {}
    for r in run(spark, folder, "op4_ann").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(s == pytest.approx(float(x[q] @ x[v]), abs=1e-9) for _, v, s in found)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_clustered_vectors_cost_a_small_share():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, 20_000)] + 0.5 * rng.normal(size=(20_000, 64))
    index = ann.IvfPq.fit(x[rng.choice(20_000, 8192, replace=False)], 141)
    at = ann.assign(x, index.coarse)
    _, square = index.encode(x, at)
    sizes = np.bincount(at, minlength=141).astype(float)
    spread = np.bincount(at, square, 141) / np.maximum(sizes, 1)
    q = x[::100]
    who, where, _, floor = index.probes(q, sizes, spread, 20, 0.96, None)
    visited = np.zeros((len(q), 141), bool)
    visited[who, where] = True
    share = (visited * sizes).sum(axis=1).mean() / len(x)
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(0, 20_000, 100)] = -np.inf
    top = np.argsort(-scores, axis=1)[:, :20]
    assert share <= 0.2 and np.take_along_axis(visited, at[top], axis=1).mean() >= 0.95
    assert (floor <= np.take_along_axis(scores, top, axis=1)[who, -1]).mean() > 0.999


def test_repeated_items_and_partitions(spark, folder):
    got = run(spark, folder, "op5_decontam").collect()
    want = brute_decontam([r[:2] for r in folder[1]], folder[2])
    assert sorted(((r["doc_id"], r["item_id"], r["matched"], r["shingles"]) for r in got), key=str) == want and len(want) >= 2
    words = [f"w{i}" for i in range(4000)]
    rng = random.Random(3)
    items = [(i, " ".join(rng.sample(words, rng.choice([6, 30, 300, 900])))) for i in range(60)]
    s = decontam.Sketches.of(items, 5, 0.8)
    assert len(set(s.need.tolist())) >= 3 and s.need.max() > 50  # long items ask for many hits
    texts = []
    for _, t in items:
        w = t.split()
        for _ in range(len(w) // 30):
            w[rng.randrange(len(w))] = "zz"
        texts.append((len(texts), " ".join(rng.sample(words, 50) + w)))
    buf = "".join(t for _, t in texts).encode()
    offsets = np.cumsum([0, *(len(t) for _, t in texts)])
    found = sorted((d, i, m, n) for d, i, m, n in s.matches(np.frombuffer(buf, np.uint8), offsets))
    assert found == sorted(brute_decontam(texts, items)) and len(found) > 20


def test_inclusion_follows_size(spark):
    """Twelve documents of each of 30 sizes in 40 sources: each size is sampled as often as its probability says.

    The one document a source that fills the rest is chosen by size, so sources must not be tiny.
    """
    rng = random.Random(8)
    sizes = sorted(rng.sample(range(3, 60), 29)) + [400]
    rows = [(10_000 * s + 100 * j + c, "w " * n, f"s{s:03d}") for s in range(40) for j, n in enumerate(sizes) for c in range(12)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), budget=0.7).collect()
    taken, p = Counter(), {}
    for r in got:
        j = r["doc_id"] % 10_000 // 100
        taken[j] += r["copies"]
        p[j] = r["inclusion"]
    n = 480
    assert p[29] == 1.0 and taken[29] == n and len({round(v, 6) for v in p.values()}) == 30
    z = [(taken[j] - n * p[j]) / math.sqrt(n * p[j] * (1 - p[j])) for j in range(29)]
    assert max(map(abs, z)) < 4 and abs(sum(z) / len(z)) < 0.8


def test_mixing_stage_bounds_repeated_rows_and_keeps_columns(spark):
    rows = [(1, "a b c d e", "s", 7, 1)] * 200 + [(i, "w " * (i % 7 + 1), "t", i, 2) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, due int, whole int").withColumn("rank", F.lit("x")).withColumn("row", F.lit(1)).withColumn("size", F.lit(0))
    out = mixing.stage_mixing(spark, docs, "")
    sums = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("n")).collect()}
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert out.columns == docs.columns and all(abs(sums[s] - target[s]) <= 5 for s in target)


def test_clashing_columns(spark, docs):
    plain = docs.select("doc_id", "text")
    clash = plain.select("*", *[F.lit(1).alias(c) for c in ("_removed", "_id", "_k", "_gone0", "f", "d", "id", "k", "_fp", "_text", "_class", "_component", "_twice", "_root", "row", "fp", "h1", "x", "key", "_h", "_key")])
    for f in (lines.remove_lines, spans.remove_repeats, lambda df: simhash.stage_simhash(spark, df, "")):
        a, b = f(plain), f(clash)
        assert b.columns == clash.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select("doc_id", "text").collect()))


def test_long_texts_in_pieces(spark, monkeypatch):
    """Kernels that cut texts give the same results whatever the size of the pieces."""
    from lectern.llm import textkernel as tk

    rng = random.Random(5)
    text = "\n".join(prose(rng, rng.randint(1, 60)) for _ in range(60))
    raw = np.frombuffer((text + "é" + text).encode(), np.uint8)
    offsets = np.array([0, len(text.encode()) // 2, len(text.encode()), len(raw)])
    whole = [tk.word_spans(raw, offsets, tk.ALNUM), None]
    whole[1] = tk.word_hashes(raw, *whole[0][:2], 0)
    fingerprint = simhash.fingerprint(simhash.shingle_hashes(text.encode()))
    assert fingerprint == brute_print(text)
    cut = [tuple(map(str, lines.cut(t)[1:3])) for _, t, _ in lines._pieces(iter([]), 0)]
    assert cut == []
    for size in (7, 64, 1000):
        monkeypatch.setattr(tk, "CHUNK_BYTES", size)
        monkeypatch.setattr(simhash, "_PIECE", size)
        again = tk.word_spans(raw, offsets, tk.ALNUM)
        assert all((a == b).all() for a, b in zip(whole[0], again, strict=True)) and (tk.word_hashes(raw, *again[:2], 0) == whole[1]).all()
        assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == fingerprint
    monkeypatch.undo()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a\nb", text, None, "c"])], ["t"])
    rows = []
    for size in (1 << 18, 50):
        got = []
        for part, texts, line in lines._pieces(iter([batch]), 0, size):
            points, starts, ends, owner, number = lines.cut(texts)
            got += [(part.column(0)[o].as_py(), n + line, h) for o, n, h in zip(owner.tolist(), number.tolist(), lines.line_ids(points, starts, ends)[0].tolist(), strict=True)]
        rows.append(got)
    assert rows[0] == rows[1] and len(rows[0]) > 60


def test_shared_rows_of_bands_in_any_batches():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(200):
        rows = sorted({(rng.randint(0, 6), k, 0 if k == 0 else rng.randint(1, 5)) for k in rng.choices([0, 1, 2, 2, 2, 2], k=rng.randint(1, 40))})
        sent = sorted(rows + [r for r in rows if rng.random() < 0.3])
        ids, marked = {}, {b for b, k, _ in rows if k == 0}
        for b, k, i in rows:
            if k == 2:
                ids.setdefault(b, set()).add(i)
        want = {(b, i) for b, k, i in rows if k == 1 or (k == 2 and (len(ids[b]) > 1 or b in marked))}
        batches, at = [], 0
        while at < len(sent):
            part = sent[at : at + rng.randint(1, 6)]
            at += len(part)
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int8(), pa.int64()), strict=True)], ["band", "kind", "id"]))
        got = {(b, i) for o in lines.shared_rows(iter(batches)) for b, i in zip(o.column(0).to_pylist(), o.column(1).to_pylist(), strict=True)}
        assert got == want


def test_crowded_bands_lose_no_link(spark):
    """Thousands of lines of one template, and strays that share its bands: components as by brute force."""
    rng = random.Random(6)
    template = "Sign in to read the whole report number {} of the archive of public notices, terms and conditions apply here"
    texts = [template.format(i) for i in range(1500)] + [template.format(i)[: 70 + rng.randrange(10)] + "".join(rng.choice("qxzvj ") for _ in range(rng.randrange(30))) for i in range(120)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    links = lines.fuzzy_links(docs, cell=64).collect()
    points, starts, ends, _, _ = lines.cut(texts)
    ids = lines.line_ids(points, starts, ends)[0].tolist()
    grams = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    want = [(ids[i], ids[j]) for i in range(1500, len(texts)) for j in range(len(texts)) if i != j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    want += [(ids[0], ids[i]) for i in range(1, 1500)]
    assert roots(ids, [(r["src"], r["dst"]) for r in links]) == roots(ids, want)


def test_language_stage_rejects_mixed_texts(spark):
    rows = texts_by_language()
    mixed = " ".join(a if i % 2 else b for i, (a, b) in enumerate(zip(rows[0][1].split(), rows[1][1].split(), strict=False)))
    docs = spark.createDataFrame([*rows, (900, mixed, "en", "s", 0), (901, rows[0][1], None, "s", 0)], DOCS)
    kept = {r["doc_id"]: r["lang"] for r in langid.stage_langid(spark, docs, "").collect()}
    assert 900 not in kept and kept[901] == "es" and set(range(120)) <= kept.keys()
    assert {r["lang"] for r in langid.stage_langid(spark, docs, "", languages=("es",)).collect()} <= {"es", "en"}


def test_hash_is_sparks(spark):
    words = ["a", "läuft", "ciónqué", ""]
    got = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert got == langid.hashes(words).tolist() == [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
