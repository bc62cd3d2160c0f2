"""Vector codes, line-first cleaning and ranked search against plain Python, their SQL and the edge cases they state."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lectern.llm import codes, quality, queries, ranked

from .conftest import DOCS, corpus, prose

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(23)
    docs = [r for r in corpus(5, 50) if r[0] is not None and r[0] != 5]
    menu = "Home | About | Contact\n" + prose(rng, 80)
    docs += [(2000 + i, t, "aa", "x", None) for i, t in enumerate((menu, menu * 3, "word " * 400, "a b c d e f. " * 30, "Über straße naïve. " * 20, "No end here", " ", "$$ ## && x.\n" * 60, "a|b\x0bc\td\re\x00f.\n\nA B c. \nA B c. "))]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(i, " ".join(docs[i][1].split()[:12])) for i in range(6)] + [(90, None), (91, ""), (92, "zzzz qqqq"), (93, "ÜBER Straße lono KARA kara")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    x = np.random.default_rng(3).normal(size=(400, 16)).round(2)
    x[20:60] = x[19]
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [float("nan")] * 16, 1), (1002, [None] + [0.0] * 15, 1), (1003, [float("-inf")] * 16, 2)]
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path, docs, items, rows


@pytest.mark.parametrize("name", ["op11_codes", "op12_quality", "op13_ranked"])
def test_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, folder[0])
    want = c.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    at = [want.columns.index(x) for x in order]
    assert sorted(want.columns) == order
    assert sorted((tuple(r[x] for x in order) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_columns_and_types(spark, folder):
    want = {
        "op11_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op12_quality": {"doc_id": "bigint", "base_failed": "boolean", "kept": "boolean"} | dict.fromkeys(("n_words", "n_lost", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"),
        "op13_ranked": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    }
    for name, columns in want.items():
        assert dict(queries.queries()[name](spark, folder[0]).dtypes) == columns, name


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The rule in plain integers: {id: (code, error)} and the codebooks."""
    kept = sorted((i, [math.floor(4096 * x) for x in np.float32(v).tolist()]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v in kept:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, xs in members.items():
                books[p][e] = [sum(x[j] for x in xs) // len(xs) for j in range(w)]
    out = {}
    for i, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, books


def test_codes_against_plain_integers(spark, folder):
    got = queries.queries()["op11_codes"](spark, folder[0]).collect()
    want, books = plain_codes(folder[3])
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and len(got) == len(want) == 400
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    label = {i: x for i, _, x in folder[3]}
    totals = Counter()
    for i, (_, error) in want.items():
        totals[label[i]] += error
    assert all(r["label_error"] == totals[label[r["vec_id"]]] for r in got)


def test_codes_do_not_depend_on_batches(spark, folder):
    vectors = spark.read.parquet(f"{folder[0]}/embeddings.parquet")
    rows = lambda df: sorted(map(tuple, codes.compress(df)[0].select("vec_id", "code", "error").collect()))
    whole = rows(vectors.coalesce(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(vectors.repartition(9)) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_codes_edge_cases(spark):
    empty = spark.createDataFrame([], VECTORS)
    found, books = codes.compress(empty)
    assert found.collect() == [] and books.size == 0
    odd = spark.createDataFrame([(1, [1.0] * 5, 1, "a"), (1, [0.5] * 5, 1, "b"), (1, [1.0] * 5, 1, "c"), (None, [2.0] * 8, None, "d"), (3, [], 2, "e")], VECTORS + ", code string")
    found, books = codes.compress(odd)
    rows = sorted(map(tuple, found.collect()), key=str)
    # Ids 1 (its least vector), 3 and null make three entries; lengths are filled up to 8.
    assert books.shape == (8, 3, 1) and len(rows) == 5 and {(r[0], r[1]) for r in rows} == {(1, 1), (None, None), (3, 2)}
    assert all(len(r[2]) == 16 for r in rows) and books[7, :, 0].tolist() == [0, 0, 8192]
    with pytest.raises(Exception, match="overflow"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTORS))
    assert codes.compress(spark.createDataFrame([(1, [3e4] * 64, 1), (2, [-3e4] * 64, 1)], VECTORS))[0].agg({"error": "max"}).first()[0] == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_plain_python(spark, folder):
    got = {r["doc_id"]: r for r in queries.queries()["op12_quality"](spark, folder[0]).collect()}
    assert len(got) == len(folder[1])
    for i, text, *_ in folder[1]:
        r, want = got[i], plain_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_lines_fall_and_documents_lose_too_much(spark):
    rng = random.Random(4)
    good = prose(rng, 90)
    bad = ["Home | About | Contact | Help", "login", "All rights reserved.", "Please enable JavaScript.", "no end", "It ### is *** so. $$$ yes.", "» next » last »"]
    rows = [(1, good + "\n\n" + "\n".join(bad)), (2, "\n".join(bad * 20)), (3, good), (None, None), (5, ""), (6, good + "\n" + good.replace(".", "!")), (7, prose(rng, 60) + " and it goes on and")]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")).collect()}
    assert got[1]["cleaned"] == good + "\n" and got[1]["kept"] and got[1]["n_lost"] == sum(len(x.split()) for x in bad)
    assert not got[2]["kept"] and got[2]["cleaned"] == "" and got[3]["cleaned"] == good and got[3]["n_lost"] == 0
    assert got[None]["cleaned"] is None and got[None]["base_failed"] and got[None]["n_words"] == 0 and got[5]["cleaned"] == "" and got[5]["base_failed"]
    assert got[7]["kept"], "a last line cut off in a sentence stands"
    assert quality.clean_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert "Python" not in quality.clean_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()


def test_a_very_long_text_is_counted_whole(spark):
    words = [f"w{i}" for i in range(400_000)]
    text = " ".join(words) + ". " + " ".join(words[:3]) + " " + " ".join(words[1:4])
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == plain_counts(text)[::4]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_ranking(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        wanted = set(terms_of(text)) & set(w)
        scores = []
        for i, b in bags:
            m = 100 - 90 + (90 * b.total() * n) // total
            s = sum(w[t] * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in wanted if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_ranking_against_plain_python(spark, folder):
    got = sorted(map(tuple, queries.queries()["op13_ranked"](spark, folder[0]).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_ranking([(r[0], r[1]) for r in folder[1]], folder[2]) and len(got) > 50


def test_ranking_of_copies_blocks_and_edges(spark):
    rng = random.Random(9)
    base = prose(rng, 40)
    docs = [(i, base) for i in range(300, 0, -1)] + [(None, base), (500, base + " " + prose(rng, 30)), (501, None), (502, " -- "), (503, prose(rng, 20)), (503, prose(rng, 20)), (1, base)]
    docs += [(600 + i, prose(rng, rng.randint(1, 60))) for i in range(200)]
    items = [(i, prose(rng, 8)) for i in range(30)] + [(40, " ".join(base.split()[:9])), (None, "kara lono"), (41, ""), (42, None)]
    index = ranked.build_index(spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, id int, terms int").repartition(5))
    table = spark.createDataFrame(items + items[:3], "item_id long, text string")
    want = plain_ranking(docs, items)
    for block_terms in (ranked.BLOCK_TERMS, 20):
        found = ranked.search(index, table, block_terms=block_terms)
        assert sorted(map(tuple, found.select("item", "rank", "id", "score").collect()), key=str) == want
    top = ranked.search(index, table.where("item_id = 40"), k=3).orderBy("rank").collect()
    assert [r["id"] for r in top] == [1, 1, 2] and len({r["score"] for r in top}) == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ranked.search(ranked.build_index(none), table).collect() == [] and ranked.search(index, table.where("false")).collect() == []
    two = spark.createDataFrame([(7, "kara lono"), (7, "mivi tura")], "item_id long, text string")
    assert ranked.search(index, two).select("mark").distinct().count() == 2


def test_bounds_hold_the_exact_share():
    tf, m = np.meshgrid(np.arange(1, 200), np.arange(10, 5000, 7))
    exact = ranked.term_share(tf, m)
    byte = -(-exact // ranked.STEP)
    assert byte.max() <= 255 and (byte * ranked.STEP >= exact).all() and ((byte - 1) * ranked.STEP < exact).all()
