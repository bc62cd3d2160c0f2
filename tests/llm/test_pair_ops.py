"""SimHash, lines, nearest neighbours, components, mixing, sharding and the pipeline against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import ann, lines, mixing, sharding, simhash
from lectern.llm.components import connected_components

from .conftest import DOCS, corpus, prose


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    links = {"path": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(100, 300)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "none": []}[kind]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*links, (None, 3), (4, None)], "src long, dst long")).collect()}
    live = [x for x in links if x[0] != x[1]]
    assert got == roots({n for x in live for n in x}, live)


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_matches_brute_force(spark, rows, docs):
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()
    prints = {r[1]: brute_print(r[1]) for r in rows}
    want = roots(set(prints.values()), [(a, b) for a in prints.values() for b in prints.values() if (a ^ b).bit_count() <= 3])
    least = {}
    for r in rows:
        if r[0] is not None:
            c = want[prints[r[1]]]
            least[c] = min(least.get(c, r[0]), r[0])
    expect = sorted(((r[0], prints[r[1]], least.get(want[prints[r[1]]])) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == expect
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == brute_print("A b  C")


@pytest.mark.parametrize(("blocks", "match", "cell"), [(4, 1, 1024), (4, 1, 16), (6, 3, 1024)])
def test_links_lose_no_connection(spark, blocks, match, cell):
    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    got = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), blocks=blocks, match=match, cell=cell).collect()
    mask = (1 << 64) - 1
    assert all(((r["src"] ^ r["dst"]) & mask).bit_count() <= 3 for r in got)
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3]
    assert roots(signed, [(r["src"], r["dst"]) for r in got]) == roots(signed, want)


def test_simhash_stage_keeps_one_of_each(spark, rows, docs, empty):
    kept = simhash.stage_simhash(spark, docs, "")
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(5) == 1 and {10, 30} <= set(ids) and not {11, 12, 13} & set(ids)
    classes = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(ids, key=str) == sorted(classes, key=str)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.stage_simhash(spark, empty, "").count() == 0


def shingles(s):
    return {s[i : i + 8] for i in range(max(1, len(s) - 7))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_line_verification_is_exact():
    rng = random.Random(2)
    found = []
    for _ in range(15):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 120)))
        for _ in range(4):
            at = rng.randrange(len(base))
            found.append(base[:at] + "z" + base[at + 1 :] if rng.random() < 0.8 else base + "é")
    found = sorted(set(found))
    got = lines.links_in_cell(np.zeros(len(found), np.int64), found, 0.8)
    pairs = [(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if jaccard(found[i], found[j]) >= 0.8]
    assert pairs and all(jaccard(found[a], found[b]) >= 0.8 for a, b in got)
    assert roots(range(len(found)), got) == roots(range(len(found)), pairs)


def test_signatures_reach_the_promised_recall():
    rng = random.Random(6)
    met = total = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200))
        b = a[:190] + "".join(rng.choice("qrstuv") for _ in range(8))
        if jaccard(a, b) < 0.85:
            continue
        points, starts, ends, _, _ = lines.cut([a + "\n" + b])
        keys = lines.signatures(points, starts, ends)
        met += (keys[0] == keys[1]).any()
        total += 1
    assert total > 200 and met / total >= 0.99


def test_lines_match_brute_force(spark, empty):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghijkl mnop") for _ in range(rng.randint(60, 140))) for _ in range(40)]
    rows = []
    for d in range(60):
        own = [rng.choice(base) for _ in range(rng.randint(0, 4))]
        own = [x[:-1] + rng.choice("xyz") if rng.random() < 0.4 else x for x in own] + ["", f"own line {d} {rng.random()}"]
        rows.append((d, "\n".join(own)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (None, base[0]), rows[3], (93, base[1] + "\n" + base[1])]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["removed"]) for r in lines.repeated_lines(data.withColumn("k", F.lit(1))).collect()), key=str)
    texts = sorted({x for _, t in rows if t for x in t.split("\n") if x})
    root = roots(texts, [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if jaccard(a, b) >= 0.8])
    seen, gone = set(), {}
    for key, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, x in enumerate(text.split("\n")):
            if x:
                if root[x] in seen:
                    gone.setdefault(key, []).append(i)
                seen.add(root[x])
    assert got == sorted(gone.items(), key=str)
    cleaned = {r["doc_id"]: r["text"] for r in lines.remove_lines(data).collect()}
    assert cleaned[93] in (base[1], "") and cleaned[90] is None and cleaned[92] == "\n\n"
    assert lines.repeated_lines(empty).count() == 0


def test_small_batches_change_nothing(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    results = []
    for n in ("1000", "2"):
        spark.conf.set(key, n)
        results.append((sorted(map(str, lines.repeated_lines(docs).collect())), sorted(map(str, simhash.near_duplicates(docs).collect()))))
    spark.conf.unset(key)
    assert results[0] == results[1] and results[0][0]


def exact(vectors, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    out = {}
    for i, q in vectors:
        if i % 20 == 0:
            s = x @ np.array(q, float)
            s[ids == i] = -np.inf
            best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[i] = list(zip(ids[best].tolist(), s[best].tolist(), strict=True))
    return out


def test_neighbours_recall_scores_and_common_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[rng.choice(1500, 500, replace=False)] = x[7]
    vectors = [(int(i), v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 32), (2040, [math.nan] * 32), (2060, [None] * 32), (2080, [1.0] * 5), (None, [1.0] * 32), vectors[20], (2100, [math.inf] * 32)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = exact(vectors)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9
    by = dict(vectors)
    assert all(s == pytest.approx(float(np.dot(np.float64(by[q]), np.float64(by[v]))), abs=1e-12) for q, found in got.items() for v, s in found)
    same = next(i for i in by if i % 20 == 0 and by[i] == by[7])
    assert [a for a, _ in got[same]] == [a for a, _ in want[same]]


def test_short_batches_are_gathered():
    rng = np.random.default_rng(8)
    rows = np.sort(rng.integers(0, 300, 5000))
    ids = rng.integers(0, 3, 5000)
    order = np.lexsort((ids, rows))
    whole = pa.RecordBatch.from_arrays([pa.array(rows[order]), pa.array(np.full(5000, 2, np.int8)), pa.array(ids[order])], ["band", "kind", "id"])
    short = [whole.slice(i, 7) for i in range(0, 5000, 7)]
    got = list(lines.gathered(iter(short), 1000))
    assert len(got) == 5 and pa.Table.from_batches(got).equals(pa.Table.from_batches([whole]).combine_chunks())
    rows_of = lambda batches: sorted(zip(*(np.concatenate([np.asarray(b.column(i)) for b in batches]).tolist() for i in (0, 1)), strict=True))
    assert rows_of(list(lines.shared_rows(iter(got)))) == rows_of(list(lines.shared_rows(iter(short))))
    assert list(lines.gathered(iter([]))) == []


@pytest.mark.parametrize("kind", ["cauchy", "sparse", "clusters", "tiny", "huge"])
def test_neighbours_recall_on_other_rows(spark, kind):
    rng = np.random.default_rng(3)
    n, x = 4000, rng.normal(size=(4000, 32))
    if kind == "cauchy":  # few rows are long in few directions
        x = rng.standard_cauchy((n, 32))
    elif kind == "sparse":
        x = np.where(rng.random((n, 32)) < 0.08, x, 1e-6 * x)
    elif kind == "clusters":  # of very different sizes and widths
        p = 1 / np.arange(1, 101)
        x = rng.normal(size=(100, 32))[rng.choice(100, n, p=p / p.sum())] + x * np.exp(rng.normal(size=(n, 1)) - 1)
    x = x * {"tiny": 1e-30, "huge": 1e30}.get(kind, 1.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    score = x[::20] @ x.T
    score[np.arange(200), np.arange(0, n, 20)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    found = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert len(found) == 200 * 20 and all(r["score"] == pytest.approx(score[r["query_id"] // 20, r["vec_id"]], rel=1e-9) for r in found)
    assert sum(r["vec_id"] in want[r["query_id"] // 20] for r in found) >= 0.94 * len(found)


def test_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], schema))
    assert [(r["rank"], r["vec_id"]) for r in few.where("query_id = 0").orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_mix_meets_targets_and_reruns_agree(spark, docs, rows, empty):
    got = mixing.mix(docs.withColumn("rank", F.lit(0)).withColumn("h", F.lit("x"))).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
    target = {r["source"]: r["target"] for r in got}
    most = max(r["size"] for r in got if r["source"] != "x")
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) <= most / 2 + 1 for s in target if s != "x")
    assert mixing.mix(empty).count() == 0


def test_full_sources_take_whole_copies_alone(spark):
    rows = [(1, "a b c", "s"), (2, "", "s"), (3, None, "s"), (4, "d e f g h i j k l m n o", "t")]
    got = {r["doc_id"]: (r["target"], r["copies"], r["taken"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == (6.0, 2, 6) and got[2][1:] == (2, 0) and got[3][1:] == (2, 0)


def test_targets_share_by_weight():
    assert mixing.share_targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.share_targets([0, 0], [3, 1]) == [0.0, 0.0] and mixing.share_targets([], []) == []


def test_mixing_stage_repeats_rows(spark, docs):
    sizes = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix(docs).collect() if r["doc_id"] not in (None, 5)}
    got = {}
    out = mixing.stage_mixing(spark, docs, "")
    for r in out.collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert out.columns == docs.columns and {k: v for k, v in sizes.items() if v} == {k: v for k, v in got.items() if k[0] not in (None, 5)}


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, n, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        low, high = (low, c) if n <= shards else (c + 1, high)
    return low


def test_shards_match_brute_force(spark, rows, docs, empty):
    got = sharding.assign_shards(docs.withColumn("size", F.lit("clash"))).collect()
    size = lambda t: len((t or "").encode()) + 1
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r[0])
    order = sorted(groups, key=lambda t: min((x for x in groups[t] if x is not None), default=math.inf))
    sizes = [size(t) * len(groups[t]) for t in order]
    loads = {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) == least_capacity(sizes, 8) and sum(loads.values()) == sum(sizes) and set(loads) <= set(range(8))
    for s in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    shard = {r["doc_id"]: r["shard"] for r in got if r["doc_id"] is not None}
    assert all(len({shard[i] for i in ids if i is not None}) <= 1 for ids in groups.values())
    assert sharding.assign_shards(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_minimax_search(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 40, 4000 if seed == 3 else 60]) for _ in range(150)]
    ends = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "end long")
    for shards in (1, 3, 8):
        cuts = [0, *sharding.minimax_cuts(ends, "end", sum(sizes), max(sizes), shards), sum(sizes)]
        assert len(cuts) <= shards + 1 and max(np.diff(cuts)) == least_capacity(sizes, shards)


def test_pipeline_runs_whole(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(2, 80)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[8][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert 8 not in got and 82 not in got and not {11, 12, 13} & set(got) and max(got.count(i) for i in set(got)) <= 2


def test_simhash_stage_tells_apart_texts_of_one_id(spark):
    rng = random.Random(21)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[1]), (7, texts[2]), (9, texts[3]), (3, texts[2]), (None, "Kara lono."), (None, "Kara lono."), (None, "Mivi tuse sera.")]
    kept = simhash.stage_simhash(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(7, texts[0]), (7, texts[1]), (3, texts[2]), (9, texts[3]), (None, "Kara lono."), (None, "Mivi tuse sera.")]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("wrong", [0, 2000])
def test_neighbours_of_repeated_keys_count_once(spark, wrong):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 16))
    x[[40, 60, 61]] = x[5] = 3 * x[20]  # 5, 40, 60 and 61 share one vector that is nearest to 20
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    hot = [vectors[5]] * 200 + [vectors[40]] * 30 + [(80, (3 * x[100] + 0.01 * rng.normal(size=16)).tolist()) for _ in range(400)] + [(999, [1.0] * 3)] * wrong
    df = spark.createDataFrame(vectors + hot, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (20, 40, 100)"), lists=4, probe=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == {20, 40, 100}
    for q, found in got.items():
        best = {}
        for i, v in vectors + hot[:630]:
            if i != q:
                best[i] = max(best.get(i, -math.inf), float(np.dot(v, x[q])))
        want = sorted(best.items(), key=lambda p: (-round(p[1], 9), p[0]))[:20]
        assert [a for a, _ in found] == [a for a, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])
