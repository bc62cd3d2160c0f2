"""Language ID, toxicity, decontamination, spans and licences against brute force and on edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontam, langid, licences, spans, toxicity

from .conftest import DOCS, prose


def texts_by_language(n=120):
    rng = random.Random(3)
    a = [f"{x}{y}" for x in ("the", "ing", "wor", "sto") for y in ("ab", "er", "th", "en")]
    b = [f"{x}{y}" for x in ("qué", "ñan", "ció", "rro") for y in ("os", "ar", "ez", "la")]
    return [(i, prose(rng, 30, a if i % 2 else b), "en" if i % 2 else "es", "s", 0) for i in range(n)]


def test_language_held_out_accuracy_and_edges(spark):
    data = spark.createDataFrame([*texts_by_language(), (900, None, "en", "s", 0), (901, "123 !!", None, "s", 0), (902, "½²", "en", "s", 0)], DOCS)
    train = data.where("doc_id % 4 <> 2")
    got = {r["doc_id"]: r for r in langid.predict(data, langid.train(train)).collect()}
    held = [r for r in got.values() if r["doc_id"] < 900 and r["doc_id"] % 4 == 2]
    assert held and all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))


def test_language_backs_off_to_shorter_grams():
    m = langid.LanguageModel(("a",), {"known": [1.0]}, {5: {}, 4: {}, 3: {"^xy": [2.0]}, 2: {"xy": [9.0]}, 1: {"x": [9.0]}})
    assert m.vector("known") == [1.0] and list(m.vector("xyz")) == [2.0] and list(m.vector("ax")) == [9.0] and m.vector("q") is None


def test_language_empty_and_clashing_columns(spark, empty):
    assert langid.identify(empty).count() == 0
    data = spark.createDataFrame([(1, "abc", "en", "old", 0.3)], "doc_id long, text string, lang string, lang_pred string, score double")
    assert langid.identify(data).columns == ["doc_id", "lang", "lang_pred", "score"]


def test_language_stage_keeps_clean_documents(spark):
    data = spark.createDataFrame([*texts_by_language(), (900, None, "en", "s", 0), (901, "12", "en", "s", 0)], DOCS)
    kept = langid.stage_langid(spark, data, "")
    assert kept.columns == data.columns and {r["doc_id"] for r in kept.collect()} == set(range(120))


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(9)
    out = []
    for i in range(400):
        text = prose(rng, 40)
        if i % 5 == 0:
            w = text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["vilefoo", "vilebar", "grimbaz"]))
            if i % 10 == 0:  # a group is mentioned more often in toxic texts
                w.insert(rng.randrange(len(w)), "muslims")
            text = " ".join(w)
        out.append((i, text, int(i % 5 == 0)))
    return out


def test_toxicity_finds_held_out_and_ignores_groups(spark, toxic_rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_rows] + [(900, None), (901, ""), (902, "muslims kara lono"), (903, "christians kara lono"), (904, "vilefoo")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows] + [(950, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in toxic_rows if i % 3 == 1]
    assert all((s >= 0.7) == bool(y) for s, y in held)
    assert abs(got[902] - got[903]) < 0.05 and got[902] < 0.5 and got[900] == got[901] < 0.5 and got[904] > 0.7


def test_toxicity_penalty_shrinks_identity_weights(spark, toxic_rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows], "doc_id long, toxic int")
    plain, fair = (toxicity.train(docs, labels, swap_penalty=p) for p in (0.0, 1.0))
    gap = lambda m: abs(m.logit({"muslims"}) - m.logit({"christians"}))
    assert gap(fair) < 0.2 * gap(plain)


def test_toxicity_without_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty.select("doc_id", "text"), toxicity.train(empty, labels)).count() == 0


def brute_decontam(rows, items, t=0.8):
    grams = lambda x: {tuple(w[i : i + 5]) for w in [re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))] for i in range(len(w) - 4)}
    out = []
    for d in rows:
        a = grams(d[1])
        for k, x in items:
            b = grams(x)
            if b and len(a & b) >= t * len(b) - 1e-9:
                out.append((d[0], k, len(a & b), len(b)))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark, rows, docs):
    rng = random.Random(4)
    items = []
    for k in range(60):
        w = rng.choice([r for r in rows if r[1] and len(r[1].split()) > 40])[1].split()
        at = rng.randrange(len(w) - 30)
        part = w[at : at + rng.randint(5, 30)]
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "other"
        items.append((k, "  ".join(part).upper() if k % 2 else ", ".join(part)))
    items += [(100, None), (101, ""), (102, "one two three four"), (103, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contained_items(docs.withColumn("key", F.lit(1)), bench)
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute_decontam(rows, items)
    assert len(brute_decontam(rows, items)) > 20


def test_decontamination_blocks_and_empty(spark, rows, docs, empty, monkeypatch):
    bench = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:12])], "item_id long, text string")
    whole = sorted(map(str, decontam.contained_items(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    assert sorted(map(str, decontam.contained_items(docs, bench).collect())) == whole
    assert decontam.contained_items(empty, bench).count() == 0 and decontam.contained_items(docs, bench.limit(0)).count() == 0


def test_decontamination_stage(spark, rows, docs, tmp_path):
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = decontam.stage_decontam(spark, docs, str(tmp_path))
    ids = [r["doc_id"] for r in kept.collect()]
    assert 7 not in ids and len(ids) == len(rows) - 1 and kept.columns == docs.columns


def units(text, longest=20):
    out = []
    for line in text.split("\n"):
        part = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            part.append(w)
            if len(w) > 1 and w[-1] in ".!?" and w[-2] not in ".!?,;:":
                out.append(part)
                part = []
        out.append(part)
    return [p[i : i + longest] for p in out for i in range(0, len(p), longest)]


def brute_spans(rows, run=3, least=12):
    seen, gone = {}, {}
    for key, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        u = units(text)
        for i in range(len(u) - run + 1):
            part = u[i : i + run]
            if sum(map(len, part)) >= least:
                h = tuple(map(tuple, part))
                if h in seen:
                    gone.setdefault((key, text), set()).update(range(i, i + run))
                seen.setdefault(h, (key, i))
    return sorted(((k[0], sorted(v)) for k, v in gone.items()), key=str)


def test_spans_match_brute_force(rows, docs):
    got = spans.repeated_sentences(docs.withColumn("k", F.lit("clash")).withColumn("h1", F.lit(0)))
    assert sorted(((r["doc_id"], r["removed"]) for r in got.collect()), key=str) == brute_spans(rows)
    assert {3, 9, 20, 11} - {r[0] for r in brute_spans(rows)} == {3}


def test_removed_sentences_leave_the_text(spark, docs, empty):
    data = spark.createDataFrame([(1, "Aa bb cc dd. Ee ff gg hh. Ii jj kk ll. Own end."), (2, "First. Aa bb cc dd. Ee ff gg hh. Ii jj kk ll. Last."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(data).collect()}
    assert got == {1: "Aa bb cc dd. Ee ff gg hh. Ii jj kk ll. Own end.", 2: "First. Last.", 3: None}
    assert spans.repeated_sentences(empty).count() == 0 and spans.remove_repeats(docs).count() == docs.count()


def test_licences_match_brute_force(spark, empty):
    mit = licences.TEMPLATES["MIT"]
    data = [(1, "Text\nReleased under the MIT License.\nmore"), (2, mit), (3, "Intro line\n\n" + mit.replace("copies", "a copy") + "\nOutro words here"), (4, "nothing"), (5, None), (6, ""), (7, "released UNDER the mit license"),
            (8, "Licensed under the Apache License, Version 2.0."), (9, "All rights reserved. " * 40)]
    got = {(r["doc_id"], r["licence"]): r["dice"] for r in licences.scan_licences(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = {}
    for key, text in data:
        lines = (text or "").split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                for name, template in licences.TEMPLATES.items():
                    d = licences.dice(licences.bigrams("\n".join(lines[i : j + 1])), licences.bigrams(template))
                    if d >= 0.9:
                        want[key, name] = max(d, want.get((key, name), 0))
    assert got == pytest.approx(want) and (3, "MIT") in got and (9, "All-rights-reserved") not in got
    assert licences.scan_licences(empty).count() == 0


def test_letters_unknown_to_the_model_get_a_learned_language(spark):
    data = [(i, ("der hund läuft " if i % 2 else "the dog runs ") * 3, "de" if i % 2 else "en") for i in range(20)] + [(90, "Привет мир", None), (91, "12 ...", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert got[90] == ("de", 0.5) and got[91] == ("und", 0.0) and got[1][0] == "de" and got[2][0] == "en"


def test_licences_within_lines_and_across_line_ends(spark):
    mit = licences.TEMPLATES["MIT"]
    rng = random.Random(7)
    around = [prose(rng, 300), prose(rng, 300)]
    data = [(1, "Intro\nCopyright 2024 Acme. All rights reserved.\nOutro"), (2, "This file is released under the MIT License."), (3, f"{around[0]} {' '.join(mit.split())} {around[1]}"),
            (4, "Released under the MIT\nLicense."), (5, "Kara\n" + "\n".join("Released under the MIT License.".split())), (6, "Kara lono.\n" + mit.replace("copies", "a copy") + " Lono kara."), (7, "All rights. Reserved seats of the MIT.")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    words = {(r["doc_id"], r["licence"]): (r["dice"], r["first_line"], r["last_line"]) for r in licences.scan_licences(docs, whole_lines=False).collect()}
    want = {}
    for key, text in data:
        stream = [(w, i) for i, line in enumerate(text.lower().split("\n")) for w in licences._WORD.findall(line)]
        for name, template in licences.TEMPLATES.items():
            grams = licences.bigrams(template)
            for i in range(len(stream)) if len(stream) < 100 or name == "MIT" else ():
                low, high = int(grams.total() * 0.8), int(grams.total() * 1.25) + 3
                for j in range(i + low, min(len(stream), i + high)):
                    if stream[i][0] not in template.lower():
                        continue
                    part = [w for w, _ in stream[i : j + 1]]
                    d = licences.dice(licences.Counter(zip(part, part[1:], strict=False)), grams)
                    if d >= 0.9 and d > want.get((key, name), (0,))[0]:
                        want[key, name] = (d, stream[i][1], stream[j][1])
    assert words == want
    assert words[1, "All-rights-reserved"] == (1.0, 1, 1) and words[2, "MIT-notice"] == (1.0, 0, 0) and words[3, "MIT"] == (1.0, 0, 0) and (7, "All-rights-reserved") in words
    assert words[4, "MIT-notice"] == (1.0, 0, 1) and words[5, "MIT-notice"] == (1.0, 1, 5) and 0.9 < words[6, "MIT"][0] < 1
    lines = {(r["doc_id"], r["licence"]): (r["dice"], r["first_line"], r["last_line"]) for r in licences.scan_licences(docs).collect()}
    assert lines[4, "MIT-notice"] == (1.0, 0, 1) and lines[5, "MIT-notice"] == (1.0, 1, 5) and (2, "MIT-notice") not in lines


def test_licence_query_scans_words(spark, tmp_path):
    spark.createDataFrame([(1, "Copyright 2024 Acme. All rights reserved.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in licences.op10_licences(spark, str(tmp_path)).collect()] == [(1, "All-rights-reserved", 1.0, 0, 0)]


def test_short_runs_are_extended_on_request(spark):
    menu = "\n".join(f"mi{i} no{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "Own start\n" + menu), (2, menu + "\nown end here"), (3, "a b\nc d\ne f")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in spans.repeated_sentences(docs, extend=True).collect()}
    assert got == {2: list(range(40))} and spans.repeated_sentences(docs).count() == 0
    assert {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs, extend=True).collect()}[2] == "own end here"


def test_passages_are_found_wherever_they_begin(spark):
    rng = random.Random(31)
    rows, planted = [], {}
    for i in range(60):
        passage = [f"w{rng.randrange(10**6)}" + (rng.choice(["", "", "", ",", "."]) if i % 2 else "") for _ in range(50)]
        for key in (2 * i, 2 * i + 1):
            before, after = ([f"x{rng.randrange(10**9)}" for _ in range(rng.randint(0, 45))] for _ in range(2))
            text = " ".join(before + passage + after)
            rows.append((key, text.replace(" ", "\n", rng.randrange(20))))
        planted[2 * i + 1] = (set(passage), set(before + after))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: set(r["text"].split()) for r in spans.remove_repeats(docs, extend=True, within=8).collect()}
    assert all(len(passage - got[key]) >= 12 and own <= got[key] for key, (passage, own) in planted.items())
    assert all(got[key] == set(text.split()) for key, text in rows if key % 2 == 0)
    assert spans.repeated_sentences(docs).count() < 30
