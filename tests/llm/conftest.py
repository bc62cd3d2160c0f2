import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "se") for b in ("ra", "no", "vi", "pe") for c in ("", "s", "n", "ta")]


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 14))
        out.append(" ".join(rng.choice(words) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Invented documents with copies, near copies, shared lines, nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    rows = [[i, prose(rng, rng.randint(5, 120)), rng.choice(["aa", "bb"]), rng.choice(["x", "y", "Z", None])] for i in range(n)]
    passage = prose(rng, 70)
    for i in (3, 9, 20):
        rows[i][1] += "\n" + passage + "\n" + prose(rng, 20)
    for i in (11, 12, 13):
        rows[i][1] = rows[10][1]
    words = rows[30][1].split()
    rows[31][1] = " ".join(words[:-1] + ["zzz"])
    long = prose(rng, 30_000)
    rows += [[n, long, "aa", "x"], [n + 1, long + " more.", "aa", "x"], [n + 2, None, "aa", "x"], [n + 3, "", None, "x"], [n + 4, " \t\n", "bb", None], [None, "Kara lono mivi.", "aa", "y"], [None, None, None, None]]
    rows += [list(rows[5]), list(rows[5])]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
