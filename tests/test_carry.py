"""Scans over range partitions with a carry, greedy chains and order statistics, against the rules in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import carry, catalog, timeline

ROWS = "k string, t double, id long, v double, kind string"


def rows_of(seed, n=3000, hot=0.9, keys=12):
    """Random rows on tenths, most of them of one key; a null key too."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice([None, *(f"k{j}" for j in range(keys))])
        out.append((k, rng.randrange(0, n) / 10, i, round(rng.uniform(-5, 5), 1), rng.choice("aab")))
    return out


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[1, 3, 10_000])
def batches(request, spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_hot_key_is_many_tasks(spark):
    rows = rows_of(1, 2000)
    r = carry.ranged(spark.createDataFrame(rows, ROWS), ["k"], ["t", "id"], 6)
    parts = [(x["_part"], x["n"]) for x in r.df.where("k = 'hot'").groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(parts) >= 5 and max(n for _, n in parts) < 800
    assert len(carry.carries(r, carry.Running("id", "s"))) >= 4


def test_neighbours_and_sums(spark, batches):
    rows = rows_of(2, 600 if batches < 100 else 3000)
    df = spark.createDataFrame(rows, ROWS)
    r = carry.running(carry.previous(carry.ranged(df, ["k"], ["t", "id"], 5), {"pt": "t", "pk": "kind"}), "id", "s")
    got = {x["id"]: (x["pt"], x["pk"], x["_first"], x["s"]) for x in r.df.collect()}
    want = {}
    for rs in by_key(rows).values():
        total, last = 0, None
        for x in rs:
            total += x[2]
            want[x[2]] = (last[1] if last else None, last[4] if last else None, last is None, total)
            last = x
    assert got == want


def test_gaps_changes_stalls_and_sessions(spark, batches):
    rows = rows_of(3, 500 if batches < 100 else 2500)
    df = spark.createDataFrame(rows, ROWS)
    gaps, stalls, changed = {}, {}, []
    for k, rs in by_key(rows).items():
        best = (0, None)
        for a, b in zip(rs[:-1], rs[1:]):
            if b[3] - a[3] > best[0]:
                best = (b[3] - a[3], b[3])
        if best[1] is not None:
            gaps[k] = best
        kept = [r for i, r in enumerate(rs) if not i or r[4] != rs[i - 1][4]]
        changed += [r[2] for r in kept]
        steps = [(b[1] - a[1], a[1]) for a, b in zip(kept[:-1], kept[1:])]
        top = max((s for s, _ in steps), default=0.0)
        stalls[k] = (round(top, 1), round(next((at for s, at in steps if s == top), 0.0), 1))
    assert {r["k"]: (r["gap"], r["at"]) for r in timeline.largest_gap(df, ["k"], ["t", "id"], "v", "v", 5).collect()} == gaps
    assert sorted(r["id"] for r in timeline.changes(df, ["k"], ["t", "id"], "kind", 5).collect()) == sorted(changed)
    assert {r["k"]: (r["stall"], r["at"]) for r in timeline.longest_stall(df, ["k"], ["t", "id"], "t", "kind", 5).collect()} == stalls
    session, last, want = 0, None, {}
    for _, t, i, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        session += last is not None and t - last > 0.3
        want[i], last = session, t
    got = timeline.idle_sessions(df, [], ["t", "id"], F.col("t"), 0.3, 6)
    assert {r["id"]: r["session"] for r in got.collect()} == want and sorted(got.columns) == sorted([*df.columns, "session"])


def chain(values, least, begin, forced=None):
    out, last = [], None
    for i, v in enumerate(values):
        if (v >= begin if last is None else v - last >= least) or (forced and forced[i]):
            out.append(i)
            last = v
    return out


def test_due_is_the_exact_threshold():
    rng = np.random.default_rng(0)
    v = np.r_[rng.integers(-5000, 5000, 4000) / 10, rng.normal(size=2000) * 10.0 ** rng.integers(-12, 12, 2000), 0.0, -0.3, -1000.1]
    for least in (0.1, 0.3, 1.1, 2.0, 43200.0, 1e-9, 1000.2):
        t = carry.due(v, least)
        assert (t - v >= least).all() and not (np.nextafter(t, -np.inf) - v >= least).any()


@pytest.mark.parametrize("most", [carry.MOST_ENTRIES, 0])
def test_chains_follow_the_rule_at_exact_thresholds(spark, batches, most):
    if most == 0 and batches != 3:
        pytest.skip("doubling reads no batches")
    rng = random.Random(batches)
    for least in (0.3, 1.1, 7.0):
        rows = rows_of(rng.random(), 400 if batches < 100 else 3000, hot=rng.choice([0.5, 0.9]))
        rows += [("none", None, -1, 0.0, "a"), ("nan", math.nan, -2, 0.0, "a")]
        want = sorted(rs[i][2] for k, rs in by_key([r for r in rows if r[1] is not None and not math.isnan(r[1])]).items() for i in chain([r[1] for r in rs], least, -math.inf))
        df = spark.createDataFrame(rows, ROWS)
        got = carry.greedy(df, ["k"], ["t", "id"], "t", least, -math.inf, partitions=6, most=most)
        assert sorted(r["id"] for r in got.collect()) == want, least
        assert got.columns == df.columns


@pytest.mark.parametrize("most", [carry.MOST_ENTRIES, 5, 0])
def test_forced_rows_and_a_late_begin(spark, most):
    rng = random.Random(8)
    for begin in (5.0, 40.0, -3.0):
        rows = [("hot" if rng.random() < 0.9 else f"k{i % 5}", float(rng.randrange(-20, 400)), i, rng.random() < 0.02) for i in range(1200)]
        keyed = {}
        for r in sorted(rows, key=lambda r: (r[1], r[2])):
            keyed.setdefault(r[0], []).append(r)
        want = sorted(rs[i][2] for rs in keyed.values() for i in chain([r[1] for r in rs], 9.0, begin, [r[3] for r in rs]))
        df = spark.createDataFrame(rows, "k string, v double, id long, f boolean")
        assert sorted(r["id"] for r in carry.greedy(df, ["k"], ["v", "id"], "v", 9.0, begin, "f", 6, most).collect()) == want


def test_windows_longer_than_a_partition(spark):
    """One window covers several partitions: chains cross by very many entries."""
    rng = random.Random(4)
    rows = [("hot", rng.random() * 30, i) for i in range(4000)]
    values = sorted(r[1] for r in rows)
    want = [values[i] for i in chain(values, 11.0, -math.inf)]
    for most in (carry.MOST_ENTRIES, 10):
        got = carry.greedy(spark.createDataFrame(rows, "k string, t double, id long"), ["k"], ["t", "id"], "t", 11.0, -math.inf, partitions=8, most=most)
        assert sorted(r["t"] for r in got.collect()) == want


def test_throttle_from_zero_and_complete(spark):
    rows = [(k, n, 23) for k in ("a", "b") for n in range(1, 24)] + [("c", 3, 3), ("d", 2, 9)]
    got = timeline.throttled(spark.createDataFrame(rows, "k string, done long, total long"), ["k"], "done", "total", 5, partitions=3)
    assert sorted(map(tuple, got.collect())) == [(k, n) for k in ("a", "b") for n in (5, 10, 15, 20, 23)] + [("c", 3)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    assert timeline.largest_gap(df, ["k"], ["t", "id"], "v", "v").collect() == [] and timeline.spaced(df, ["k"], ["t", "id"], "t", 1.0, "id").collect() == []
    assert timeline.idle_sessions(df, [], ["t", "id"], F.col("t")).collect() == [] and catalog.upper_median(df, ["k"], "v").collect() == []
    with pytest.raises(ValueError, match="least"):
        carry.greedy(df, ["k"], ["t"], "t", 0.0, 0.0)


def test_median_of_a_group_of_a_million_values(spark):
    df = spark.range(1_000_000).selectExpr("'hot' as k", "cast(xxhash64(id) % 1000000007 as double) as v").union(spark.range(7).selectExpr("cast(id % 2 as string)", "cast(id as double)"))
    df = df.union(spark.sql("select null, 4.5D")).union(spark.sql("select 'hot', cast(null as double)"))
    got = {r["k"]: (r["median"], r["n"]) for r in catalog.upper_median(df, ["k"], "v", partitions=6).collect()}
    hot = sorted(r["v"] for r in df.where("k = 'hot' and v is not null").collect())
    assert got == {"hot": (hot[500_000], 1_000_000), "0": (4.0, 4), "1": (3.0, 3), None: (4.5, 1)}
    low = carry.nth_values(df.where("k <> 'hot'"), ["k"], "v", lambda n: F.lit(0)).collect()
    assert {r["k"]: r["v"] for r in low} == {"0": 0.0, "1": 1.0}
