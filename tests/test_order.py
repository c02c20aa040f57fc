"""Order statistics, merges over chunks, runs of levels, matching and interval covers against plain loops."""

import math
import random

import numpy as np
import pytest
from leadtime.operators import align, islands, order, verify
from leadtime.operators.matching import match_events
from pyspark.sql import functions as F


def plain_quantile(values, f):
    x = sorted(values)
    at = (len(x) - 1) * f
    low, high = math.floor(at), math.ceil(at)
    return x[low] if low == high or x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high]


FRACTIONS = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("small", [10_000, 0])
def test_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL_GROUP", small)
    rng = random.Random(small)
    groups = {"ties": [rng.randrange(4) for _ in range(300)], "one": [7.5], "two": [1.0, 2.0], None: [rng.gauss(0, 1) for _ in range(501)], "skew": [rng.random() ** 9 * 1e-6 for _ in range(20_000)]}
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("nulls", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r["g"], r["place"]): r["quantile"] for r in order.quantiles(df, ["g"], "v", FRACTIONS).collect()}
    assert found == {(g, i): plain_quantile(values, f) for g, values in groups.items() for i, f in enumerate(FRACTIONS)}
    whole = [x for _, x in rows if x is not None]
    assert [r["quantile"] for r in order.quantiles(df, [], "v", FRACTIONS).orderBy("place").collect()] == [plain_quantile(whole, f) for f in FRACTIONS]
    assert order.quantiles(df.where("false"), ["g"], "v", FRACTIONS).collect() == []


def test_quantiles_of_a_large_group(spark):
    df = spark.range(1_000_000).select(F.exp(F.randn(2) * 5).alias("v"))
    values = np.sort(df.toPandas()["v"].to_numpy())
    found = [r["quantile"] for r in order.quantiles(df, [], "v", FRACTIONS).orderBy("place").collect()]
    for x, f in zip(found, FRACTIONS):
        at = (len(values) - 1) * f
        low, high = math.floor(at), math.ceil(at)
        assert x == (values[low] if low == high else (high - at) * values[low] + (at - low) * values[high])
    plan = order.quantiles(df, [], "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_place(spark):
    values = [1.0, 2.0, 2.0, 5.0]
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 4.9, 5.0, 9.0, None)], "x double").select("x", order.place(F.array(*map(F.lit, values)), F.col("x"), 4).alias("n"))
    assert [r["n"] for r in df.collect()] == [0, 1, 3, 3, 4, 4, 0]


def test_ranges_follow_skewed_scores(spark):
    scores = spark.range(40_000).select((F.pow(F.rand(1), 6) * 1e-3).alias("p")).distinct()
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # ranges this small would become one
    spark.conf.set(key, "false")
    try:
        sizes = [r["count"] for r in order.ranges(scores, ["p"]).groupBy("_r").count().collect()]
    finally:
        spark.conf.unset(key)
    assert len(sizes) == 4 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_roc_of_tiny_scores(spark):
    rng = random.Random(5)
    rows = [(1, int(rng.random() < 0.3), round(rng.random() ** 4 * 1e-3, 7)) for _ in range(400)]
    found = verify.roc_auc(spark.createDataFrame(rows, "t int, y int, p double"), ["t"]).first()["roc_auc"]
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    assert math.isclose(found, sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def runs(steps, gap=1):
    out = []
    for t in steps:
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


@pytest.mark.parametrize("gap", [1, 2, 9])
@pytest.mark.parametrize("wider", [2, 1000])
def test_islands_of_alternating_flags(spark, monkeypatch, gap, wider):
    monkeypatch.setattr(islands, "WIDER", wider)
    rng = random.Random(gap)
    series = {"alternating": list(range(-60, 60, 2)), "random": sorted(rng.sample(range(200), 90)), "all": list(range(100)), "far": [0, 1, 5000, 5001]}
    df = spark.createDataFrame([(s, t, 2) for s, steps in series.items() for t in steps], "s string, t bigint, v int")
    found = {(r["s"], r["first"], r["last"], r["n"], r["sum"]) for r in islands.islands(df, ["s"], "t", F.lit(True), gap, {"sum": (F.col("v"), F.sum)}, chunk_steps=5).collect()}
    assert found == {(s, a, b, n, 2 * n) for s, steps in series.items() for a, b, n in runs(steps, gap)}


def test_long_intervals_merge_over_chunks(spark):
    parts = [(0, 3), (5, 47), (49, 49), (60, 61), (70, 119), (121, 122), (200, 201)]
    df = spark.createDataFrame(parts, "a bigint, b bigint")
    found = sorted((r["first"], r["last"]) for r in islands.coalesced(df, [], "a", "b", 2, {}, chunk_steps=10).collect())
    assert found == [(0, 49), (60, 61), (70, 122), (200, 201)]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_runs_of_levels(spark, chunk):
    rng = random.Random(chunk)
    rows = [(s, t, rng.randrange(5)) for s in "ab" for t in range(120) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "s string, t bigint, v int")
    found = {(r["s"], r["level"], r["first"], r["last"], r["n"], r["o"], r["c"]) for r in islands.runs_by_level(df, ["s"], "t", "v", {"o": F.col("t") * 2}, {"c": F.col("t") * 3}, chunk).collect()}
    assert found == {(s, k, a, b, n, 2 * a, 3 * b) for s in "ab" for k in range(1, 5) for a, b, n in runs([t for x, t, v in rows if x == s and v >= k])}


def segments(rng, n, length):
    out, t = [], 0
    for _ in range(n):
        t += rng.randrange(1, 5)
        end = t + rng.randrange(length)
        out.append((t, end))
        t = end + 1
    return out


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_matches_of_many_shapes(spark, chunk):
    truth, alarms, want = [], [], set()
    for seed in range(120):
        rng = random.Random(seed)
        true, alarm = segments(rng, rng.randrange(1, 9), rng.choice([2, 6, 15])), segments(rng, rng.randrange(1, 12), rng.choice([2, 5, 25]))
        taken = set()
        for a, b in alarm:
            free = [k for k, (c, d) in enumerate(true) if k not in taken and a <= d and b >= c]
            if free:
                k = min(free, key=lambda k: abs(true[k][0] - a))
                taken.add(k)
                want.add((seed, 1, a, true[k][0]))
        truth += [(seed, *x) for x in true]
        alarms += [(seed, 1, *x) for x in alarm]
    t = spark.createDataFrame(truth, "s int, first bigint, last bigint")
    a = spark.createDataFrame(alarms, "s int, setting int, first bigint, last bigint")
    assert {tuple(r) for r in match_events(t, a, ["s", "setting"], chunk).collect()} == want


@pytest.mark.parametrize("bucket", [1, 7])
def test_intervals_of_all_lengths(spark, bucket):
    rng = random.Random(bucket)
    intervals = [(i, a, a + rng.choice([0, 1, 5, 90, 700])) for i, a in enumerate(rng.choices(range(-300, 1000), k=60))] + [(99, -(10**9), 10**9), (100, 3, 4)]
    steps = sorted(rng.sample(range(-400, 1500), 300))
    df = spark.createDataFrame([(t,) for t in steps], "t bigint")
    spans = spark.createDataFrame(intervals, "id int, a bigint, b bigint")
    found = sorted((r["t"], r["id"]) for r in align.steps_in_intervals(df, "t", spans, "a", "b", bucket).select("t", "id").collect())
    assert found == sorted((t, i) for t in steps for i, a, b in intervals if a <= t < b)
    sizes = spans.select(F.size(align.cover(F.col("a"), F.col("b"), bucket)).alias("n")).collect()
    assert max(r["n"] for r in sizes) < 2 * align.FAN * 9
