"""Operators of catalogued events and running sums, by hand and against one window per series."""

import datetime as dt
import random

import pytest
from leadtime.operators import align, blocks, events, islands, running, validate
from pyspark.sql import Window
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(5)
    data = [(k, t, r.choice([None, r.randint(-9, 9)])) for k in ("a", "b", None) for t in sorted(r.sample(range(200), 60))]
    return spark.createDataFrame(data, "s string, t bigint, v bigint").cache()


@pytest.mark.parametrize("chunk", [7, 1000])
@pytest.mark.parametrize("before", [False, True])
def test_running_equals_one_window(series, chunk, before):
    w = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = series.select("s", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("total"), F.max("v").over(w).alias("top"))
    got = running.running(series, ["s"], ["t"], F.floor(F.col("t") / chunk), {"total": F.col("v")}, {"top": F.col("v")}, before)
    assert rows(got, "s", "t", "total", "top") == rows(want, "s", "t", "total", "top")


@pytest.mark.parametrize("chunk", [5, 10_000])
def test_segments_and_blocks_equal_one_window(series, chunk):
    w = Window.partitionBy("s").orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) > 5, 1).otherwise(0)
    want = series.withColumn("new", new).withColumn("segment", F.sum("new").over(w))
    assert rows(islands.gap_segments(series, ["s"], "t", 5, chunk), "s", "t", "segment") == rows(want, "s", "t", "segment")
    spans = series.withColumn("end", F.col("t") + F.abs(F.coalesce("v", F.lit(1))) + 1)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = spans.withColumn("new", F.when(F.col("t") < reach, 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    assert rows(islands.merge_intervals(spans, ["s"], "t", "end", chunk=chunk), "s", "t", "block") == rows(want, "s", "t", "block")


@pytest.mark.parametrize("chunk", [4, 10_000])
def test_samples_and_peaks_by_place(spark, chunk):
    df = spark.createDataFrame([("a", t, float(x)) for t, x in zip((0, 3, 4, 9, 12, 20), (1, -7, 2, 3, 0, 5))], "s string, t bigint, x double")
    assert rows(islands.sample_index(df, ["s"], "t", 2, F.col("x") > 0, chunk), "t") == [(0,), (4,)]
    assert rows(islands.downsample_peaks(df, ["s"], "t", "x", 2, chunk), "t", "x") == [(20, 5.0), (3, -7.0)]


@pytest.mark.parametrize("chunk", [2, 100])
def test_monotone_over_chunks(spark, chunk):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 1, 2, 3, 4, 5])] + [("b", i, t) for i, t in enumerate([0, 1, 3, 2, 4, 5])], "s string, at bigint, h bigint")
    assert rows(validate.axis_report(df, ["s"], "h", 0, 5, F.col("at"), chunk), "s", "monotone") == [("a", True), ("b", False)]


def test_catalogue_cells(spark):
    cells = [
        ("1", "07.06.2013", "3.05", "-12,5", "CME"), ("18*", "7.6.2013", "3:05", "1", "CIR"), ("2", "07.06.2013", "3 : 05", "2,0", "CME+CIR"), ("3", "31.02.2013", "1.00", "2", "CME"),
        ("4", "07.06.2013", "1.00", "x", "SC CME"), ("5x", "07.06.2013", "1.00", "2", "CME"), ("6", "07.06.2013", None, "2", "CIR"), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(cells, "n string, d string, c string, p string, st string")
    got = {r.event_id: r for r in events.parse_catalog(df, "n", "d", "c", "p", "st").collect()}
    at = dt.datetime(2013, 6, 7, 3, 5)
    assert (got[1].peak_time, got[1].peak_abs, got[1].driver, got[1].status) == (at, 12.5, "CME", "selected")
    assert (got[18].peak_time, got[18].status) == (at, "excluded_engineering")
    assert (got[2].peak_time, got[2].driver) == (at, "CIR")
    assert (got[3].status, got[6].status) == ("excluded_time", "excluded_time")
    assert (got[4].status, got[4].peak_abs) == ("excluded_driver", None)
    assert set(got) == {1, 2, 3, 4, 6, 18}


def test_availability_by_series(spark):
    grid = [(s, k, None if (s, k) in (("a", 3), ("a", 4)) else 1.0, None if k == 6 else 1.0) for s in ("a", "b") for k in range(10)]
    df = spark.createDataFrame(grid, "s string, k bigint, f double, g double")
    ev = spark.createDataFrame([("a", 1, 2, 8), ("b", 2, 2, 8), ("b", 3, 0, 3)], "s string, event_id int, start bigint, end bigint")
    got = events.availability(df, "k", ["f", "g"], ev, 2, 4, ["s"])
    assert rows(got, "event_id", "longest", "worst", "excluded") == [(1, 2, "f", True), (2, 1, "g", False), (3, 0, "g", False)]


def test_timeline_masks_end_at_blocks(spark):
    df = spark.createDataFrame([(k, 1) for k in range(12)], "k bigint, m int")
    b = spark.createDataFrame([(1, 2, 9, "train")], "block int, start bigint, end bigint, split string")
    got = events.event_timeline(df, "k", b, {"m": (1, 2)}, 1, 5)
    assert rows(got, "k", "m") == [(k, int(4 <= k <= 7)) for k in range(2, 9)]
    seen = events.split_manifest(b.withColumn("n_events", F.lit(3)), got, ["train", "test"], ["m"], "k")
    assert rows(seen, "split", "n_blocks", "n_events", "n_steps", "valid_m", "first_step") == [("test", 0, 0, 0, 0, None), ("train", 1, 3, 7, 4, 2)]


def test_onset_is_that_of_the_run_nearest_the_peak(spark):
    x = [0, 9, 9, 0, 0, -9, 9, 9, 0, 9, None, 0]
    df = spark.createDataFrame([("a", k, None if v is None else float(v)) for k, v in enumerate(x)], "s string, k bigint, x double")
    ev = spark.createDataFrame([("a", 1, 4, 0, 12), ("a", 2, 6, 6, 12), ("a", 3, 8, 0, 12), ("b", 4, 5, 0, 12)], "s string, event_id int, peak bigint, start bigint, end bigint")
    got = events.event_onsets(df, "k", "x", ev, [5, 50], 7, ["s"])
    assert rows(got, "event_id", "threshold", "onset") == [(1, 5, 5), (2, 5, 6), (3, 5, 5)]


def test_warnings_by_own_points(spark):
    p = [0.1, 0.6, 0.6, 0.1, 0.6, 0.1, 0.1, 0.1, 0.9, 0.1]
    df = spark.createDataFrame([("a", t, h, int(h in (4, 5)), v) for t in (1, 2) for h, v in enumerate(p)], "s string, threshold int, h bigint, y int, p double")
    at = spark.createDataFrame([(1, 0.5, 1, 1, 2), (2, 0.8, 1, 0, 1), (3, 0.5, 1, 0, 1)], "threshold int, cutoff double, min_run int, merge_gap int, min_length int")
    alarms = events.decided_alarms(df, "h", at, ["s", "threshold"], ["threshold"])
    assert rows(alarms, "threshold", "first", "last") == [(1, 1, 4), (2, 8, 8)]
    onsets = spark.createDataFrame([("a", 1, 5), ("a", 2, 5)], "s string, threshold int, onset bigint")
    found = events.event_warnings(df, "h", alarms, onsets, ["s", "threshold"], 3)
    assert rows(found, "threshold", "first_alarm", "lead") == [(1, 2, 3), (2, None, None)]
    episodes = events.alarm_episodes(df, "h", alarms, ["s", "threshold"])
    assert rows(episodes, "threshold", "target_steps", "duration", "matched") == [(1, 1, 4, True), (2, 0, 1, False)]
    summed = events.warning_summary(found, episodes, at, ["threshold"])
    want = [(1, 1, 1, 0, 1.0, 1, 0.0), (2, 1, 0, 1, 0.0, 0, 1.0), (3, 0, 0, 0, None, 0, None)]
    assert rows(summed, "threshold", "eligible", "detected", "missed", "pod", "true_episodes", "false_ratio") == want


def test_rows_that_collide_on_a_step(spark):
    df = spark.createDataFrame([("a", 30), ("a", 90), ("a", 150), ("b", 30), ("b", 59)], "s string, t bigint")
    report = align.alignment_report(align.floor_to_step(df, "t", 60), ["s"])
    assert rows(report, "s", "n_steps", "n_collisions", "n_offsets", "least_offset", "ok") == [("a", 3, 0, 1, 30, True), ("b", 1, 1, 2, 30, False)]
    with pytest.raises(Exception, match="check failed"):
        validate.require(report, "ok").collect()


def test_counts_and_groups_without_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "block int")
    assert validate.row_count(df, 3).first().ok and not validate.row_count(df, 4).first().ok
    known = spark.createDataFrame([(1,), (2,), (3,)], "block int")
    assert rows(validate.covered(known, df, ["block"]), "block", "n_rows", "ok") == [(1, 2, True), (2, 1, True), (3, 0, False)]


def test_too_few_blocks_for_folds(spark):
    with pytest.raises(Exception, match="3 folds need 4 blocks"):
        blocks.forward_folds(spark.createDataFrame([(i, i) for i in range(3)], "block int, start int")).collect()
