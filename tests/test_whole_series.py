"""Queries on series return all rows, by plain loops over the fixture."""

from leadtime.operators import islands
from leadtime.plans import series
from leadtime.plans import standins as s
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_sequences_of_every_hour(spark):
    x = {(r.series, r.h): r.x for r in s.hourly(spark, SF).collect()}
    want = {k for k in x if all(x.get((k[0], k[1] - b)) is not None for b in (4, 3, 2))}
    got = [(r.series, r.h) for r in series.sequence_windows(spark, SF).collect()]
    print("sequences", len(got), "of every fifth hour", sum(h % 5 == 0 for _, h in got))
    assert len(got) == len(set(got)) and set(got) == want


def test_gaps_over_all_days(spark, monkeypatch):
    days = [(k, *[None if 3 <= k <= 16 else 1.0] * 4) for k in range(20)]
    monkeypatch.setattr(s, "daily", lambda *_: spark.createDataFrame(days, "k bigint, f_sum_qty double, f_max_price double, f_avg_disc double, resp double"))
    got = {tuple(r) for r in series.long_missing_intervals(spark, SF).select("feature", "start_k", "end_k", "days").collect()}
    assert got == {(f, 3, 16, 14) for f in ("f_sum_qty", "f_max_price", "f_avg_disc", "resp")}


def test_runs_break_where_steps_are_missing(spark):
    rows = spark.createDataFrame([("a", k) for k in (1, 2, 4, 5, 6)], "feature string, k bigint")
    got = sorted((r["first"], r["last"]) for r in islands.islands(rows, ["feature"], "k", F.lit(True)).collect())
    assert got == [(1, 2), (4, 6)]
