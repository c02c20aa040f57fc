"""Streams that let state go, and products rebuilt day by day."""

import datetime as dt
import os
import random

import pytest
from leadtime.functions import times
from leadtime.sources import files
from leadtime.streaming import resample
from pyspark.sql import functions as F

SCHEMA = "series string, t timestamp_ntz, v double, id bigint"


def landed(spark, folder, batches):
    for batch in batches:
        rows = spark.createDataFrame(batch, "series string, minute long, v double, id bigint")
        stamped = rows.select("series", F.timestamp_add("MINUTE", F.col("minute"), F.lit("2024-03-30 00:00:00").cast("timestamp_ntz")).alias("t"), "v", "id")
        stamped.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def best(rows):
    out = {}
    for series, minute, v, i in rows:
        key = (series, minute // 60)
        if key not in out or (abs(v), -i) > (abs(out[key][0]), -out[key][1]):
            out[key] = (v, i)
    return {k: v for k, (v, _) in out.items()}


def hours(df):
    since = times.micros(F.col("start")) - times.micros(F.lit("2024-03-30 00:00:00").cast("timestamp_ntz"))
    return {(r["series"], r["since"] // 3_600_000_000): r["v"] for r in df.select("series", since.alias("since"), "v").collect()}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
def test_resampled_stream_equals_the_table(spark, tmp_path, zone):
    rng = random.Random(1)
    batches = [[(s, m, round(rng.uniform(-9, 9), 1), k * 10_000 + 2 * m + (s == "b")) for m in range(k * 600, k * 600 + 600, 7) for s in "ab"] for k in range(8)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stream = landed(spark, str(tmp_path), batches)
        done = resample.drain(resample.stream_resample(stream, "series", "t", "v", "id", late="2 hours"), str(tmp_path), "append")
        found = resample.resampled(spark, str(tmp_path), "series", "v")
        assert found.count() == len(best(sum(batches, []))) and hours(found) == best(sum(batches, []))
        still = resample.open_steps(spark, str(tmp_path), "series", "v")
        assert 0 < still.count() <= 2 * 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    # A batch has 10 hours of 2 series; what is left of the one before are 2 hours and the one it ends in.
    assert done.late_rows == 0 and done.state_rows <= 2 * (10 + 10 + 3) and done.batches >= 8


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    batches = [[("a", m, 1.0, m) for m in range(0, 600, 10)], [("a", m, 1.0, m) for m in range(600, 1200, 10)], [("a", 5, 9.0, -1), ("a", 1195, 5.0, -2)]]
    stream = landed(spark, str(tmp_path), batches)
    done = resample.drain(resample.stream_resample(stream, "series", "t", "v", "id", late="1 hour"), str(tmp_path), "append")
    found = hours(resample.resampled(spark, str(tmp_path), "series", "v"))
    assert done.late_rows == 1 and found[("a", 0)] == 1.0 and found[("a", 19)] == 5.0 and len(found) == 20


def write_day(spark, folder, day, values):
    spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/day={day}")


def test_only_touched_days_are_rebuilt(spark, tmp_path):
    folder = str(tmp_path)
    built = []

    def build(paths):
        built.append(len(paths))
        return spark.read.option("basePath", f"file://{folder}/in").schema("v long, day string").parquet(*paths).groupBy("day").agg(F.sum("v").alias("total"))

    def run():
        return files.rebuild_by_day(spark, f"{folder}/in", f"{folder}/out", build, r"day=(\d{8})")

    def state():
        return {(d, f): os.stat(f"{folder}/out/{d}/{f}").st_mtime_ns for d in os.listdir(f"{folder}/out") if d.startswith("day=") for f in os.listdir(f"{folder}/out/{d}")}

    def totals():
        return {r["day"]: r["total"] for r in spark.read.schema("total long, day string").parquet(f"{folder}/out").collect()}

    for k in range(1, 5):
        write_day(spark, folder, f"2024010{k}", [k, 10])
    assert run() == [f"2024010{k}" for k in range(1, 5)] and totals() == {f"2024010{k}": k + 10 for k in range(1, 5)}
    assert run() == [] and len(built) == 1
    before = state()
    write_day(spark, folder, "20240102", [500])
    spark.createDataFrame([(7,)], "v long").coalesce(1).write.mode("append").parquet(f"{folder}/in/day=20240105")
    for name in os.listdir(f"{folder}/in/day=20240104"):
        os.remove(f"{folder}/in/day=20240104/{name}")
    assert run() == ["20240102", "20240104", "20240105"]
    assert totals() == {"20240101": 11, "20240102": 500, "20240103": 13, "20240105": 7}
    after = state()
    kept = {k for k in before if k[0] in ("day=20240101", "day=20240103")}
    assert kept and all(after[k] == before[k] for k in kept)


def test_a_run_that_breaks_off_is_made_good(spark, tmp_path):
    folder = str(tmp_path)
    write_day(spark, folder, "20240101", [1])

    def broken(paths):
        raise RuntimeError("no more executors")

    with pytest.raises(RuntimeError):
        files.rebuild_by_day(spark, f"{folder}/in", f"{folder}/out", broken, r"day=(\d{8})")
    whole = lambda paths: spark.read.option("basePath", f"file://{folder}/in").schema("v long, day string").parquet(*paths)
    assert files.rebuild_by_day(spark, f"{folder}/in", f"{folder}/out", whole, r"day=(\d{8})") == ["20240101"]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.write_if_incomplete(spark.range(3), path, ["id"])
    bad = spark.range(5).select(F.assert_true(F.col("id") < 4).isNull().alias("x"))
    with pytest.raises(Exception, match="is not true"):
        files.write_if_incomplete(bad, path, ["x"])
    assert spark.read.parquet(path).count() == 3
    assert files.write_if_incomplete(spark.range(4), path, ["id"], 4).count() == 4


def test_landings_are_written_by_all_tasks(spark, tmp_path):
    """Each landing is as many files as tasks had rows, is drained before the next, and loses no row; rows without a time land too."""
    from leadtime.plans import files as plans

    sf_dir, folder = str(tmp_path / "sf"), str(tmp_path / "run")
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(hours=i), "ab"[i % 2], float(i)) for i in range(720)] + [(720, None, "a", 1.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, value double").repartition(4).write.parquet(f"{sf_dir}/events.parquet")
    plans.drained(spark, sf_dir, folder, lambda stream: resample.stream_file_audit(stream, "value"), "complete")
    assert sum(r.n_rows for r in plans.newest(spark, folder).collect()) == 721
    landed_files = spark.read.parquet(f"{folder}/in").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    assert len(landed_files) > 4 and all(r.hi - r.lo < dt.timedelta(hours=180) for r in landed_files)
    batches = {r.batch: r.n for r in spark.read.parquet(f"{folder}/out").groupBy("batch").agg(F.sum("n_rows").alias("n")).collect()}
    assert sorted(batches.values()) == [180, 360, 540, 721]
