"""Queries on cleaning, times, checks, alignment and event blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, physics, times
from ..operators import align, blocks, events, islands, order, reports, validate
from ..operators import windows as w
from ..operators.running import running
from ..sources.staging import staged
from . import standins as s

ALIASES = {"speed": ["l_extendedprice", "price"], "density": ["quantity"], "day": ["l_shipdate"]}
SPLITS = ["train", "validation", "test"]
#: Lag and length of the masks of the daily timeline.
MASKS = {f"mask_{lag}_{length}": (lag, length) for lag in (1, 2) for length in (2, 3)}
BLOCK = ["series", "block"]


# cleaning


def cells(spark, sf_dir) -> DataFrame:
    """D4: key, bal, nat as texts with sentinels, blanks and words put in."""
    c = s.table(spark, sf_dir, "customer")
    d = F.col("c_custkey") % 10
    bal = F.when(d == 0, "9999.99").when(d == 1, "99.9").when(d == 2, "399").when(d == 3, " ").when(d == 4, "abc").when(d == 5, "1e31").otherwise(F.col("c_acctbal").cast("string"))
    nat = F.when(d == 6, "999.0").when(d == 7, "-9.99").when(d == 8, "9999").otherwise(F.col("c_nationkey").cast("string"))
    return c.select(F.col("c_custkey").alias("key"), bal.alias("bal"), nat.alias("nat"))


def num_coerce(spark, sf_dir):
    return cells(spark, sf_dir).select("key", clean.number(F.col("bal")).alias("x"))


def sentinel_nines(spark, sf_dir):
    return cells(spark, sf_dir).select("key", clean.repeated_nines(F.col("bal")).alias("bal_nines"), clean.repeated_nines(F.col("nat")).alias("nat_nines"))


def sentinel_list(spark, sf_dir):
    c = s.table(spark, sf_dir, "customer")
    return c.select("c_custkey", clean.in_list(F.col("c_nationkey").cast("double"), [3, 7, 24.0000005]).alias("sentinel"))


def mask_invalid(spark, sf_dir):
    c = s.table(spark, sf_dir, "customer")
    return c.select("c_custkey", *clean.masked(F.col("c_acctbal"), F.abs("c_acctbal") <= 5000, "bal"))


def clean_features(spark, sf_dir):
    return clean.clean_columns(cells(spark, sf_dir), ["bal", "nat"])


def feature_missing_report(spark, sf_dir):
    return clean.missing_report(cells(spark, sf_dir), ["bal", "nat"]).withColumn("percent", F.round("percent", 6))


def missing_summary(spark, sf_dir):
    found = reports.missing_counts(s.daily(spark, sf_dir), ["f_sum_qty", "f_max_price", "f_avg_disc", "resp"], "k")
    return found.withColumn("ratio", F.round("ratio", 6))


def missing_ratio(spark, sf_dir):
    found = reports.missing_ratio(s.samples(spark, sf_dir), "value", s.hourly(spark, sf_dir), "x", ["series"])
    return found.withColumn("grid_ratio", F.round("grid_ratio", 6))


def standardize_columns(spark, sf_dir):
    li = s.table(spark, sf_dir, "lineitem")
    out = li.withColumnsRenamed(clean.standard_names(li.columns, ALIASES))
    return out.groupBy("l_returnflag").agg(F.max("speed").alias("speed"), F.sum("density").alias("density"))


def rename_prefix(spark, sf_dir):
    a = s.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"))
    b = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("amount"))
    return a.join(clean.prefixed(b, a.columns, "line_", ["o_orderkey"]), "o_orderkey")


def coupled(spark, sf_dir) -> DataFrame:
    li = s.table(spark, sf_dir, "lineitem")
    by, bz = F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5
    speed = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 100 - 50)
    rows = li.select("l_orderkey", "l_linenumber", by.alias("by"), F.round(bz, 3).alias("bz"), speed.alias("speed"))
    return rows.select("l_orderkey", "l_linenumber", "speed", *[c.alias(n) for n, c in physics.coupling(F.col("by"), F.col("bz"), F.col("speed")).items()])


def coupling_features(spark, sf_dir):
    out = coupled(spark, sf_dir).drop("speed")
    return out.groupBy("l_linenumber").agg(*[F.round(F.sum(c), 3).alias(f"sum_{c}") for c in ("b_transverse", "clock_angle", "bz_south", "borovsky")], F.round(F.avg("newell"), 4).alias("avg_newell"), F.count("newell").alias("n"))


def feature_transform(spark, sf_dir):
    rows = coupled(spark, sf_dir)
    turned = physics.cyclic(F.col("clock_angle"))
    out = rows.select("l_linenumber", physics.log_magnitude(F.col("speed")).alias("log_speed"), turned["sin"].alias("s"), turned["cos"].alias("c"))
    return out.groupBy("l_linenumber").agg(F.count("log_speed").alias("n"), F.round(F.sum("log_speed"), 3).alias("log_speed"), F.round(F.sum("s"), 3).alias("s"), F.round(F.sum("c"), 3).alias("c"))


# times


def ts_from_parts(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders")
    day = F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 4
    second = (F.col("o_custkey") % 120) / 2.0
    t = times.from_parts(F.year("o_orderdate"), F.month("o_orderdate"), day, F.col("o_orderkey") % 26, F.col("o_custkey") % 61, second)
    return o.select("o_orderkey", times.micros(t).alias("us"))


def ts_from_doy(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders")
    t = times.from_day_of_year(F.year("o_orderdate"), F.col("o_orderkey") % 400, F.col("o_custkey") * 1000003 % 90000000)
    return o.select("o_orderkey", times.micros(t).alias("us"))


def ts_iso_mixed(spark, sf_dir):
    e = s.table(spark, sf_dir, "events")
    d = F.col("event_id") % 3
    text = F.when(d == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(d == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("bad")
    parsed = e.select("event_id", times.micros(times.from_iso(text)).alias("us"))
    return parsed.groupBy((F.col("event_id") % 3).alias("form")).agg(F.count("*").alias("n"), F.count_if(F.col("us").isNull()).alias("rejected"), F.min("us").alias("first"), F.sum(F.col("us") % 1000003).alias("digest"))


def file_date(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders")
    name = F.concat(F.lit("data_"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise(""), F.lit(".dat"))
    return o.select("o_orderkey", F.datediff(times.date_in_name(name), F.lit(s.FIRST_DAY)).alias("k"))


def time_slice(spark, sf_dir):
    o = s.table(spark, sf_dir, "orders")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-03-01"))
    return o.where((F.col("o_orderdate") >= a) & (F.col("o_orderdate") < b)).select("o_orderkey", "o_totalprice")


# checks


def time_axis_report(spark, sf_dir):
    return validate.axis_report(s.samples(spark, sf_dir), ["series"], "h", 0, s.HOURS - 1, F.col("event_id"), chunk=1_000)


def axes_aligned(spark, sf_dir):
    a = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"))
    return validate.axes_aligned(a, s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), ["c"])


def require_columns(spark, sf_dir):
    return validate.require_columns(s.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def align_to_step(spark, sf_dir):
    """Per series: hours, those that hold more than one sample, distinct offsets within the hour."""
    ev = s.table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), times.micros(F.col("ts")).alias("us"))
    return align.alignment_report(align.floor_to_step(ev, "us", 3_600_000_000), ["series"])


def file_audit(spark, sf_dir):
    """Per day of orders as one file: rows, valid rows, first and last key, duplicates of customer."""
    o = s.table(spark, sf_dir, "orders")
    return o.groupBy(F.datediff("o_orderdate", F.lit(s.FIRST_DAY)).alias("k")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice") <= 400000).alias("n_valid"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"),
        (F.count("*") - F.countDistinct("o_custkey")).alias("n_repeated"),
    )


def daily_coverage(spark, sf_dir):
    expected = spark.range(s.DAYS).withColumnRenamed("id", "k")
    audit = file_audit(spark, sf_dir).select(F.col("k").cast("bigint").alias("k"), "n_rows", "n_valid")
    return align.coverage(expected, audit, ["k"], F.col("n_valid") == F.col("n_rows"))


# joins


def join_aligned(spark, sf_dir):
    resp = s.table(spark, sf_dir, "orders").groupBy(F.datediff("o_orderdate", F.lit(s.FIRST_DAY)).cast("bigint").alias("k")).agg(F.max("o_totalprice").alias("resp"))
    return s.drivers(spark, sf_dir).join(resp, "k")


def join_horizontal(spark, sf_dir):
    resp = s.table(spark, sf_dir, "orders").groupBy(F.datediff("o_orderdate", F.lit(s.FIRST_DAY)).cast("bigint").alias("k")).agg(F.max("o_totalprice").alias("resp"))
    return s.drivers(spark, sf_dir).join(resp, "k", "full_outer")


def join_window_stats(spark, sf_dir):
    from .series import rolling_stats

    stats = rolling_stats(spark, sf_dir).select("series", "h", "mean_3", "max_6").where("mean_3 is not null")
    return s.hourly(spark, sf_dir).join(stats, ["series", "h"], "left")


def resample_check(spark, sf_dir):
    """Each hour's value made again from the samples, and compared."""
    return reports.resampling_check(s.hourly(spark, sf_dir), s.samples(spark, sf_dir), ["series", "h"], "x", "value", F.col("event_id"))


def segmented(spark, sf_dir) -> DataFrame:
    """D6: series, us (microseconds from START), segment, reach (the longest step inside segments)."""
    ev = s.table(spark, sf_dir, "events")
    start = F.lit(s.START).cast("timestamp_ntz")
    obs = ev.where((F.col("ts") >= start) & (F.col("ts") < F.lit(s.END).cast("timestamp_ntz"))).select(F.col("event_type").alias("series"), (times.micros(F.col("ts")) - times.micros(start)).alias("us")).distinct()
    obs = staged(obs, "observations")
    before = running(obs, ["series"], ["us"], F.floor(F.col("us") / 86_400_000_000), maxima={"before": F.col("us")}, before=True)
    q = order.quantiles(before.withColumn("step", F.col("us") - F.col("before")), ["series"], "step", [0.5, 0.9])
    limit = staged(q.groupBy("series").agg(F.max(F.col("quantile") * F.when(F.col("place") == 0, 1.5).otherwise(1.05)).alias("reach")), "reach")
    return islands.gap_segments(obs.join(limit, "series"), ["series"], "us", F.col("reach"), chunk=86_400_000_000)


def gap_segments(spark, sf_dir):
    return segmented(spark, sf_dir).groupBy("series", "segment").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


def nearest(spark, sf_dir) -> DataFrame:
    return align.nearest_in_segments(segmented(spark, sf_dir), ["series"], "us", "segment", 3_600_000_000, "reach")


def asof_nearest_segmented(spark, sf_dir):
    return nearest(spark, sf_dir).select("series", (F.col("target") / 3_600_000_000).cast("bigint").alias("h"), "us", "offset")


def asof_report(spark, sf_dir):
    found = staged(nearest(spark, sf_dir), "nearest")
    counts = found.groupBy("series").agg(F.countDistinct("segment").alias("n_segments"), F.count("*").alias("n_mapped"), F.max("offset").alias("max_offset"))
    return counts.join(order.median(found, ["series"], "offset", "median_offset"), "series").withColumn("median_offset", F.round("median_offset", 3))


# events and blocks


def event_catalog(spark, sf_dir):
    """Text cells of a catalogue, parsed: number, time, size, class, status."""
    o = s.table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd.MM.yyyy")
    text = o.select(
        F.concat((k % 1000).cast("string"), F.when(k % 5 == 0, "*").when(k % 7 == 0, "x").otherwise("")).alias("number"), day.alias("date"),
        F.concat((k % 25).cast("string"), F.when(k % 2 == 0, ".").otherwise(" : "), F.lpad((k % 60).cast("string"), 2, "0")).alias("time_ut"),
        F.regexp_replace(F.format_string("%.2f", -F.col("o_totalprice")), r"\.", ",").alias("peak"),
        F.element_at(F.array(*[F.lit(x) for x in ("CME", "CIR", "CME+CIR", "SC CME", "HSS")]), (k % 5 + 1).cast("int")).alias("storm"), k.alias("key"),
    )
    found = events.parse_catalog(text, "number", "date", "time_ut", "peak", "storm", ["key"])
    return found.select("key", "event_id", times.micros(F.col("peak_time")).alias("peak_us"), "peak_abs", "driver", "status")


def event_window_join(spark, sf_dir):
    rows = s.daily(spark, sf_dir).select("k", "resp", "f_n")
    pairs = align.steps_in_intervals(rows, "k", s.events(spark, sf_dir), "start", "end", 30)
    return pairs.groupBy("event_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("resp").isNull()).alias("n_missing"), F.max("resp").alias("max_resp"), F.first("driver").alias("driver"))


def event_availability(spark, sf_dir):
    """Per event: its worst feature by the longest run of missing days in the window, and whether that excludes it."""
    return events.availability(s.daily(spark, sf_dir), "k", ["f_sum_qty", "f_avg_disc", "resp"], s.events(spark, sf_dir), 2, 30)


def merge_intervals(spark, sf_dir):
    return islands.merge_intervals(s.events(spark, sf_dir), ["series"], "start", "end", "event_id", chunk=500).select("series", "event_id", "block")


def event_groups(spark, sf_dir):
    return blocks.event_blocks(s.events(spark, sf_dir), ["series"])


def placed(spark, sf_dir) -> DataFrame:
    return blocks.split_blocks(event_groups(spark, sf_dir), order=["start", "series"], chunk=50)


def split_assign(spark, sf_dir):
    return placed(spark, sf_dir).select(*BLOCK, "n_events", "split")


def event_timeline(spark, sf_dir):
    """Days of blocks with their split, and a mask for each lag and length that needs its input and target inside the block."""
    valid, target = F.col("resp").isNotNull() & F.col("f_n").isNotNull(), F.col("ahead").isNotNull()
    rows = w.chunked(s.daily(spark, sf_dir).select("k", "resp", "f_n"), [], "k", 0, 1, lambda o: {"ahead": w.future_peak(F.col("resp"), o, 1)}, chunk_steps=500)
    rows = w.chunked(rows, [], "k", 4, 0, lambda o: {name: w.window_mask(valid, target, o, *of) for name, of in MASKS.items()}, chunk_steps=500)
    made = events.event_timeline(rows, "k", placed(spark, sf_dir), MASKS, 1, 30)
    return made.select(*BLOCK, "split", "k", *MASKS)


def event_ids_per_row(spark, sf_dir):
    pairs = align.steps_in_intervals(s.daily(spark, sf_dir).select("k"), "k", s.events(spark, sf_dir), "start", "end", 30)
    ids = F.array_sort(F.collect_list(F.struct("peak", "event_id")))
    return pairs.groupBy("series", "k").agg(F.array_join(F.transform(ids, lambda x: x["event_id"].cast("string")), ",").alias("event_ids"))


def split_summary(spark, sf_dir):
    return events.split_manifest(placed(spark, sf_dir), event_timeline(spark, sf_dir), SPLITS, list(MASKS), "k")


def split_integrity(spark, sf_dir):
    torn = event_timeline(spark, sf_dir).withColumn("place", F.concat_ws(".", *BLOCK))
    return validate.split_integrity(torn, "place", "split", SPLITS)


def block_coverage(spark, sf_dir):
    """Blocks by whether they have days at all."""
    found = validate.covered(event_groups(spark, sf_dir), event_timeline(spark, sf_dir), BLOCK)
    return found.groupBy("ok").agg(F.count("*").alias("n_blocks"), F.sum("n_rows").alias("n_rows"))


def dataset_metadata(spark, sf_dir):
    """One row of what the dataset holds."""
    return events.dataset_metadata(s.events(spark, sf_dir), placed(spark, sf_dir), event_timeline(spark, sf_dir), list(MASKS))


def event_onset(spark, sf_dir):
    """Per event and threshold: the first day of the run of days above it that is nearest to the peak, in the window."""
    found = events.event_onsets(s.daily(spark, sf_dir), "k", "resp", s.events(spark, sf_dir), [300000, 400000], 30)
    return found.select("event_id", "threshold", "onset")


def event_day_summary(spark, sf_dir):
    """Per series and day: the samples, the hours made of them, and whether these agree."""
    day = F.floor(F.col("h") / 24).alias("day")
    raw = s.samples(spark, sf_dir).select("series", day, F.col("value").alias("x"), "event_id")
    return events.event_day_summary(raw, resample_check(spark, sf_dir).select("series", day, "x", "matches"), ["series", "day"], "x", "event_id")


def forward_folds(spark, sf_dir):
    """Folds of the blocks that are not for the test."""
    return blocks.forward_folds(placed(spark, sf_dir).where("split <> 'test'"), order=["start", "series"], keys=["series"], chunk=50)


def fold_definitions(spark, sf_dir):
    parts = forward_folds(spark, sf_dir).join(event_groups(spark, sf_dir), BLOCK)
    return parts.groupBy("fold", "role").agg(F.count("*").alias("n_blocks"), F.sum("n_events").alias("n_events"), F.min("start").alias("first_k"), F.max("end").alias("last_k"))


def fold_rows(spark, sf_dir):
    rows = event_timeline(spark, sf_dir)
    return rows.join(forward_folds(spark, sf_dir), BLOCK).groupBy("fold", "role").agg(F.count("*").alias("n_rows"), F.sum("mask_1_3").alias("n_valid"))


def fold_integrity(spark, sf_dir):
    rows = event_timeline(spark, sf_dir).join(forward_folds(spark, sf_dir).where("role = 'validation'"), BLOCK)
    return validate.fold_integrity(rows, [*BLOCK, "k"], "fold", "mask_1_3")


QUERIES = {
    f.__name__: f
    for f in (
        num_coerce, sentinel_nines, sentinel_list, mask_invalid, clean_features, feature_missing_report, missing_summary, missing_ratio, standardize_columns, rename_prefix,
        coupling_features, feature_transform, ts_from_parts, ts_from_doy, ts_iso_mixed, file_date, time_slice, time_axis_report, axes_aligned, require_columns, align_to_step,
        file_audit, daily_coverage, join_aligned, join_horizontal, join_window_stats, resample_check, gap_segments, asof_nearest_segmented, asof_report, event_catalog,
        event_window_join, event_availability, merge_intervals, event_groups, split_assign, event_timeline, event_ids_per_row, split_summary, split_integrity, dataset_metadata, event_onset,
        block_coverage, event_day_summary,        forward_folds, fold_definitions, fold_rows, fold_integrity,
    )
}

_NUM = r"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
_NINE = r"coalesce(regexp_full_match(trim({c}), '[+-]?9+(\.9+)?(e[+-]?\d+)?') AND len(regexp_replace(regexp_replace(trim({c}), 'e.*$', ''), '[^9]', '', 'g')) >= CASE WHEN contains(regexp_replace(trim({c}), 'e.*$', ''), '.') THEN 3 ELSE 4 END, false)"
_CELLS = """d4 AS (SELECT c_custkey AS key,
  CASE c_custkey % 10 WHEN 0 THEN '9999.99' WHEN 1 THEN '99.9' WHEN 2 THEN '399' WHEN 3 THEN ' ' WHEN 4 THEN 'abc' WHEN 5 THEN '1e31' ELSE CAST(c_acctbal AS VARCHAR) END AS bal,
  CASE c_custkey % 10 WHEN 6 THEN '999.0' WHEN 7 THEN '-9.99' WHEN 8 THEN '9999' ELSE CAST(c_nationkey AS VARCHAR) END AS nat FROM customer)"""
_WHY = "CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'blank' WHEN " + _NINE + " THEN 'nines' WHEN " + _NUM + " IS NULL THEN 'text' WHEN abs(" + _NUM + ") >= 1e30 THEN 'fill' END"


def _of(template: str, c: str) -> str:
    return template.replace("{c}", c)


_COUPLED = """cp AS (SELECT l_linenumber, v, sqrt(y * y + z * z) AS bt, CASE WHEN atan2(y, z) < 0 THEN atan2(y, z) + 2 * pi() ELSE atan2(y, z) END AS cl, greatest(-z, 0.0) AS so FROM
  (SELECT l_linenumber, l_quantity - 25 AS y, round(l_discount * 100 - 5, 3) AS z, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 100 - 50 END AS v FROM lineitem))"""
_OBS = f"""ob AS (SELECT DISTINCT event_type AS series, epoch_us(ts) - epoch_us(TIMESTAMP '{s.START}') AS us FROM events WHERE ts >= TIMESTAMP '{s.START}' AND ts < TIMESTAMP '{s.END}'),
st AS (SELECT *, us - lag(us) OVER (PARTITION BY series ORDER BY us) AS step FROM ob),
li2 AS (SELECT series, greatest(quantile_cont(step, 0.5) * 1.5, quantile_cont(step, 0.9) * 1.05) AS reach FROM st GROUP BY series),
sg AS (SELECT st.series, us, CAST(sum(CASE WHEN step > reach THEN 1 ELSE 0 END) OVER (PARTITION BY st.series ORDER BY us) AS BIGINT) AS segment FROM st JOIN li2 ON st.series = li2.series)"""
_NEAR = _OBS + """, sp AS (SELECT series, segment, min(us) // 3600000000 AS a, max(us) // 3600000000 AS b FROM sg GROUP BY ALL),
tg AS (SELECT series, segment, unnest(range(a, b + 1)) AS h FROM sp),
nn AS (SELECT tg.series, h, us, abs(us - h * 3600000000) AS "offset", tg.segment, row_number() OVER (PARTITION BY tg.series, h ORDER BY abs(us - h * 3600000000), us) AS r
  FROM tg JOIN sg ON sg.series = tg.series AND sg.segment = tg.segment)"""
_BLOCKS = s.EVENTS + """, mi AS (SELECT *, CAST(sum(CASE WHEN "start" < reach THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY "start", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM
  (SELECT *, max("end") OVER (PARTITION BY series ORDER BY "start", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d3)),
bl AS (SELECT series, block, min("start") AS "start", max("end") AS "end", count(*) AS n_events, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY peak, event_id) AS event_ids FROM mi GROUP BY series, block)"""
_SPLIT = _BLOCKS + """, ci AS (SELECT *, row_number() OVER (ORDER BY "start", series) - 1 AS i, sum(n_events) OVER (ORDER BY "start", series) AS cum, sum(n_events) OVER () AS total, count(*) OVER () AS n FROM bl),
t1 AS (SELECT i AS ti, cum AS tc FROM ci WHERE i <= n - 3 ORDER BY abs(cum - 0.7::DOUBLE * total), i LIMIT 1),
t2 AS (SELECT i AS vi FROM ci, t1 WHERE i > ti AND i <= n - 2 ORDER BY abs(cum - (tc + 0.15::DOUBLE * total)), i LIMIT 1),
sb AS (SELECT ci.*, CASE WHEN i <= ti THEN 'train' WHEN i <= vi THEN 'validation' ELSE 'test' END AS split FROM ci, t1, t2)"""
_FRAMES = ", ".join(f"CASE WHEN lead(resp) OVER (ORDER BY k) IS NOT NULL AND count(*) FILTER (resp IS NOT NULL AND f_n IS NOT NULL) OVER (ORDER BY k ROWS BETWEEN {a + n - 1} PRECEDING AND {a} PRECEDING) = {n} THEN 1 ELSE 0 END AS {m}" for m, (a, n) in MASKS.items())
_INSIDE = ", ".join(f"""CASE WHEN {m} = 1 AND k - {a + n - 1} >= "start" AND k + 1 < "end" THEN 1 ELSE 0 END AS {m}""" for m, (a, n) in MASKS.items())
_LINE = s.DAILY + ", " + _SPLIT + f""", fm AS (SELECT k, {_FRAMES} FROM d2), tl AS (SELECT series, block, split, k, {_INSIDE} FROM fm JOIN sb ON k >= "start" AND k < "end")"""
_VALID = ", ".join(f"CAST(sum({m}) AS BIGINT) AS valid_{m}" for m in MASKS)
_FOLDS = """, fi AS (SELECT series, block, row_number() OVER (ORDER BY "start", series) - 1 AS i, count(*) OVER () AS n FROM sb WHERE split <> 'test'),
fh AS (SELECT *, least(greatest(CAST(ceil(n * 0.4::DOUBLE) AS INT), 1), n - 3) AS head FROM fi),
fr AS (SELECT series, block, CASE WHEN i < head THEN 0 WHEN i - head < ((n - head) % 3) * ((n - head) // 3 + 1) THEN (i - head) // ((n - head) // 3 + 1) + 1
  ELSE (n - head) % 3 + (i - head - ((n - head) % 3) * ((n - head) // 3 + 1)) // greatest((n - head) // 3, 1) + 1 END AS run FROM fh),
ff AS (SELECT fold, series, block, CASE WHEN run = fold THEN 'validation' ELSE 'train' END AS role FROM fr, (SELECT unnest([1, 2, 3]) AS fold) WHERE run <= fold)"""
_DAY = f"CAST(date_diff('day', DATE '{s.FIRST_DAY}', CAST(o_orderdate AS DATE)) AS BIGINT)"
_AUDIT = f"""au AS (SELECT {_DAY} AS k, count(*) AS n_rows, count(*) FILTER (o_totalprice <= 400000) AS n_valid, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
  count(*) - count(DISTINCT o_custkey) AS n_repeated FROM orders GROUP BY 1)"""

ORACLE = {
    "num_coerce": f"WITH {_CELLS} SELECT key, {_of(_NUM, 'bal')} AS x FROM d4",
    "sentinel_nines": f"WITH {_CELLS} SELECT key, {_of(_NINE, 'bal')} AS bal_nines, {_of(_NINE, 'nat')} AS nat_nines FROM d4",
    "sentinel_list": "SELECT c_custkey, c_nationkey IN (3, 7, 24) AS sentinel FROM customer",
    "mask_invalid": "SELECT c_custkey, CASE WHEN abs(c_acctbal) <= 5000 THEN c_acctbal END AS bal, CAST(abs(c_acctbal) > 5000 AS INT) AS bal_missing_flag FROM customer",
    "clean_features": f"WITH {_CELLS} SELECT key, " + ", ".join(f"CASE WHEN {_of(_WHY, c)} IS NULL THEN {_of(_NUM, c)} END AS {c}, CAST({_of(_WHY, c)} IS NOT NULL AS INT) AS {c}_missing_flag" for c in ("bal", "nat")) + " FROM d4",
    "feature_missing_report": f"WITH {_CELLS}, w AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_of(_WHY, c)} AS why FROM d4" for c in ("bal", "nat"))
    + ") SELECT feature, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (why = '{x}') AS {x}" for x in ("blank", "nines", "fill", "text")) + ", count(why) AS missing, round(100.0::DOUBLE * count(why) / count(*), 6) AS percent FROM w GROUP BY feature",
    "missing_summary": f"WITH {s.DAILY}, u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, k, {f} IS NULL AS m FROM d2" for f in ("f_sum_qty", "f_max_price", "f_avg_disc", "resp"))
    + ") SELECT feature, count(*) FILTER (m) AS missing, round(avg(CAST(m AS INT)), 6) AS ratio, min(k) FILTER (m) AS first_missing FROM u GROUP BY feature",
    "missing_ratio": f"""WITH {s.HOURLY} SELECT series, n_raw, raw_missing, n_grid, grid_missing, round(grid_missing / n_grid, 6) AS grid_ratio
FROM (SELECT series, count(*) AS n_raw, count(*) FILTER (value IS NULL) AS raw_missing FROM ev GROUP BY 1) JOIN (SELECT series, count(*) AS n_grid, count(*) FILTER (x IS NULL) AS grid_missing FROM d1 GROUP BY 1) USING (series)""",
    "standardize_columns": "SELECT l_returnflag, max(l_extendedprice) AS speed, sum(l_quantity) AS density FROM lineitem GROUP BY 1",
    "rename_prefix": "SELECT o_orderkey, o_totalprice AS amount, n AS line_amount FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "coupling_features": f"""WITH {_COUPLED} SELECT l_linenumber, round(sum(bt), 3) AS sum_b_transverse, round(sum(cl), 3) AS sum_clock_angle, round(sum(so), 3) AS sum_bz_south,
  round(sum(CASE WHEN v > 0 THEN v * bt * sin(cl / 2) * sin(cl / 2) * 1e-3 END), 3) AS sum_borovsky, round(avg(CASE WHEN v > 0 THEN pow(v, 4.0::DOUBLE / 3) * pow(bt, 2.0::DOUBLE / 3) * pow(abs(sin(cl / 2)), 8.0::DOUBLE / 3) END), 4) AS avg_newell, count(*) FILTER (v > 0) AS n FROM cp GROUP BY 1""",
    "feature_transform": f"WITH {_COUPLED} SELECT l_linenumber, count(*) FILTER (v >= 0) AS n, round(sum(CASE WHEN v >= 0 THEN ln(1 + v) END), 3) AS log_speed, round(sum(sin(cl)), 3) AS s, round(sum(cos(cl)), 3) AS c FROM cp GROUP BY 1",
    "ts_from_parts": r"""SELECT o_orderkey, CASE WHEN o_orderkey % 26 < 24 AND o_custkey % 61 < 60 THEN epoch_us(CAST(TRY_CAST(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate) + o_orderkey % 4) AS DATE) AS TIMESTAMP))
  + (o_orderkey % 26) * 3600000000 + (o_custkey % 61) * 60000000 + (o_custkey % 120) * 500000 END AS us FROM orders""",
    "ts_from_doy": """SELECT o_orderkey, CASE WHEN o_orderkey % 400 BETWEEN 1 AND 366 AND (o_custkey * 1000003) % 90000000 <= 86399999 THEN epoch_us(CAST(make_date(CAST(year(o_orderdate) AS INT), 1, 1) AS TIMESTAMP))
  + (o_orderkey % 400 - 1) * 86400000000 + ((o_custkey * 1000003) % 90000000) * 1000 END AS us FROM orders""",
    "ts_iso_mixed": """SELECT event_id % 3 AS form, count(*) AS n, count(*) FILTER (us IS NULL) AS rejected, min(us) AS first, CAST(sum(us % 1000003) AS BIGINT) AS digest FROM
  (SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('millisecond', ts)) END AS us FROM events) GROUP BY 1""",
    "file_date": f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN {_DAY} END AS k FROM orders",
    "time_slice": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'",
    "time_axis_report": f"""WITH {s.SAMPLES}, c AS (SELECT series, h, count(*) AS n FROM ev GROUP BY ALL),
m AS (SELECT series, count(*) FILTER (back) = 0 AS monotone FROM (SELECT series, h < lag(h) OVER (PARTITION BY series ORDER BY event_id) AS back FROM ev) GROUP BY 1),
g AS (SELECT k.series, k.h FROM (SELECT series, unnest(range({s.HOURS})) AS h FROM (SELECT DISTINCT series FROM ev)) k ANTI JOIN c ON c.series = k.series AND c.h = k.h),
a AS (SELECT series, count(*) AS n_missing, min(h) AS first_missing FROM g GROUP BY 1)
SELECT c.series, CAST(sum(n) AS BIGINT) AS n_rows, {s.HOURS} AS n_expected, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_duplicate, coalesce(any_value(n_missing), 0) AS n_missing, any_value(first_missing) AS first_missing,
  0 AS n_extra, CAST(NULL AS BIGINT) AS first_extra, any_value(monotone) AS monotone, coalesce(any_value(n_missing), 0) = 0 AND max(n) = 1 AS exact
FROM c LEFT JOIN a ON a.series = c.series JOIN m ON m.series = c.series GROUP BY c.series""",
    "axes_aligned": """WITH a AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS c, count(*) AS n FROM customer GROUP BY 1)
SELECT (SELECT count(*) FROM a ANTI JOIN b USING (c)) AS only_a, (SELECT count(*) FROM a WHERE n > 1) AS repeated_a, (SELECT count(*) FROM b ANTI JOIN a USING (c)) AS only_b, (SELECT count(*) FROM b WHERE n > 1) AS repeated_b, false AS aligned""",
    "require_columns": "SELECT l_orderkey, l_linenumber FROM lineitem",
    "align_to_step": """SELECT series, n_steps, n_collisions, n_offsets, least_offset, n_collisions = 0 AS ok FROM (SELECT series, count(*) AS n_steps, count(*) FILTER (n > 1) AS n_collisions FROM (SELECT event_type AS series, date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)
JOIN (SELECT event_type AS series, count(DISTINCT epoch_us(ts) % 3600000000) AS n_offsets, min(epoch_us(ts) % 3600000000) AS least_offset FROM events GROUP BY 1) USING (series)""",
    "file_audit": f"WITH {_AUDIT} SELECT * FROM au",
    "daily_coverage": f"WITH {_AUDIT} SELECT g.k, n_rows, n_valid, n_rows IS NOT NULL AS found, coalesce(n_valid = n_rows, false) AS passes FROM (SELECT CAST(unnest(range({s.DAYS})) AS BIGINT) AS k) g LEFT JOIN au ON au.k = g.k",
    "join_aligned": f"WITH {s.DAILY} SELECT li.*, resp FROM li JOIN rs USING (k)",
    "join_horizontal": f"WITH {s.DAILY} SELECT coalesce(li.k, rs.k) AS k, f_sum_qty, f_max_price, f_avg_disc, f_n, resp FROM li FULL JOIN rs ON li.k = rs.k",
    "join_window_stats": f"""WITH {s.HOURLY}, r AS (SELECT *, CASE WHEN count(x) OVER a = 3 THEN round(avg(x) OVER a, 6) END AS mean_3, CASE WHEN count(x) OVER b = 6 THEN max(x) OVER b END AS max_6 FROM d1
WINDOW a AS (PARTITION BY series ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT series, h, x, mean_3, CASE WHEN mean_3 IS NOT NULL THEN max_6 END AS max_6 FROM r""",
    "resample_check": f"WITH {s.HOURLY} SELECT d1.series, d1.h, d1.x, coalesce(n, 0) AS n_samples, true AS matches FROM d1 LEFT JOIN (SELECT series, h, count(*) AS n FROM ev GROUP BY ALL) c ON c.series = d1.series AND c.h = d1.h",
    "gap_segments": f"WITH {_OBS} SELECT series, segment, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM sg GROUP BY ALL",
    "asof_nearest_segmented": f'WITH {_NEAR} SELECT series, h, us, "offset" FROM nn WHERE r = 1',
    "asof_report": f'WITH {_NEAR} SELECT series, count(DISTINCT segment) AS n_segments, count(*) AS n_mapped, max("offset") AS max_offset, round(median("offset"), 3) AS median_offset FROM nn WHERE r = 1 GROUP BY 1',
    "event_catalog": """WITH t AS (SELECT o_orderkey AS key, CAST(o_orderkey % 1000 AS INT) AS event_id,
  CASE WHEN o_orderkey % 25 < 24 THEN epoch_us(o_orderdate) + (o_orderkey % 25) * 3600000000 + (o_orderkey % 60) * 60000000 END AS peak_us, abs(o_totalprice) AS peak_abs,
  CASE o_orderkey % 5 WHEN 0 THEN 'CME' WHEN 1 THEN 'CIR' WHEN 2 THEN 'CIR' END AS driver FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 <> 0)
SELECT *, CASE WHEN event_id IN (18, 19) THEN 'excluded_engineering' WHEN driver IS NULL THEN 'excluded_driver' WHEN peak_us IS NULL THEN 'excluded_time' ELSE 'selected' END AS status FROM t""",
    "event_window_join": f'WITH {s.DAILY}, {s.EVENTS} SELECT event_id, count(*) AS n_rows, count(*) FILTER (resp IS NULL) AS n_missing, max(resp) AS max_resp, any_value(driver) AS driver FROM d2 JOIN d3 ON k >= "start" AND k < "end" GROUP BY event_id',
    "event_availability": f"""WITH {s.DAILY}, {s.EVENTS}, u AS (""" + " UNION ALL ".join(f"""SELECT event_id, '{f}' AS feature, k, {f} IS NULL AS missing FROM d2 JOIN d3 ON k >= "start" AND k < "end\"""" for f in ("f_sum_qty", "f_avg_disc", "resp"))
    + """), r AS (SELECT event_id, feature, max(n) AS longest FROM (SELECT event_id, feature, count(*) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY event_id, feature ORDER BY k) AS g FROM u WHERE missing) GROUP BY event_id, feature, g) GROUP BY ALL),
a AS (SELECT event_id, feature, coalesce(longest, 0) AS longest FROM d3 CROSS JOIN (SELECT unnest(['f_sum_qty', 'f_avg_disc', 'resp']) AS feature) LEFT JOIN r USING (event_id, feature))
SELECT event_id, max(longest) AS longest, arg_max(feature, (longest, feature)) AS worst, max(longest) >= 2 AS excluded FROM a GROUP BY event_id""",
    "dataset_metadata": f"""WITH {_LINE}, vm AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS key, sum({m}) AS value FROM tl" for m in MASKS) + """), j AS (
SELECT 'drivers' AS part, coalesce(driver, 'none') AS key, count(*) AS value FROM d3 GROUP BY 2 UNION ALL SELECT 'split_events', split, sum(n_events) FROM sb GROUP BY 2
UNION ALL SELECT 'split_blocks', split, count(*) FROM sb GROUP BY 2 UNION ALL SELECT 'valid_steps', key, value FROM vm),
t AS (SELECT part, '{' || string_agg('"' || key || '":' || CAST(value AS BIGINT), ',' ORDER BY key) || '}' AS text FROM j GROUP BY part)
SELECT (SELECT count(*) FROM d3) AS n_events, (SELECT count(*) FROM bl) AS n_blocks, (SELECT count(*) FROM tl) AS n_steps, """ + ", ".join(f"max(text) FILTER (part = '{x}') AS {x}" for x in ("drivers", "split_events", "split_blocks", "valid_steps")) + " FROM t",
    "merge_intervals": f"WITH {_BLOCKS} SELECT series, event_id, block FROM mi",
    "event_groups": f"WITH {_BLOCKS} SELECT * FROM bl",
    "split_assign": f"WITH {_SPLIT} SELECT series, block, n_events, split FROM sb",
    "event_timeline": f"WITH {_LINE} SELECT * FROM tl",
    "event_ids_per_row": f"""WITH {s.EVENTS} SELECT series, k, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY peak, event_id) AS event_ids FROM (SELECT CAST(unnest(range({s.DAYS})) AS BIGINT) AS k) JOIN d3 ON k >= "start" AND k < "end" GROUP BY series, k""",
    "split_summary": f"""WITH {_LINE} SELECT split, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_events, 0) AS n_events, coalesce(n_steps, 0) AS n_steps, first_step, last_step, """ + ", ".join(f"coalesce(valid_{m}, 0) AS valid_{m}" for m in MASKS) + f""" FROM (SELECT unnest(['train', 'validation', 'test']) AS split)
LEFT JOIN (SELECT split, count(*) AS n_blocks, CAST(sum(n_events) AS BIGINT) AS n_events FROM sb GROUP BY 1) USING (split)
LEFT JOIN (SELECT split, count(*) AS n_steps, min(k) AS first_step, max(k) AS last_step, {_VALID} FROM tl GROUP BY 1) USING (split)""",
    "block_coverage": f"""WITH {_LINE}, c AS (SELECT bl.series, bl.block, count(k) AS n FROM bl LEFT JOIN tl ON tl.series = bl.series AND tl.block = bl.block GROUP BY ALL)
SELECT n > 0 AS ok, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY 1""",
    "event_day_summary": f"""WITH {s.HOURLY}, a AS (SELECT series, h // 24 AS day, count(*) AS raw_rows, count(value) AS raw_valid, min(event_id) AS raw_first, max(event_id) AS raw_last FROM ev GROUP BY ALL),
b AS (SELECT series, h // 24 AS day, count(*) AS steps, count(x) AS steps_valid, count(*) FILTER (x IS NULL) AS steps_missing, count(*) AS steps_matching, 0 AS steps_not_matching FROM d1 GROUP BY ALL)
SELECT b.*, coalesce(raw_rows, 0) AS raw_rows, coalesce(raw_valid, 0) AS raw_valid, raw_first, raw_last FROM b LEFT JOIN a ON a.series = b.series AND a.day = b.day""",
    "split_integrity": f"WITH {_LINE} SELECT count(*) FILTER (split IS NULL OR block IS NULL) AS n_null, 0 AS n_unknown, 0 AS n_torn_groups FROM tl",
    "event_onset": f"""WITH {s.DAILY}, {s.EVENTS}, hi AS (SELECT event_id, threshold, peak, k, k - row_number() OVER (PARTITION BY event_id, threshold ORDER BY k) AS run FROM d2 JOIN d3 ON k >= "start" AND k < "end", (SELECT unnest([300000, 400000]) AS threshold) WHERE resp >= threshold),
rs2 AS (SELECT *, min(k) OVER (PARTITION BY event_id, threshold, run) AS a FROM hi)
SELECT event_id, threshold, arg_min(a, abs(k - peak) * 100000 + k) AS onset FROM rs2 GROUP BY ALL""",
    "forward_folds": f"WITH {_SPLIT}{_FOLDS} SELECT fold, series, block, role FROM ff",
    "fold_definitions": f"""WITH {_SPLIT}{_FOLDS} SELECT fold, role, count(*) AS n_blocks, CAST(sum(n_events) AS BIGINT) AS n_events, min("start") AS first_k, max("end") AS last_k FROM ff JOIN bl USING (series, block) GROUP BY ALL""",
    "fold_rows": f"WITH {_LINE}{_FOLDS} SELECT fold, role, count(*) AS n_rows, CAST(sum(mask_1_3) AS BIGINT) AS n_valid FROM tl JOIN ff USING (series, block) GROUP BY ALL",
    "fold_integrity": f"WITH {_LINE}{_FOLDS} SELECT count(*) AS n_samples, 0 AS n_shared, 0 AS n_contradicted FROM tl JOIN ff USING (series, block) WHERE role = 'validation'",
}
