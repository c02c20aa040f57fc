"""Frames that stand in for the native inputs, built from the driver tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import spine
from ..operators.windows import chunked, exceedance, full, future_peak

HOURS, DAYS, HORIZON = 720, 2500, 3
THRESHOLDS = (50, 100, 150, 200)
LARGE, SHOCK = 400_000, 200
START, END, FIRST_DAY = "2024-01-01", "2024-01-31", "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, h (hour from START), value, event_id."""
    ev = table(spark, sf_dir, "events")
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (START, END))
    inside = ev.where((F.col("ts") >= first) & (F.col("ts") < last))
    return inside.select(F.col("event_type").alias("series"), F.floor((times.micros(F.col("ts")) - times.micros(first)) / 3_600_000_000).alias("h"), "value", "event_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: series, h, x on the complete grid."""
    ev = samples(spark, sf_dir)
    top = spine.resample_argmax(ev, ["series", "h"], "value", -F.col("event_id")).withColumnRenamed("value", "x")
    return spine.reindex(top, spine.step_spine(ev, ["series"], "h", 0, HOURS - 1), ["series", "h"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2: k (day from FIRST_DAY), f_sum_qty, f_max_price, f_avg_disc, f_n, resp on the complete grid of one series."""
    day = lambda c: F.datediff(F.col(c), F.lit(FIRST_DAY)).cast("bigint")
    li = drivers(spark, sf_dir)
    resp = table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("k")).agg(F.max("o_totalprice").alias("resp"))
    grid = spark.range(DAYS).withColumnRenamed("id", "k")
    return grid.join(li, "k", "left").join(resp, "k", "left")


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate"), F.lit(FIRST_DAY)).cast("bigint")
    aggregates = [F.sum("l_quantity").alias("f_sum_qty"), F.max("l_extendedprice").alias("f_max_price"), F.round(F.avg("l_discount"), 6).alias("f_avg_disc"), F.count("*").alias("f_n")]
    return table(spark, sf_dir, "lineitem").groupBy(day.alias("k")).agg(*aggregates)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: series, event_id, peak (day from FIRST_DAY), start, end (half-open window), driver class, size; each order of LARGE or more, its customer as series."""
    day = F.datediff(F.col("o_orderdate"), F.lit(FIRST_DAY)).cast("bigint")
    large = table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= LARGE)
    driver = F.when(F.col("o_orderpriority").startswith("1"), "CME").when(F.col("o_orderpriority").startswith("2"), "CIR")
    return large.select(
        F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("event_id"), day.alias("peak"), (day - 5).alias("start"), (day + 5).alias("end"), driver.alias("driver"), F.col("o_totalprice").alias("size")
    )


def shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7: series, event_id, peak, start, end in hours; each sample of SHOCK or more as an event with a day before and after it."""
    h = F.col("h")
    return samples(spark, sf_dir).where(F.abs("value") >= SHOCK).select("series", "event_id", h.alias("peak"), (h - 24).alias("start"), (h + 24).alias("end"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: series, h, threshold, y, p where both are there."""
    x = F.col("x")
    made = chunked(hourly(spark, sf_dir), ["series"], "h", 2, HORIZON, lambda w: {"peak": future_peak(x, w, HORIZON), "m": full(F.avg, F.abs(x), w, -2, 0)})
    grid = F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold")
    rows = made.where("peak is not null and m is not null").select("series", "h", "m", "peak", grid)
    # A threshold is a column here, so the comparison is written out.
    return rows.select("series", "h", "threshold", (F.col("peak") >= F.col("threshold")).cast("int").alias("y"), F.round(F.col("m") / (F.col("m") + F.col("threshold")), 9).alias("p"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    made = chunked(hourly(spark, sf_dir), ["series"], "h", 0, HORIZON, lambda w: {"peak": future_peak(x, w, HORIZON)})
    return made.select("series", "h", "x", "peak", *[exceedance(F.col("peak"), t).alias(f"y_{t}") for t in THRESHOLDS])


#: The same as common table expressions.
SAMPLES = f"""ev AS (SELECT event_type AS series, CAST(date_diff('hour', TIMESTAMP '{START}', ts) AS BIGINT) AS h, value, event_id
  FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}')"""
HOURLY = f"""{SAMPLES},
hv AS (SELECT series, h, value AS x FROM (SELECT *, row_number() OVER (PARTITION BY series, h ORDER BY abs(value) DESC, event_id) AS r FROM ev) WHERE r = 1),
d1 AS (SELECT s.series, g.h, x FROM (SELECT DISTINCT series FROM ev) s CROSS JOIN (SELECT CAST(unnest(range({HOURS})) AS BIGINT) AS h) g
  LEFT JOIN hv ON hv.series = s.series AND hv.h = g.h)"""
DAILY = f"""li AS (SELECT CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(l_shipdate AS DATE)) AS BIGINT) AS k, sum(l_quantity) AS f_sum_qty, max(l_extendedprice) AS f_max_price,
  round(avg(l_discount), 6) AS f_avg_disc, count(*) AS f_n FROM lineitem GROUP BY 1),
rs AS (SELECT CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(o_orderdate AS DATE)) AS BIGINT) AS k, max(o_totalprice) AS resp FROM orders GROUP BY 1),
d2 AS (SELECT g.k, f_sum_qty, f_max_price, f_avg_disc, f_n, resp FROM (SELECT CAST(unnest(range({DAYS})) AS BIGINT) AS k) g LEFT JOIN li ON li.k = g.k LEFT JOIN rs ON rs.k = g.k)"""
EVENTS = f"""d3 AS (SELECT o_custkey AS series, o_orderkey AS event_id, d AS peak, d - 5 AS "start", d + 5 AS "end", size,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'CME' WHEN o_orderpriority LIKE '2%' THEN 'CIR' END AS driver
  FROM (SELECT *, CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, o_totalprice AS size FROM orders WHERE o_totalprice >= {LARGE}))"""
SHOCKS = f"""d7 AS (SELECT series, event_id, h AS peak, h - 24 AS "start", h + 24 AS "end" FROM ev WHERE abs(value) >= {SHOCK})"""
#: Peak of the next HORIZON hours, null unless all are observed.
PEAK = f"""pk AS (SELECT *, CASE WHEN count(x) OVER f = {HORIZON} THEN max(abs(x)) OVER f END AS peak FROM d1
  WINDOW f AS (PARTITION BY series ORDER BY h ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING))"""
FORECASTS = f"""{HOURLY}, {PEAK},
pm AS (SELECT series, h, peak, CASE WHEN count(x) OVER b = 3 THEN avg(abs(x)) OVER b END AS m FROM pk WINDOW b AS (PARTITION BY series ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
d5 AS (SELECT series, h, threshold, CAST(peak >= threshold AS INT) AS y, round(m / (m + threshold), 9) AS p FROM pm, (SELECT unnest([50, 100, 150, 200]) AS threshold)
  WHERE peak IS NOT NULL AND m IS NOT NULL)"""
