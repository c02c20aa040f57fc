"""Queries on series: grids, labels, masks, rolling statistics, islands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import islands, spine
from ..operators import windows as w
from . import standins as s

LAGS, LENGTHS = (2, 3), (3, 6, 12)


def resample_argmax(spark, sf_dir):
    return spine.resample_argmax(s.samples(spark, sf_dir), ["series", "h"], "value", -F.col("event_id"))


def reindex_spine(spark, sf_dir):
    return s.hourly(spark, sf_dir)


def future_peak(spark, sf_dir):
    return s.labelled(spark, sf_dir).select("series", "h", "peak")


def exceedance_labels(spark, sf_dir):
    return s.labelled(spark, sf_dir).drop("x", "peak")


def flagship(spark, sf_dir):
    """How often the peak of the next hours reaches each threshold."""
    long = s.labelled(spark, sf_dir).select("series", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"y_{t}").alias("y")) for t in s.THRESHOLDS])).alias("l"))
    return long.groupBy("series", "l.threshold").agg(F.count("l.y").alias("n_valid"), F.coalesce(F.sum("l.y"), F.lit(0)).alias("n_positive"))


def onset_flags(spark, sf_dir):
    return w.chunked(s.hourly(spark, sf_dir), ["series"], "h", 1, 0, lambda o: {f"onset_{t}": w.onset(F.col("x"), o, t) for t in s.THRESHOLDS}).drop("x")


def onset_labels(spark, sf_dir):
    flags = w.chunked(s.hourly(spark, sf_dir), ["series"], "h", 1, 0, lambda o: {f"onset_{t}": w.onset(F.col("x"), o, t) for t in s.THRESHOLDS})
    made = w.chunked(flags, ["series"], "h", 0, s.HORIZON, lambda o: {f"y_onset_{t}": w.future_onset(F.col("x"), F.col(f"onset_{t}"), o, s.HORIZON) for t in s.THRESHOLDS})
    return made.select("series", "h", *[f"y_onset_{t}" for t in s.THRESHOLDS])


def masks(spark, sf_dir):
    rows = s.labelled(spark, sf_dir).select("series", "h", "x", F.col("peak").isNotNull().alias("target"))
    reach = max(LAGS) + max(LENGTHS) - 1
    return w.chunked(rows, ["series"], "h", reach, 0, lambda o: {f"mask_{a}_{n}": w.window_mask(F.col("x").isNotNull(), F.col("target"), o, a, n) for a in LAGS for n in LENGTHS})


def lag_window_masks(spark, sf_dir):
    return masks(spark, sf_dir).drop("x", "target")


def config_valid_counts(spark, sf_dir):
    pairs = [F.struct(F.lit(a).alias("lag"), F.lit(n).alias("length"), F.col(f"mask_{a}_{n}").alias("valid")) for a in LAGS for n in LENGTHS]
    return masks(spark, sf_dir).select(F.explode(F.array(*pairs)).alias("m")).groupBy("m.lag", "m.length").agg(F.sum("m.valid").alias("n_valid"))


def rolling_stats(spark, sf_dir):
    def make(o):
        return {f"{name}_{n}": F.round(c, 6) for n in LENGTHS for name, c in w.rolling(F.col("x"), o, n).items()}

    return w.chunked(s.hourly(spark, sf_dir), ["series"], "h", max(LENGTHS) - 1, 0, make).drop("x")


def rolling_accumulation(spark, sf_dir):
    def make(o):
        sums = {f"sum_{n}": F.round(w.full(F.sum, F.col("x"), o, -(n - 1), 0), 6) for n in LENGTHS}
        return sums | {f"above_{n}": w.duration_above(F.col("x"), o, n, 100.0) for n in LENGTHS}

    return w.chunked(s.hourly(spark, sf_dir), ["series"], "h", max(LENGTHS) - 1, 0, make).drop("x")


def feature_deltas(spark, sf_dir):
    return w.chunked(s.hourly(spark, sf_dir), ["series"], "h", 10, 0, lambda o: {f"delta_{n}": F.round(w.delta(F.col("x"), o, n), 6) for n in (1, 10)}).drop("x")


def sequence_windows(spark, sf_dir):
    made = w.chunked(s.hourly(spark, sf_dir), ["series"], "h", 4, 0, lambda o: {"seq": w.sequences(F.col("x"), o, 2, 3)})
    return made.where("seq is not null").select("series", "h", F.array_join(F.transform("seq", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",").alias("seq"))


def sequence_features(spark, sf_dir):
    """Two features of the days k-4 to k-2, each with a third as it is on day k-2."""
    made = w.sequence_matrix(s.daily(spark, sf_dir), [], "k", ["f_sum_qty", "resp"], ["f_n"], 2, 3, chunk_steps=500)
    text = F.array_join(F.transform(F.flatten("matrix"), lambda v: F.round(v).cast("bigint").cast("string")), ",")
    return made.where("matrix is not null").select("k", text.alias("matrix"))


def sample_index(spark, sf_dir):
    """Every second step, then those with a valid window, context and labels."""
    rows = w.chunked(masks(spark, sf_dir), ["series"], "h", 2, 0, lambda o: {"context": F.lag("x", 2).over(o)})
    needed = F.col("target") & (F.col("mask_2_3") == 1) & F.col("context").isNotNull()
    return islands.sample_index(rows, ["series"], "h", 2, needed, chunk=240).select("series", "h")


def sampled_sequences(spark, sf_dir):
    """The values of the hours h-4 to h-2, each with the magnitude at h-2, for every second hour that has all labels of peaks and onsets."""
    labels = [f"y_{t}" for t in s.THRESHOLDS], [f"y_onset_{t}" for t in s.THRESHOLDS]
    rows = s.labelled(spark, sf_dir).select("series", "h", "x", F.abs("x").alias("size"), *labels[0]).join(onset_labels(spark, sf_dir), ["series", "h"])
    needed = F.forall(F.array(*[F.col(c) for c in (*labels[0], *labels[1])]), lambda v: v.isNotNull())
    samples = islands.sample_index(rows, ["series"], "h", 2, needed, chunk=240).select("series", "h", F.lit(True).alias("sample"))
    marked = rows.join(samples, ["series", "h"], "left")
    made = w.endpoint_matrices(marked, ["series"], "h", F.coalesce("sample", F.lit(False)), ["x"], ["size"], 2, 3)
    return made.select("series", "h", F.array_join(F.transform(F.flatten("matrix"), lambda v: F.round(v).cast("bigint").cast("string")), ",").alias("matrix"))


def missing_intervals(spark, sf_dir):
    found = islands.islands(s.hourly(spark, sf_dir), ["series"], "h", F.col("x").isNull(), chunk_steps=240)
    return found.where("n >= 2").select("series", F.col("first").alias("start_h"), F.col("last").alias("end_h"), F.col("n").alias("hours"))


def long_missing_intervals(spark, sf_dir):
    """Of all features at once, by unpivot; runs also break where days are not in a row."""
    features = ["f_sum_qty", "f_max_price", "f_avg_disc", "resp"]
    long = s.daily(spark, sf_dir).select("k", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).isNull().alias("missing")) for f in features])).alias("v")).select("k", "v.*")
    found = islands.islands(long, ["feature"], "k", F.col("missing"))
    return found.where("n >= 2").select("feature", F.col("first").alias("start_k"), F.col("last").alias("end_k"), F.col("n").alias("days"))


def longest_gap(spark, sf_dir):
    found = islands.islands(s.hourly(spark, sf_dir), ["series"], "h", F.col("x").isNull(), chunk_steps=240)
    return found.groupBy("series").agg(F.max("n").alias("longest"), F.sum("n").alias("missing"))


def dedup_keep_last(spark, sf_dir):
    rows = s.samples(spark, sf_dir)
    return spine.dedup_keep_last(rows, ["series", "h"], F.col("event_id")).select("series", "h", "value", "event_id", "n_rows")


def downsample_peaks(spark, sf_dir):
    return islands.downsample_peaks(s.hourly(spark, sf_dir), ["series"], "h", "x", 100, chunk=240)


def union_parts(spark, sf_dir):
    a = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    b = s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    both = spine.union_parts(a, b)
    return both.groupBy((F.col("key") % 10).alias("digit")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.sum("balance"), 2).alias("balance"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, resample_argmax, reindex_spine, future_peak, exceedance_labels, onset_flags, onset_labels, lag_window_masks, config_valid_counts, rolling_stats, rolling_accumulation,
        feature_deltas, sequence_windows, sequence_features, sample_index, sampled_sequences, missing_intervals, long_missing_intervals, longest_gap, dedup_keep_last, downsample_peaks, union_parts,
    )
}

_MASK = ", ".join(
    f"CAST(peak IS NOT NULL AND count(x) OVER (PARTITION BY series ORDER BY h ROWS BETWEEN {a + n - 1} PRECEDING AND {a} PRECEDING) = {n} AS INT) AS mask_{a}_{n}" for a in LAGS for n in LENGTHS
)
_BACK = {n: f"(PARTITION BY series ORDER BY h ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in LENGTHS}
_ONSET = ", ".join(f"coalesce(CAST(abs(x) >= {t} AND lag(abs(x)) OVER (PARTITION BY series ORDER BY h) < {t} AS INT), 0) AS onset_{t}" for t in s.THRESHOLDS)
_RUNS = "SELECT {k}, min({o}) AS a, max({o}) AS b, count(*) AS n FROM (SELECT {k}, {o}, {o} - row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS g FROM {t} WHERE {c}) GROUP BY {k}, g"

ORACLE = {
    "flagship": f"""WITH {s.HOURLY}, {s.PEAK} SELECT series, threshold, count(peak) AS n_valid, count(*) FILTER (peak >= threshold) AS n_positive
FROM pk, (SELECT unnest([50, 100, 150, 200]) AS threshold) GROUP BY series, threshold""",
    "resample_argmax": f"WITH {s.HOURLY} SELECT series, h, x AS value FROM hv",
    "reindex_spine": f"WITH {s.HOURLY} SELECT * FROM d1",
    "future_peak": f"WITH {s.HOURLY}, {s.PEAK} SELECT series, h, peak FROM pk",
    "exceedance_labels": f"WITH {s.HOURLY}, {s.PEAK} SELECT series, h, " + ", ".join(f"CAST(peak >= {t} AS INT) AS y_{t}" for t in s.THRESHOLDS) + " FROM pk",
    "onset_flags": f"WITH {s.HOURLY} SELECT series, h, {_ONSET} FROM d1",
    "onset_labels": f"WITH {s.HOURLY}, o AS (SELECT *, {_ONSET} FROM d1) SELECT series, h, "
    + ", ".join(f"CASE WHEN x IS NOT NULL AND count(x) OVER f = {s.HORIZON} THEN max(onset_{t}) OVER f END AS y_onset_{t}" for t in s.THRESHOLDS)
    + f" FROM o WINDOW f AS (PARTITION BY series ORDER BY h ROWS BETWEEN 1 FOLLOWING AND {s.HORIZON} FOLLOWING)",
    "lag_window_masks": f"WITH {s.HOURLY}, {s.PEAK} SELECT series, h, {_MASK} FROM pk",
    "config_valid_counts": f"WITH {s.HOURLY}, {s.PEAK}, m AS (SELECT series, h, {_MASK} FROM pk) "
    + " UNION ALL ".join(f"SELECT {a} AS lag, {n} AS length, sum(mask_{a}_{n}) AS n_valid FROM m" for a in LAGS for n in LENGTHS),
    "rolling_stats": f"WITH {s.HOURLY} SELECT series, h, "
    + ", ".join(f"CASE WHEN count(x) OVER {_BACK[n]} = {n} THEN round({f}(x) OVER {_BACK[n]}, 6) END AS {name}_{n}" for n in LENGTHS for name, f in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop")))
    + " FROM d1",
    "rolling_accumulation": f"WITH {s.HOURLY} SELECT series, h, "
    + ", ".join(f"CASE WHEN count(x) OVER {_BACK[n]} = {n} THEN round(sum(x) OVER {_BACK[n]}, 6) END AS sum_{n}" for n in LENGTHS) + ", "
    + ", ".join(f"CASE WHEN count(*) OVER {_BACK[n]} = {n} THEN CAST(count(*) FILTER (x > 100) OVER {_BACK[n]} AS BIGINT) END AS above_{n}" for n in LENGTHS) + " FROM d1",
    "feature_deltas": f"WITH {s.HOURLY} SELECT series, h, " + ", ".join(f"coalesce(round(x - lag(x, {n}) OVER (PARTITION BY series ORDER BY h), 6), 0.0) AS delta_{n}" for n in (1, 10)) + " FROM d1",
    "sequence_windows": f"""WITH {s.HOURLY}, q AS (SELECT series, h, list(x) OVER f AS v, count(x) OVER f AS n FROM d1 WINDOW f AS (PARTITION BY series ORDER BY h ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING))
SELECT series, h, array_to_string([CAST(CAST(round(z * 100) AS BIGINT) AS VARCHAR) FOR z IN v], ',') AS seq FROM q WHERE n = 3""",
    "sequence_features": f"""WITH {s.DAILY}, q AS (SELECT k, """ + ", ".join(f"lag({c}, {b}) OVER (ORDER BY k) AS {c}_{b}" for b in (4, 3, 2) for c in ("f_sum_qty", "resp", "f_n")) + """ FROM d2)
SELECT k, concat_ws(',', """ + ", ".join(f"CAST(round({c}) AS BIGINT)" for b in (4, 3, 2) for c in (f"f_sum_qty_{b}", f"resp_{b}", "f_n_2")) + ") AS matrix FROM q WHERE " + " AND ".join(f"{c}_{b} IS NOT NULL" for b in (4, 3, 2) for c in ("f_sum_qty", "resp")) + """ AND f_n_2 IS NOT NULL""",
    "sample_index": f"WITH {s.HOURLY}, {s.PEAK}, m AS (SELECT series, h, x, lag(x, 2) OVER (PARTITION BY series ORDER BY h) AS c, {_MASK} FROM pk) SELECT series, h FROM m WHERE h % 2 = 0 AND mask_2_3 = 1 AND c IS NOT NULL",
    "sampled_sequences": f"""WITH {s.HOURLY}, q AS (SELECT series, h, x, count(x) OVER f AS c, """ + ", ".join(f"lag(x, {b}) OVER o AS x_{b}" for b in (4, 3, 2)) + f""" FROM d1
  WINDOW o AS (PARTITION BY series ORDER BY h), f AS (PARTITION BY series ORDER BY h ROWS BETWEEN 1 FOLLOWING AND {s.HORIZON} FOLLOWING))
SELECT series, h, concat_ws(',', """ + ", ".join(f"CAST(round(x_{b}) AS BIGINT), CAST(round(abs(x_2)) AS BIGINT)" for b in (4, 3, 2)) + f""") AS matrix
FROM q WHERE h % 2 = 0 AND x IS NOT NULL AND c = {s.HORIZON} AND x_4 IS NOT NULL AND x_3 IS NOT NULL AND x_2 IS NOT NULL""",
    "missing_intervals": f"WITH {s.HOURLY} SELECT series, a AS start_h, b AS end_h, n AS hours FROM ({_RUNS.format(k='series', o='h', t='d1', c='x IS NULL')}) WHERE n >= 2",
    "long_missing_intervals": f"""WITH {s.DAILY}, u AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, k, {f} IS NULL AS missing FROM d2" for f in ("f_sum_qty", "f_max_price", "f_avg_disc", "resp"))
    + f") SELECT feature, a AS start_k, b AS end_k, n AS days FROM ({_RUNS.format(k='feature', o='k', t='u', c='missing')}) WHERE n >= 2",
    "longest_gap": f"WITH {s.HOURLY} SELECT series, max(n) AS longest, CAST(sum(n) AS BIGINT) AS missing FROM ({_RUNS.format(k='series', o='h', t='d1', c='x IS NULL')}) GROUP BY series",
    "dedup_keep_last": f"WITH {s.SAMPLES} SELECT series, h, arg_max(value, event_id) AS value, max(event_id) AS event_id, count(*) AS n_rows FROM ev GROUP BY series, h",
    "downsample_peaks": f"""WITH {s.HOURLY}, b AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY h) * 100 - 1) // greatest(count(*) OVER (PARTITION BY series), 100) AS b FROM d1)
SELECT series, h, x FROM (SELECT *, row_number() OVER (PARTITION BY series, b ORDER BY abs(x) DESC NULLS LAST, h) AS r FROM b) WHERE r = 1""",
    "union_parts": """SELECT key % 10 AS digit, count(*) AS n, round(sum(amount), 2) AS amount, round(sum(balance), 2) AS balance
FROM (SELECT o_orderkey AS key, o_totalprice AS amount, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer) GROUP BY 1""",
}
