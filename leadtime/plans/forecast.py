"""Queries on forecasts: scores, curves, cutoffs, alarms, configurations, models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import blocks, events, model, order, reports, select, verify
from ..sources.staging import staged
from . import series
from . import standins as s

BY = ["threshold"]
KEYS = ["series", "threshold"]
CUTOFF = 0.5
# min_run, merge_gap, min_length of the alarm settings that a search tries; numbers of quantiles that are cutoffs.
SETTINGS = ((1, 0, 1), (2, 2, 2), (3, 5, 3), (3, 10, 3), (5, 5, 5), (5, 10, 5))
POINT_CUTOFFS, EVENT_CUTOFFS = 1001, 31
FEATURES = ["f_sum_qty", "f_max_price", "f_avg_disc", "f_n"]
POINT = (0.5, 0.45, 0.4, 0.35)
WEIGHTS = {50: 0.45, 100: 0.45, 150: 0.1, 200: 0.0}


def d5(spark, sf_dir) -> DataFrame:
    return s.forecasts(spark, sf_dir)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles with so many digits, as the SQL has them."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def alarm():
    return physics.decision(F.col("p"), F.lit(CUTOFF))


def decision_cut(spark, sf_dir):
    return d5(spark, sf_dir).select("series", "h", "threshold", alarm().alias("alarm"))


def logits(spark, sf_dir) -> DataFrame:
    inside = d5(spark, sf_dir).where("p > 0 and p < 1")
    return inside.withColumn("z", F.log(F.col("p") / (1 - F.col("p"))))


def calibrated_probability(spark, sf_dir):
    return logits(spark, sf_dir).select("series", "h", "threshold", F.round(physics.calibrated(F.col("z"), F.lit(1.5)), 6).alias("p"))


def temperature_fit(spark, sf_dir):
    return verify.fit_temperature(logits(spark, sf_dir), BY).select("threshold", F.round("temperature", 6).alias("temperature"))


def probability_series(spark, sf_dir):
    return reports.wide_probabilities(d5(spark, sf_dir), ["series", "h"], list(s.THRESHOLDS))


def skill_scores(spark, sf_dir):
    return rounded(verify.skill_scores(d5(spark, sf_dir), BY, F.lit(CUTOFF)))


def roc_auc(spark, sf_dir):
    return rounded(verify.roc_auc(d5(spark, sf_dir), BY))


def pr_auc(spark, sf_dir):
    return rounded(verify.average_precision(d5(spark, sf_dir), BY))


def roc_curve(spark, sf_dir):
    return rounded(verify.roc_curve(d5(spark, sf_dir), BY))


def pr_curve(spark, sf_dir):
    return rounded(verify.pr_curve(d5(spark, sf_dir), BY))


def cutoff_sweep(spark, sf_dir):
    rows = d5(spark, sf_dir)
    swept = verify.cutoff_sweep(rows, verify.candidate_cutoffs(rows, BY, POINT_CUTOFFS), BY)
    return rounded(swept.withColumn("cutoff", F.round("cutoff", 12).cast("decimal(20,12)"))).withColumn("cutoff", F.col("cutoff").cast("double"))


def cutoff_csi(spark, sf_dir):
    return verify.cutoff_csi(cutoff_sweep(spark, sf_dir), BY)


def cutoff_bias_one(spark, sf_dir):
    return verify.cutoff_bias_one(cutoff_sweep(spark, sf_dir), BY)


def cutoff_far_cap(spark, sf_dir):
    return verify.cutoff_far_cap(cutoff_sweep(spark, sf_dir), BY, 0.2)


def exact_quantiles(spark, sf_dir):
    found = order.quantiles(s.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [i / 30 for i in range(31)])
    return rounded(found, 4)


def histogram(spark, sf_dir):
    return rounded(select.histogram(s.hourly(spark, sf_dir), ["series"], "x", -250.0, 250.0, 100), 6)


def histogram_abs(spark, sf_dir):
    return select.labelled_histogram(s.hourly(spark, sf_dir).where("x is not null"), ["series"], "x", [0.0, 25.0, 50.0, 100.0, 200.0])


def corr_matrix(spark, sf_dir):
    return select.corr_matrix(s.daily(spark, sf_dir), [*FEATURES, "resp"]).select("a", "b", F.round("r", 6).alias("r"))


def feature_filter(spark, sf_dir):
    rows = s.daily(spark, sf_dir)
    kept = select.feature_filter(rows, FEATURES)
    counts = rows.agg(*[F.count(c).alias(c) for c in kept])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in kept])).alias("v")).select("v.*")


def feature_roles(spark, sf_dir):
    """How many columns of each family the rolling and delta tables have, and how many values."""
    wide = series.rolling_stats(spark, sf_dir).join(series.feature_deltas(spark, sf_dir), ["series", "h"])
    roles = physics.feature_roles([c for c in wide.columns if c not in ("series", "h")])
    rows = [F.struct(F.lit(k).alias("role"), F.lit(len(v)).alias("n_columns"), sum((F.count(c) for c in v), F.lit(0)).alias("n_values")) for k, v in roles.items()]
    return wide.agg(F.array(*rows).alias("v")).select(F.explode("v").alias("v")).select("v.*")


def standard_scale(spark, sf_dir):
    return rounded(select.standard_scale(s.daily(spark, sf_dir).select("k", *FEATURES), FEATURES, F.col("k") < 1750), 6)


def class_weights(spark, sf_dir):
    return rounded(reports.class_weights(d5(spark, sf_dir), BY, strict=False))


def forecast_loss(spark, sf_dir):
    return rounded(verify.losses(d5(spark, sf_dir), BY), 6)


def monotonicity_penalty(spark, sf_dir):
    raised = d5(spark, sf_dir).withColumn("p", F.when((F.col("h") % 7 == 0) & (F.col("threshold") == 100), F.col("p") * 1.5).otherwise(F.col("p")))
    return rounded(verify.monotonicity_penalty(raised, ["series", "h"], "threshold"))


def forecast_objective(spark, sf_dir):
    """The loss of all thresholds, onsets counting half."""
    rows, flags = d5(spark, sf_dir), series.onset_labels(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"y_onset_{t}").alias("y")) for t in s.THRESHOLDS])).alias("l")
    onset = rows.drop("y").join(flags.select("series", "h", pairs).select("series", "h", "l.*").where("y is not null"), ["series", "h", "threshold"])
    return rounded(verify.forecast_objective(rows, onset, BY, ["series", "h"], "threshold", 0.5, 0.1), 6)


def ensemble_mean(spark, sf_dir):
    folds = d5(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold")).withColumn("p", F.col("p") * (1 - 0.01 * F.col("fold")))
    return folds.groupBy("series", "h", "threshold").agg(F.round(F.avg("p"), 12).alias("p"))


def weighted_score(spark, sf_dir):
    weight = F.coalesce(*[F.when(F.col("threshold") == t, w) for t, w in WEIGHTS.items()])
    return rounded(reports.weighted_score(skill_scores(spark, sf_dir), "csi", weight))


# alarms


def segments(spark, sf_dir) -> DataFrame:
    return verify.alarm_segments(d5(spark, sf_dir), KEYS, "h", alarm() == 1)


def true_segments(spark, sf_dir) -> DataFrame:
    return verify.alarm_segments(d5(spark, sf_dir), KEYS, "h", F.col("y") == 1)


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"first": "first_h", "last": "last_h"})


def alarm_segments(spark, sf_dir):
    return renamed(segments(spark, sf_dir))


def processed(spark, sf_dir) -> DataFrame:
    return verify.postprocess(segments(spark, sf_dir), KEYS, 2, 2, 3)


def alarm_postprocess(spark, sf_dir):
    return renamed(processed(spark, sf_dir))


def alarm_episodes(spark, sf_dir):
    from ..operators.islands import islands

    found = islands(d5(spark, sf_dir), KEYS, "h", alarm() == 1, extra={"target_hours": (F.col("y"), F.sum), "matched": (F.col("y"), F.max)})
    return renamed(found).withColumn("duration", F.col("last_h") - F.col("first_h") + 1).withColumn("false_alarm", F.col("matched") == 0)


def event_match(spark, sf_dir):
    return verify.match_events(true_segments(spark, sf_dir), processed(spark, sf_dir), KEYS)


def warning_lead_time(spark, sf_dir):
    onsets = true_segments(spark, sf_dir).select(*KEYS, F.col("first").alias("onset"))
    return verify.lead_times(onsets, d5(spark, sf_dir).where(alarm() == 1), KEYS, "h", "onset", 6)


def warning_summary(spark, sf_dir):
    known = spark.createDataFrame([(t,) for t in (*s.THRESHOLDS, 1000)], "threshold int")
    leads = warning_lead_time(spark, sf_dir)
    g = leads.groupBy("threshold").agg(F.count("*").alias("eligible"), F.count_if("detected").alias("detected"))
    g = g.join(rounded(order.median(leads, ["threshold"], "lead", "median_lead"), 6), "threshold", "left")
    eps = alarm_episodes(spark, sf_dir).groupBy("threshold").agg(F.count("*").alias("episodes"), F.count_if("false_alarm").alias("false_episodes"))
    out = known.join(g, "threshold", "left").join(eps, "threshold", "left").na.fill(0, ["eligible", "detected", "episodes", "false_episodes"])
    return out.select("*", F.round(F.try_divide("detected", "eligible"), 9).alias("pod"), F.round(F.try_divide("false_episodes", "episodes"), 9).alias("false_ratio"))


def points(spark) -> DataFrame:
    """A cutoff and an alarm setting for each threshold."""
    rows = [(t, c, *SETTINGS[i]) for t, c, i in zip(s.THRESHOLDS, POINT, (0, 1, 1, 2))]
    return spark.createDataFrame(rows, "threshold int, cutoff double, min_run int, merge_gap int, min_length int")


def event_warnings(spark, sf_dir):
    """Catalogued events by threshold: onset, the first warning of the alarms at each threshold's own point, and the lead."""
    rows = d5(spark, sf_dir)
    onsets = events.event_onsets(s.hourly(spark, sf_dir), "h", "x", s.shocks(spark, sf_dir), list(s.THRESHOLDS), 48, ["series"])
    alarms = events.decided_alarms(rows, "h", points(spark), KEYS, BY).drop("cutoff")
    return events.event_warnings(rows, "h", alarms, onsets, KEYS, 6).select(*KEYS, "event_id", "onset", "first_alarm", "lead", "detected")


def event_evaluation(spark, sf_dir):
    """Per threshold, with its point: events that reach it, those warned of in time, the median lead, alarms and false ones."""
    rows = d5(spark, sf_dir)
    episodes = events.alarm_episodes(rows, "h", events.decided_alarms(rows, "h", points(spark), KEYS, BY), KEYS)
    return rounded(events.warning_summary(event_warnings(spark, sf_dir), episodes, points(spark), BY))


def config_scores(spark, sf_dir) -> DataFrame:
    """Point scores for each (lag, length), on the hours that its mask lets through."""
    pairs = [F.struct(F.lit(a).alias("lag"), F.lit(n).alias("length"), F.col(f"mask_{a}_{n}").alias("valid")) for a in series.LAGS for n in series.LENGTHS]
    valid = series.masks(spark, sf_dir).select("series", "h", F.explode(F.array(*pairs)).alias("m")).where("m.valid = 1").select("series", "h", "m.lag", "m.length")
    return verify.skill_scores(d5(spark, sf_dir).join(valid, ["series", "h"]), ["lag", "length", "threshold"], F.lit(CUTOFF))


def config_comparison(spark, sf_dir):
    scores = rounded(config_scores(spark, sf_dir)).select("lag", "length", "threshold", "csi", "far", "bias")
    counts = series.config_valid_counts(spark, sf_dir)
    return reports.config_comparison(scores, counts, ["lag", "length"])


def config_ranking(spark, sf_dir):
    return rounded(select.rank_configurations(config_scores(spark, sf_dir), BY, "lag", "length").select("threshold", "lag", "length", "csi", "rank"))


def window_selection(spark, sf_dir):
    return rounded(select.choose_window(config_scores(spark, sf_dir), "length", 0.5))


def best_epoch(spark, sf_dir):
    loss = F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 9)
    g = d5(spark, sf_dir).groupBy("threshold", F.floor(F.col("h") / 72).alias("epoch")).agg(loss.alias("loss"))
    return reports.best_epoch(g, BY)


def event_operating_point(spark, sf_dir):
    """Per threshold the cutoff and alarm setting by event scores, with a POFD of 0.3 at most and an event POD of 0.5 at least."""
    rows = d5(spark, sf_dir)
    points = verify.operating_points(rows, KEYS, BY, "h", verify.candidate_cutoffs(rows, BY, EVENT_CUTOFFS), list(SETTINGS))
    return rounded(verify.event_operating_point(points, BY, 0.3, 0.5))


def test_metrics(spark, sf_dir):
    """Point scores of raw decisions and of processed alarms, and event scores of these, per threshold."""
    rows, truth, done = d5(spark, sf_dir), true_segments(spark, sf_dir), processed(spark, sf_dir)
    known = spark.createDataFrame([(t,) for t in s.THRESHOLDS], "threshold int")
    events = verify.event_scores(truth, done, verify.match_events(truth, done, KEYS), BY, known)
    points = verify.ratios(verify.mask_counts(rows, done, KEYS, BY, "h", known))
    named = points.select("threshold", *[F.col(c).alias(f"processed_{c}") for c in points.columns if c != "threshold"])
    return rounded(events.join(named, BY, "left").join(skill_scores(spark, sf_dir), BY, "left"))


def test_predictions(spark, sf_dir):
    """Per hour and threshold: target, probability, raw decision, and the decision after post-processing."""
    rows = d5(spark, sf_dir)
    hours = processed(spark, sf_dir).select("series", "threshold", F.explode(F.sequence("first", "last")).alias("h")).withColumn("processed", F.lit(1))
    return rows.join(hours, ["series", "threshold", "h"], "left").select("series", "h", "threshold", "y", "p", alarm().alias("raw"), F.coalesce("processed", F.lit(0)).alias("processed"))


# models


MODEL_FEATURES = ["f_last", "f_mean", "f_max", "f_delta"]


#: Every so many-th hour of a series is a sample.
STRIDE = 2


def model_rows(spark, sf_dir) -> DataFrame:
    """Samples with features that end two hours before, in blocks of three days: every second hour of a series, then those with all labels and features."""
    from ..operators.islands import sample_index
    from ..operators.windows import chunked, full

    def make(w):
        x = F.abs("x")
        stats = {name: full(f, x, w, -4, -2) for name, f in (("f_mean", F.avg), ("f_max", F.max))}
        return stats | {"f_last": F.lag(x, 2).over(w), "f_delta": F.lag("x", 2).over(w) - F.lag("x", 3).over(w)}

    feats = chunked(s.hourly(spark, sf_dir), ["series"], "h", 4, 0, make).select("series", "h", *MODEL_FEATURES)
    labels = [f"y_{t}" for t in s.THRESHOLDS], [f"y_onset_{t}" for t in s.THRESHOLDS]
    wide = s.labelled(spark, sf_dir).select("series", "h", *labels[0]).join(series.onset_labels(spark, sf_dir).select("series", "h", *labels[1]), ["series", "h"]).join(feats, ["series", "h"])
    needed = F.forall(F.array(*[F.col(c).cast("double") for c in (*labels[0], *labels[1], *MODEL_FEATURES)]), lambda v: v.isNotNull())
    chosen = sample_index(wide, ["series"], "h", STRIDE, needed)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"y_{t}").alias("y")) for t in s.THRESHOLDS])).alias("l")
    return chosen.select("series", "h", *MODEL_FEATURES, each).select("series", "h", "l.*", *MODEL_FEATURES, F.floor(F.col("h") / 72).cast("int").alias("block"))


def model_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rows of the folds with their roles, and rows of the test, the last two blocks."""
    rows = staged(model_rows(spark, sf_dir), "samples")
    last = s.HOURS // 72 - 2
    known = spark.range(last).select(F.col("id").cast("int").alias("block"), F.col("id").alias("start"))
    return model.fold_rows(rows, blocks.forward_folds(known, 3, 0.4), "block"), rows.where(F.col("block") >= last)


def fold_scores(spark, sf_dir):
    ready, _ = model_parts(spark, sf_dir)
    found = model.validation_scores(ready, model.fit_folds(ready, MODEL_FEATURES, one_class=True), ["series", "h"])
    return found.select("series", "h", "fold", "threshold", "y", F.round("p", 6).alias("p"))


def mean_test_scores(spark, sf_dir) -> DataFrame:
    ready, test = model_parts(spark, sf_dir)
    return model.mean_scores(test, model.fit_folds(ready, MODEL_FEATURES, one_class=True), ["series", "h"])


def test_ensemble(spark, sf_dir):
    """The test rows with the mean probability of all folds' models."""
    return rounded(mean_test_scores(spark, sf_dir), 6)


def model_test_predictions(spark, sf_dir):
    """The test rows of the models with the decisions at each threshold's cutoff and setting, and the events whose windows hold them."""
    shocks = s.shocks(spark, sf_dir).select("series", "event_id", "peak", "start", "end")
    made = events.prediction_table(mean_test_scores(spark, sf_dir), "h", points(spark), ["series"], BY, shocks, 48, STRIDE)
    return rounded(made, 6)


def oof_predictions(spark, sf_dir):
    return model.out_of_fold(fold_scores(spark, sf_dir), ["series", "h"], list(s.THRESHOLDS))


QUERIES = {
    f.__name__: f
    for f in (
        decision_cut, calibrated_probability, temperature_fit, probability_series, skill_scores, roc_auc, pr_auc, roc_curve, pr_curve, cutoff_sweep, cutoff_csi, cutoff_bias_one,
        cutoff_far_cap, exact_quantiles, histogram, histogram_abs, corr_matrix, feature_filter, feature_roles, standard_scale, class_weights, forecast_loss, monotonicity_penalty, forecast_objective,
        ensemble_mean, weighted_score, alarm_segments, alarm_postprocess, alarm_episodes, event_match, warning_lead_time, warning_summary, event_warnings, event_evaluation, config_comparison, config_ranking,
        window_selection, best_epoch, event_operating_point, test_metrics, test_predictions, fold_scores, oof_predictions, test_ensemble, model_test_predictions,
    )
}

_RATIO = """round(tp / nullif(tp + fn, 0), 9) AS pod, round(fp / nullif(fp + tn, 0), 9) AS pofd, round(fp / nullif(tp + fp, 0), 9) AS far,
  round(tp / nullif(tp + fp + fn, 0), 9) AS csi, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + fp) / nullif(tp + fn, 0), 9) AS bias"""


def _counts(cut: str) -> str:
    return f"""count(*) FILTER (p >= {cut} AND y = 1) AS tp, count(*) FILTER (p >= {cut} AND y = 0) AS fp, count(*) FILTER (p < {cut} AND y = 1) AS fn, count(*) FILTER (p < {cut} AND y = 0) AS tn"""


_STEPS = f"""WITH {s.FORECASTS}, g AS (SELECT threshold, p, sum(y) AS pos, sum(1 - y) AS neg FROM d5 GROUP BY ALL),
sc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY threshold) AS np, sum(neg) OVER (PARTITION BY threshold) AS nn FROM g WINDOW w AS (PARTITION BY threshold ORDER BY p DESC))"""
_SWEEP = f"""WITH {s.FORECASTS}, cu AS (SELECT DISTINCT threshold, c AS cutoff FROM (SELECT threshold, unnest(list_concat(list_transform(quantile_cont(p, [{", ".join(str(i / (POINT_CUTOFFS - 1)) for i in range(POINT_CUTOFFS))}]), lambda v: v), [0.0, 1.0])) AS c FROM d5 GROUP BY threshold)),
sw AS (SELECT threshold, round(cutoff, 12) AS cutoff, tp, fp, fn, tn, {_RATIO} FROM (SELECT d5.threshold, cutoff, {_counts("cutoff")} FROM d5 JOIN cu ON d5.threshold = cu.threshold GROUP BY ALL))"""
_AT = f"SELECT {{by}}, tp, fp, fn, tn, {_RATIO} FROM (SELECT {{by}}, {_counts('0.5')} FROM {{t}} GROUP BY ALL)"
_SEG = f"""{s.FORECASTS}, se AS (SELECT series, threshold, min(h) AS a, max(h) AS b, count(*) AS n, sum(y) AS ty, max(y) AS my FROM
  (SELECT *, h - row_number() OVER (PARTITION BY series, threshold ORDER BY h) AS g FROM d5 WHERE p >= 0.5) GROUP BY series, threshold, g)"""
_POST = f"""{_SEG}, kp AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY series, threshold ORDER BY a) - 1 <= 2 THEN 0 ELSE 1 END AS nw FROM se WHERE n >= 2),
po AS (SELECT series, threshold, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY series, threshold ORDER BY a) AS g FROM kp) GROUP BY series, threshold, g HAVING max(b) - min(a) + 1 >= 3)"""
_LEAD = f"""{_SEG}, tr AS (SELECT series, threshold, min(h) AS onset FROM (SELECT *, h - row_number() OVER (PARTITION BY series, threshold ORDER BY h) AS g FROM d5 WHERE y = 1) GROUP BY series, threshold, g),
ld AS (SELECT tr.series, tr.threshold, onset, min(h) AS first_alarm FROM tr LEFT JOIN d5 ON d5.series = tr.series AND d5.threshold = tr.threshold AND p >= 0.5 AND h >= onset - 6 AND h < onset GROUP BY ALL)"""
_EVAL = f"""{s.FORECASTS}, {s.SHOCKS}, pt AS (SELECT * FROM (VALUES {", ".join(f"({t}, {c}::DOUBLE, {', '.join(map(str, SETTINGS[i]))})" for t, c, i in zip(s.THRESHOLDS, POINT, (0, 1, 1, 2)))}) v(threshold, cutoff, min_run, merge_gap, min_length)),
s1 AS (SELECT series, threshold, merge_gap, min_length, min(h) AS a, max(h) AS b FROM (SELECT d5.*, pt.*, h - row_number() OVER (PARTITION BY series, d5.threshold ORDER BY h) AS g FROM d5 JOIN pt ON pt.threshold = d5.threshold WHERE p >= cutoff)
  GROUP BY series, threshold, merge_gap, min_length, min_run, g HAVING count(*) >= min_run),
s2 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY series, threshold ORDER BY a) - 1 <= merge_gap THEN 0 ELSE 1 END AS nw FROM s1),
pr AS (SELECT series, threshold, min(a) AS a, max(b) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY series, threshold ORDER BY a) AS g FROM s2) GROUP BY series, threshold, min_length, g HAVING max(b) - min(a) + 1 >= min_length),
al AS (SELECT d5.series, d5.threshold, h, y, a FROM d5 JOIN pr ON pr.series = d5.series AND pr.threshold = d5.threshold AND h BETWEEN a AND b),
hi AS (SELECT d7.series, event_id, threshold, peak, h, h - row_number() OVER (PARTITION BY event_id, threshold ORDER BY h) AS run FROM d1 JOIN d7 ON d7.series = d1.series AND h >= "start" AND h < "end", (SELECT unnest([50, 100, 150, 200]) AS threshold) WHERE abs(x) >= threshold),
st AS (SELECT *, min(h) OVER (PARTITION BY event_id, threshold, run) AS a FROM hi),
os AS (SELECT series, event_id, threshold, arg_min(a, abs(h - peak) * 100000 + h) AS onset FROM st GROUP BY ALL),
wn AS (SELECT os.series, os.threshold, event_id, onset, min(h) AS first_alarm FROM os LEFT JOIN al ON al.series = os.series AND al.threshold = os.threshold AND h >= onset - 6 AND h < onset GROUP BY ALL),
ep AS (SELECT pr.series, pr.threshold, pr.a, coalesce(sum(y), 0) AS ty FROM pr LEFT JOIN al ON al.series = pr.series AND al.threshold = pr.threshold AND al.a = pr.a GROUP BY ALL)"""
_CONFIG = f"{s.FORECASTS}, mk AS (SELECT series, h, {series._MASK} FROM pk), cv AS (" + " UNION ALL ".join(
    f"SELECT series, h, {a} AS lag, {n} AS length FROM mk WHERE mask_{a}_{n} = 1" for a in series.LAGS for n in series.LENGTHS
) + "), cj AS (SELECT d5.*, lag, length FROM d5 JOIN cv ON d5.series = cv.series AND d5.h = cv.h), cs AS (" + _AT.format(by="lag, length, threshold", t="cj") + ")"
_LOSS = "least(greatest(p, 1e-7), 1 - 1e-7)"
_LOW, _HIGH = f"{math.log(0.05)!r}::DOUBLE", f"{math.log(20.0)!r}::DOUBLE"


def _temperatures(rounds: int, points: int = 41) -> str:
    """One table of grid bounds and best place (a, b, m) for each round."""
    out = f"g1 AS (SELECT threshold, {_LOW} AS a, {_HIGH} AS b FROM z GROUP BY 1)"
    for k in range(1, rounds + 1):
        out += f""", t{k} AS (SELECT threshold, a, b, a + (b - a) * i / {points - 1} AS lt FROM g{k}, (SELECT unnest(range({points})) AS i)),
l{k} AS (SELECT threshold, a, b, lt, sum(greatest(z / exp(lt), 0) - z / exp(lt) * y + ln(1 + exp(-abs(z / exp(lt))))) AS loss, min(y) < max(y) AS two FROM z JOIN t{k} USING (threshold) GROUP BY ALL),
g{k + 1} AS (SELECT threshold, greatest(m - w, {_LOW}) AS a, least(m + w, {_HIGH}) AS b, m, two FROM (SELECT threshold, arg_min(lt, loss) AS m, any_value(two) AS two, (any_value(b) - any_value(a)) / {points - 1} AS w FROM l{k} GROUP BY threshold))"""
    return out


ORACLE = {
    "decision_cut": f"WITH {s.FORECASTS} SELECT series, h, threshold, CAST(p >= 0.5 AS INT) AS alarm FROM d5",
    "calibrated_probability": f"WITH {s.FORECASTS} SELECT series, h, threshold, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.5)), 6) AS p FROM d5 WHERE p > 0 AND p < 1",
    "temperature_fit": f"""WITH {s.FORECASTS}, z AS (SELECT threshold, y, ln(p / (1 - p)) AS z FROM d5 WHERE p > 0 AND p < 1), {_temperatures(3)}
SELECT threshold, round(CASE WHEN two THEN exp(m) ELSE 1 END, 6) AS temperature FROM g4""",
    "probability_series": f"WITH {s.FORECASTS} SELECT series, h, " + ", ".join(f"max(p) FILTER (threshold = {t}) AS p_{t}" for t in s.THRESHOLDS) + " FROM d5 GROUP BY ALL",
    "skill_scores": f"WITH {s.FORECASTS} " + _AT.format(by="threshold", t="d5"),
    "roc_auc": f"{_STEPS} SELECT threshold, round(sum(pos * ((nn - fp) + neg / 2)) / nullif(max(np) * max(nn), 0), 9) AS roc_auc FROM sc GROUP BY threshold",
    "pr_auc": f"{_STEPS} SELECT threshold, round(sum(pos * (tp / (tp + fp))) / nullif(max(np), 0), 9) AS pr_auc FROM sc GROUP BY threshold",
    "roc_curve": f"{_STEPS} SELECT threshold, p, round(fp / nullif(nn, 0), 9) AS fpr, round(tp / nullif(np, 0), 9) AS tpr FROM sc UNION ALL SELECT DISTINCT threshold, NULL, 0.0, 0.0 FROM sc",
    "pr_curve": f"{_STEPS} SELECT threshold, p, round(tp / nullif(np, 0), 9) AS recall, round(tp / (tp + fp), 9) AS precision FROM sc UNION ALL SELECT DISTINCT threshold, NULL, 0.0, 1.0 FROM sc",
    "cutoff_sweep": f"{_SWEEP} SELECT * FROM sw",
    "cutoff_csi": f"{_SWEEP} SELECT * FROM sw WHERE tp + fp > 0 QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY csi DESC NULLS LAST, far NULLS LAST, cutoff) = 1",
    "cutoff_bias_one": f"{_SWEEP} SELECT * FROM sw WHERE tp + fp > 0 QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY abs(bias - 1) NULLS LAST, csi DESC NULLS LAST, far NULLS LAST, cutoff) = 1",
    "cutoff_far_cap": f"""{_SWEEP} SELECT *, CASE WHEN far <= 0.2 THEN 'within_cap' ELSE 'lowest_far' END AS status FROM sw WHERE tp + fp > 0 QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY
  CASE WHEN far <= 0.2 THEN 0 ELSE 1 END, CASE WHEN far <= 0.2 THEN -csi ELSE far END NULLS LAST, CASE WHEN far <= 0.2 THEN abs(bias - 1) ELSE -csi END NULLS LAST, cutoff) = 1""",
    "exact_quantiles": f"""SELECT o_orderpriority, CAST(place - 1 AS INT) AS place, round(q[place], 4) AS quantile FROM (SELECT o_orderpriority, quantile_cont(o_totalprice, [{", ".join(str(i / 30) for i in range(31))}]) AS q FROM orders GROUP BY 1), (SELECT unnest(range(1, 32)) AS place)""",
    "histogram": f"""WITH {s.HOURLY}, c AS (SELECT series, least(CAST(floor((x + 250) / 5) AS INT), 99) AS bin, count(*) AS n FROM d1 WHERE x BETWEEN -250 AND 250 GROUP BY ALL)
SELECT k.series, k.bin, round(-250 + (k.bin + 0.5) * 5, 6)::DOUBLE AS center, coalesce(n, 0) AS n, round(log10(n), 6) AS log10_n FROM (SELECT series, CAST(unnest(range(100)) AS INT) AS bin FROM (SELECT DISTINCT series FROM d1)) k LEFT JOIN c ON c.series = k.series AND c.bin = k.bin""",
    "histogram_abs": f"""WITH {s.HOURLY}, c AS (SELECT series, CASE WHEN abs(x) >= 200 THEN '>=200' WHEN abs(x) >= 100 THEN '100-200' WHEN abs(x) >= 50 THEN '50-100' WHEN abs(x) >= 25 THEN '25-50' ELSE '0-25' END AS label, count(*) AS n FROM d1 WHERE x IS NOT NULL GROUP BY ALL)
SELECT k.series, k.label, coalesce(n, 0) AS n FROM (SELECT series, unnest(['0-25', '25-50', '50-100', '100-200', '>=200']) AS label FROM (SELECT DISTINCT series FROM d1 WHERE x IS NOT NULL)) k LEFT JOIN c ON c.series = k.series AND c.label = k.label""",
    "corr_matrix": f"WITH {s.DAILY} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM d2" for i, a in enumerate([*FEATURES, "resp"]) for b in [*FEATURES, "resp"][i + 1 :]),
    "feature_filter": f"""WITH {s.DAILY}, r AS (SELECT corr(f_sum_qty, f_max_price) AS ab, corr(f_sum_qty, f_avg_disc) AS ac, corr(f_sum_qty, f_n) AS ad, corr(f_max_price, f_avg_disc) AS bc, corr(f_max_price, f_n) AS bd, corr(f_avg_disc, f_n) AS cd FROM d2),
k AS (SELECT *, abs(ab) < 0.95 AS kb, abs(ac) < 0.95 AND (abs(ab) >= 0.95 OR abs(bc) < 0.95) AS kc FROM r), k2 AS (SELECT *, abs(ad) < 0.95 AND (NOT kb OR abs(bd) < 0.95) AND (NOT kc OR abs(cd) < 0.95) AS kd FROM k)
SELECT 'f_sum_qty' AS feature, (SELECT count(f_sum_qty) FROM d2) AS n UNION ALL SELECT 'f_max_price', (SELECT count(f_max_price) FROM d2) FROM k2 WHERE kb
UNION ALL SELECT 'f_avg_disc', (SELECT count(f_avg_disc) FROM d2) FROM k2 WHERE kc UNION ALL SELECT 'f_n', (SELECT count(f_n) FROM d2) FROM k2 WHERE kd""",
    "standard_scale": f"WITH {s.DAILY}, f AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM d2 WHERE k < 1750) SELECT k, " + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in FEATURES) + " FROM d2, f",
    "class_weights": f"WITH {s.FORECASTS} SELECT threshold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((count(*) - sum(y)) / greatest(sum(y), 1), 9) AS weight FROM d5 GROUP BY threshold",
    "forecast_loss": f"""WITH {s.FORECASTS}, l AS (SELECT threshold, sum(CASE WHEN y = 1 THEN -ln({_LOSS}) ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN -ln(1 - {_LOSS}) ELSE 0 END) AS b, sum(y) AS np, count(*) AS n FROM d5 GROUP BY threshold)
SELECT threshold, round((a + b) / n, 6) AS bce, round((a * ((n - np) / greatest(np, 1)) + b) / n, 6) AS weighted_bce FROM l""",
    "monotonicity_penalty": f"""WITH {s.FORECASTS}, q AS (SELECT *, p * CASE WHEN h % 7 = 0 AND threshold = 100 THEN 1.5 ELSE 1 END AS pp FROM d5), w AS (SELECT pp - lag(pp) OVER (PARTITION BY series, h ORDER BY threshold) AS d FROM q)
SELECT round(avg(greatest(d, 0) * greatest(d, 0)), 9) AS penalty FROM w WHERE d IS NOT NULL""",
    "forecast_objective": f"""WITH {s.FORECASTS}, o AS (SELECT *, {series._ONSET} FROM d1), ol AS (SELECT series, h, """
    + ", ".join(f"CASE WHEN x IS NOT NULL AND count(x) OVER f = {s.HORIZON} THEN max(onset_{t}) OVER f END AS y_{t}" for t in s.THRESHOLDS)
    + f""" FROM o WINDOW f AS (PARTITION BY series ORDER BY h ROWS BETWEEN 1 FOLLOWING AND {s.HORIZON} FOLLOWING)), od AS (SELECT d5.threshold, p, CASE d5.threshold """
    + " ".join(f"WHEN {t} THEN y_{t}" for t in s.THRESHOLDS)
    + f""" END AS y FROM d5 JOIN ol ON ol.series = d5.series AND ol.h = d5.h), bo AS (SELECT 'peak' AS what, threshold, y, p FROM d5 UNION ALL SELECT 'onset', threshold, y, p FROM od WHERE y IS NOT NULL),
l AS (SELECT what, threshold, sum(CASE WHEN y = 1 THEN -ln({_LOSS}) ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN -ln(1 - {_LOSS}) ELSE 0 END) AS b, sum(y) AS np, count(*) AS n FROM bo GROUP BY ALL),
m AS (SELECT what, avg((a * ((n - np) / greatest(np, 1)) + b) / n) AS v FROM l GROUP BY 1), r AS (SELECT p - lag(p) OVER (PARTITION BY series, h ORDER BY threshold) AS d FROM d5),
t AS (SELECT max(v) FILTER (what = 'peak') AS pk, max(v) FILTER (what = 'onset') AS os, (SELECT avg(greatest(d, 0) * greatest(d, 0)) FROM r WHERE d IS NOT NULL) AS pe FROM m)
SELECT round(pk, 6) AS peak_bce, round(os, 6) AS onset_bce, round(pe, 6) AS penalty, round(pk + 0.5::DOUBLE * os + 0.1::DOUBLE * coalesce(pe, 0), 6) AS objective FROM t""",
    "feature_roles": f"WITH {s.HOURLY}, q AS (SELECT " + ", ".join(f"CAST(count(x) OVER {series._BACK[n]} = {n} AS INT) AS w{n}" for n in series.LENGTHS)
    + " FROM d1) SELECT 'delta' AS role, 2 AS n_columns, 2 * count(*) AS n_values FROM q UNION ALL SELECT 'accumulation', 0, 0 UNION ALL SELECT 'statistics', 9, CAST(3 * sum("
    + " + ".join(f"w{n}" for n in series.LENGTHS) + ") AS BIGINT) FROM q UNION ALL SELECT 'sequence', 0, 0",
    "ensemble_mean": f"WITH {s.FORECASTS} SELECT series, h, threshold, round(p * 0.99, 12) AS p FROM d5",
    "weighted_score": f"WITH {s.FORECASTS}, t AS (" + _AT.format(by="threshold", t="d5") + ") SELECT round(sum(CASE threshold WHEN 50 THEN 0.45 WHEN 100 THEN 0.45 WHEN 150 THEN 0.1 END * csi) / sum(CASE WHEN csi IS NOT NULL THEN CASE threshold WHEN 50 THEN 0.45 WHEN 100 THEN 0.45 WHEN 150 THEN 0.1 END END), 9) AS score, max(csi) AS best_csi FROM t",
    "alarm_segments": f"WITH {_SEG} SELECT series, threshold, a AS first_h, b AS last_h, n FROM se",
    "alarm_postprocess": f"WITH {_POST} SELECT series, threshold, a AS first_h, b AS last_h FROM po",
    "alarm_episodes": f"WITH {_SEG} SELECT series, threshold, a AS first_h, b AS last_h, n, CAST(ty AS BIGINT) AS target_hours, my AS matched, b - a + 1 AS duration, my = 0 AS false_alarm FROM se",
    "warning_lead_time": f"WITH {_LEAD} SELECT series, threshold, onset, first_alarm, onset - first_alarm AS lead, first_alarm IS NOT NULL AS detected FROM ld",
    "warning_summary": f"""WITH {_LEAD} SELECT threshold, coalesce(eligible, 0) AS eligible, coalesce(detected, 0) AS detected, median_lead, coalesce(episodes, 0) AS episodes, coalesce(fe, 0) AS false_episodes, round(detected / nullif(eligible, 0), 9) AS pod, round(fe / nullif(episodes, 0), 9) AS false_ratio
FROM (SELECT unnest([50, 100, 150, 200, 1000]) AS threshold) LEFT JOIN (SELECT threshold, count(*) AS eligible, count(first_alarm) AS detected, round(median(onset - first_alarm), 6) AS median_lead FROM ld GROUP BY 1) USING (threshold)
LEFT JOIN (SELECT threshold, count(*) AS episodes, count(*) FILTER (my = 0) AS fe FROM se GROUP BY 1) USING (threshold)""",
    "event_warnings": f"WITH {_EVAL} SELECT series, threshold, event_id, onset, first_alarm, onset - first_alarm AS lead, first_alarm IS NOT NULL AS detected FROM wn",
    "event_evaluation": f"""WITH {_EVAL} SELECT pt.*, coalesce(eligible, 0) AS eligible, coalesce(detected, 0) AS detected, round(median_lead, 9) AS median_lead, coalesce(episodes, 0) AS episodes, coalesce(fe, 0) AS false_episodes,
  coalesce(eligible - detected, 0) AS missed, round(detected / nullif(eligible, 0), 9) AS pod, coalesce(episodes - fe, 0) AS true_episodes, round(fe / nullif(episodes, 0), 9) AS false_ratio
FROM pt LEFT JOIN (SELECT threshold, count(*) AS eligible, count(first_alarm) AS detected, median(onset - first_alarm) AS median_lead FROM wn GROUP BY 1) w ON w.threshold = pt.threshold
LEFT JOIN (SELECT threshold, count(*) AS episodes, count(*) FILTER (ty = 0) AS fe FROM ep GROUP BY 1) e ON e.threshold = pt.threshold""",
    "config_comparison": f"WITH {_CONFIG} SELECT lag, length, threshold, csi, far, bias, n_valid FROM cs LEFT JOIN (SELECT lag, length, count(*) AS n_valid FROM cv GROUP BY ALL) USING (lag, length)",
    "config_ranking": f"WITH {_CONFIG} SELECT threshold, lag, length, csi, row_number() OVER (PARTITION BY threshold ORDER BY csi DESC NULLS LAST, far NULLS LAST, abs(bias - 1) NULLS LAST, lag, length) AS rank FROM cs",
    "window_selection": f"""WITH {_CONFIG}, m AS (SELECT length, round(avg(tp / nullif(tp + fp + fn, 0)), 9) AS csi, round(avg(fp / nullif(fp + tn, 0)), 9) AS pofd FROM cs GROUP BY length)
SELECT length, csi, pofd, coalesce(pofd <= 0.5, false) AS within_cap FROM m ORDER BY CASE WHEN pofd <= 0.5 THEN 0 ELSE 1 END, CASE WHEN pofd <= 0.5 THEN -csi ELSE pofd END, length LIMIT 1""",
    "best_epoch": f"""WITH {s.FORECASTS}, e AS (SELECT threshold, h // 72 AS epoch, round(avg((p - y) * (p - y)), 9) AS loss FROM d5 GROUP BY ALL)
SELECT threshold, epoch, loss FROM e QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY loss, epoch) = 1""",
    "test_predictions": f"""WITH {_POST} SELECT d5.series, d5.h, d5.threshold, y, p, CAST(p >= 0.5 AS INT) AS raw, CAST(po.a IS NOT NULL AS INT) AS processed
FROM d5 LEFT JOIN po ON po.series = d5.series AND po.threshold = d5.threshold AND d5.h BETWEEN po.a AND po.b""",
}
