"""Forecast verification: scores, curves, cutoff searches, alarms as events.

Predictions are long: one row per sample and threshold, with ``y`` (0 or 1) and ``p``. ``by`` are the columns
that tell forecasts apart (such as the threshold); everything is computed for all of them at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .islands import coalesced, islands, runs_by_level
from .matching import match_events
from .order import place, quantiles, ranges
from .running import running

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(y: Column, alarm: Column) -> list[Column]:
    return [
        F.count_if((alarm == 1) & (y == 1)).alias("tp"), F.count_if((alarm == 1) & (y == 0)).alias("fp"), F.count_if((alarm == 0) & (y == 1)).alias("fn"), F.count_if((alarm == 0) & (y == 0)).alias("tn"),
    ]


def ratios(df: DataFrame) -> DataFrame:
    """Adds POD, POFD, FAR, CSI, F1 and Bias to the four counts; null where a denominator is 0."""
    tp, fp, fn, tn = map(F.col, COUNTS)

    ratio = F.try_divide
    return df.select(
        "*", ratio(tp, tp + fn).alias("pod"), ratio(fp, fp + tn).alias("pofd"), ratio(fp, tp + fp).alias("far"), ratio(tp, tp + fp + fn).alias("csi"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + fp, tp + fn).alias("bias"),
    )


def skill_scores(df: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    return ratios(df.groupBy(*by).agg(*confusion(F.col("y"), (F.col("p") >= cutoff).cast("int"))))


def score_steps(df: DataFrame, by: list[str]) -> DataFrame:
    """by, p, pos, neg, and tp, fp: for each distinct score, how many positives and negatives it has and how many score at least as high.

    Running sums in two levels: inside ranges of scores with about equal shares of them, then over the range totals.
    """
    g = df.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranged = ranges(g.withColumn("_o", -F.col("p")), [*by, "_o"])
    return running(ranged, by, ["_o"], F.col("_r"), sums={"tp": F.col("pos"), "fp": F.col("neg")}).drop("_o", "_r")


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve; ties count half; null with one class only."""
    s = score_steps(df, by)
    below = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2))
    # fp counts negatives at or above a score, so what it misses is below.
    total = s.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), below.alias("_a"))
    return total.select(*by, F.try_divide(F.col("_p") * F.col("_n") - F.col("_a"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    """Sum over scores of the step in recall times the precision there."""
    s = score_steps(df, by)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"))


def roc_curve(df: DataFrame, by: list[str]) -> DataFrame:
    s = score_steps(df, by)
    total = s.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = s.join(total, by).select(*by, "p", F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"))
    return points.unionByName(total.select(*by, F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_curve(df: DataFrame, by: list[str]) -> DataFrame:
    s = score_steps(df, by)
    total = s.groupBy(*by).agg(F.sum("pos").alias("_p"))
    points = s.join(total, by).select(*by, "p", F.try_divide("tp", "_p").alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return points.unionByName(total.select(*by, F.lit(None).cast("double").alias("p"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")))


def candidate_cutoffs(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, cutoff: n quantiles of the scores, 0 and 1, without repeats."""
    found = quantiles(df, by, "p", [i / (n - 1) for i in range(n)])
    return found.select(*by, F.explode(F.array("quantile", F.lit(0.0), F.lit(1.0))).alias("cutoff")).distinct()


def cutoff_sweep(df: DataFrame, cutoffs: DataFrame, by: list[str]) -> DataFrame:
    """The counts and ratios of each cutoff: distinct scores are counted by the highest cutoff they reach, then summed from above.

    There are some thousand cutoffs at most, which meet the scores as one sorted array for each forecast. The place of a score among
    them is found by halving and counted where the score is read, so scores aren't put in order.
    """
    lists = cutoffs.groupBy(*by).agg(F.array_sort(F.collect_list("cutoff")).alias("_c"))
    scores = df.groupBy(*by, "p").agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg"))
    counted = scores.join(lists, by).groupBy(*by, place(F.col("_c"), F.col("p")).alias("_k")).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    totals = counted.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    steps = lists.select(*by, F.posexplode("_c").alias("_i", "cutoff")).withColumn("_k", F.col("_i") + 1)
    w = Window.partitionBy(*by).orderBy(F.desc("_k"))
    filled = steps.join(counted, [*by, "_k"], "left")
    at = filled.select(*by, "cutoff", F.coalesce(F.sum("_pos").over(w), F.lit(0)).alias("tp"), F.coalesce(F.sum("_neg").over(w), F.lit(0)).alias("fp")).join(totals, by)
    return ratios(at.select(*by, "cutoff", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn")))


def first_row(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cutoff_csi(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Highest CSI, then lowest FAR, then lowest cutoff, among cutoffs that give an alarm."""
    return first_row(sweep.where("tp + fp > 0"), by, F.col("csi").desc_nulls_last(), F.col("far").asc_nulls_last(), F.col("cutoff"))


def cutoff_bias_one(sweep: DataFrame, by: list[str]) -> DataFrame:
    return first_row(sweep.where("tp + fp > 0"), by, F.abs(F.col("bias") - 1).asc_nulls_last(), F.col("csi").desc_nulls_last(), F.col("far").asc_nulls_last(), F.col("cutoff"))


def cutoff_far_cap(sweep: DataFrame, by: list[str], cap: float) -> DataFrame:
    """The best CSI with FAR up to the cap; where no cutoff has that, the lowest FAR. ``status`` tells which."""
    ok = F.coalesce(F.col("far") <= cap, F.lit(False))
    tiers = sweep.where("tp + fp > 0").withColumn("status", F.when(ok, "within_cap").otherwise("lowest_far"))
    order = [F.when(ok, 0).otherwise(1), F.when(ok, -F.col("csi")).otherwise(F.col("far")).asc_nulls_last(), F.when(ok, F.abs(F.col("bias") - 1)).otherwise(-F.col("csi")).asc_nulls_last(), F.col("cutoff")]
    return first_row(tiers, by, *order)


# Alarms as events


def postprocess(segments: DataFrame, keys: list[str], min_run: int | Column, merge_gap: int | Column, min_length: int | Column, extra: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Segments (first, last) with short ones dropped, gaps of up to ``merge_gap`` steps closed, and short results dropped.

    The settings are numbers, or columns that are among the keys. ``extra`` aggregates columns of the segments that merge.
    """
    gap = merge_gap if isinstance(merge_gap, Column) else F.lit(merge_gap)
    merged = coalesced(segments.where(F.col("n") >= min_run), keys, "first", "last", gap + 1, extra or {})
    return merged.where(F.col("last") - F.col("first") + 1 >= min_length)


def alarm_segments(df: DataFrame, keys: list[str], step: str, flag: Column) -> DataFrame:
    return islands(df, keys, step, flag)


def mask_counts(rows: DataFrame, alarms: DataFrame, keys: list[str], by: list[str], step: str, known: DataFrame) -> DataFrame:
    """Per forecast of ``known``: point counts (tp, fp, fn, tn) of the rows inside alarm segments, which may bridge rows below the cutoff.

    ``keys`` tell the series of the rows apart, ``by`` the forecasts of the alarms; what both have joins them.
    """
    shared = [k for k in by if k in rows.columns]
    inside = alarms.select(*dict.fromkeys([*keys, *by]), F.explode(F.sequence("first", "last")).alias(step)).join(rows.select(*keys, step, "y"), [*keys, step])
    hit = inside.groupBy(*by).agg(F.sum("y").cast("bigint").alias("tp"), F.sum(1 - F.col("y")).cast("bigint").alias("fp"))
    total = rows.groupBy(*shared).agg(F.sum("y").cast("bigint").alias("_p"), F.sum(1 - F.col("y")).cast("bigint").alias("_n"))
    out = known.join(total, shared).join(hit, by, "left").na.fill(0, ["tp", "fp"])
    return out.select(*by, "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"))


def event_scores(truth: DataFrame, alarms: DataFrame, matches: DataFrame, by: list[str], known: DataFrame) -> DataFrame:
    """Per forecast of ``known``: true events, alarms, hits, misses, false alarms and their ratios. ``truth`` may have a part of ``by`` only."""
    shared = [k for k in by if k in truth.columns]
    n_t = truth.groupBy(*shared).agg(F.count("*").alias("n_truth"))
    n_a = alarms.groupBy(*by).agg(F.count("*").alias("n_alarms"))
    n_m = matches.groupBy(*by).agg(F.count("*").alias("hits"))
    out = known.join(n_t, shared, "left").join(n_a, by, "left").join(n_m, by, "left").na.fill(0, ["n_truth", "n_alarms", "hits"])
    hits, t, a = F.col("hits"), F.col("n_truth"), F.col("n_alarms")
    return out.select(
        *by, "n_truth", "n_alarms", "hits", (t - hits).alias("misses"), (a - hits).alias("false_alarms"), F.try_divide(hits, t).alias("event_pod"), F.try_divide(a - hits, a).alias("event_far"),
        F.try_divide(hits, t + a - hits).alias("event_csi"), F.try_divide(2 * hits, t + a).alias("event_f1"), F.try_divide(a, t).alias("event_bias"),
    )


def operating_points(rows: DataFrame, keys: list[str], by: list[str], step: str, cutoffs: DataFrame, settings: list[tuple[int, int, int]]) -> DataFrame:
    """by, cutoff, setting (its place): event scores and the POFD of the processed alarms, for each cutoff of each forecast and each alarm setting.

    ``keys`` (with those of ``by``) tell series apart. A row has a level, the number of cutoffs it reaches, so the segments of all
    cutoffs come from one pass. They carry the positives and rows up to their ends, so what lies inside an alarm is a difference,
    and rows are joined with neither cutoffs nor alarms. All settings work on segments, in one plan.
    """
    series = [*dict.fromkeys([*keys, *by])]
    rows, cutoffs = staged(rows.select(*dict.fromkeys([*series, step, "y", "p"])), "scored"), staged(cutoffs, "cutoffs")
    lists = cutoffs.groupBy(*by).agg(F.array_sort(F.collect_list("cutoff")).alias("_c"))
    counted = running(rows, series, [step], F.floor(F.col(step) / 10_000), sums={"_y": F.col("y"), "_n": F.lit(1)})
    leveled = counted.join(lists, by).withColumn("_level", place(F.col("_c"), F.col("p")))
    runs = runs_by_level(leveled, series, step, "_level", {"_y0": F.col("_y") - F.col("y"), "_n0": F.col("_n") - 1}, {"_y1": F.col("_y"), "_n1": F.col("_n")})
    each = [*by, "cutoff", "setting"]
    options = F.array(*[F.struct(F.lit(i).alias("setting"), *[F.lit(x).alias(c) for c, x in zip(("min_run", "merge_gap", "min_length"), setting)]) for i, setting in enumerate(settings)])
    named = runs.join(lists, by).withColumn("cutoff", F.get("_c", F.col("level") - 1)).drop("_c", "level").withColumn("_o", F.explode(options)).select("*", "_o.*").drop("_o")
    among = [*dict.fromkeys([*series, "cutoff", "setting", "min_run", "merge_gap", "min_length"])]
    carried = {"_y0": F.min, "_n0": F.min, "_y1": F.max, "_n1": F.max}
    done = staged(postprocess(named, among, F.col("min_run"), F.col("merge_gap"), F.col("min_length"), carried), "processed")
    known = cutoffs.select(*by, "cutoff", F.explode(F.array(*[F.lit(i) for i in range(len(settings))])).alias("setting"))
    truth = staged(alarm_segments(rows, series, step, F.col("y") == 1), "truth")
    matches = match_events(truth, done, [*dict.fromkeys([*series, *each])])
    inside = F.col("_y1") - F.col("_y0")
    false = done.groupBy(*each).agg(F.sum(F.col("_n1") - F.col("_n0") - inside).alias("_fp"))
    total = rows.groupBy(*by).agg(F.sum(1 - F.col("y")).alias("_neg"))
    scores = event_scores(truth, done, matches, each, known).join(false, each, "left").join(total, by)
    return scores.withColumn("event_pofd", F.try_divide(F.coalesce("_fp", F.lit(0)), F.col("_neg"))).drop("_fp", "_neg")


def event_operating_point(points: DataFrame, by: list[str], max_pofd: float, pod_floor: float) -> DataFrame:
    """The operating point of each forecast, with ``tier``.

    0: the highest event CSI (then POD, then the lowest POFD) among those with POFD within the cap. Where there is none, 1: the
    lowest POFD (then the highest F1, then POD) among those with an event POD from the floor on. Where there is none, 2: the same
    of all. Ties go to the lowest cutoff and the first setting.
    """
    tier = F.when(F.coalesce(F.col("event_pofd") <= max_pofd, F.lit(False)), 0).when(F.coalesce(F.col("event_pod") >= pod_floor, F.lit(False)), 1).otherwise(2)
    capped = F.col("tier") == 0
    first = F.when(capped, -F.col("event_csi")).otherwise(F.col("event_pofd"))
    second = F.when(capped, -F.col("event_pod")).otherwise(-F.col("event_f1"))
    third = F.when(capped, F.col("event_pofd")).otherwise(-F.col("event_pod"))
    return first_row(points.withColumn("tier", tier), by, F.col("tier"), *[c.asc_nulls_last() for c in (first, second, third)], F.col("cutoff"), F.col("setting"))


def lead_times(onsets: DataFrame, alarms: DataFrame, keys: list[str], step: str, onset: str, horizon: int) -> DataFrame:
    """Each onset with the first alarm in the ``horizon`` steps before it, if any, and the lead."""
    spread = onsets.withColumn("_b", F.explode(F.array(F.floor((F.col(onset) - horizon) / horizon), F.floor((F.col(onset) - 1) / horizon))))
    spread = spread.dropDuplicates([*keys, onset, "_b"])
    a = alarms.select(*keys, F.col(step).alias("_t"), F.floor(F.col(step) / horizon).alias("_b"))
    inside = (F.col("_t") >= F.col(onset) - horizon) & (F.col("_t") < F.col(onset))
    first = spread.join(a, [*keys, "_b"]).where(inside).groupBy(*keys, onset).agg(F.min("_t").alias("first_alarm"))
    return onsets.join(first, [*keys, onset], "left").withColumn("lead", F.col(onset) - F.col("first_alarm")).withColumn("detected", F.col("first_alarm").isNotNull())


# Losses, means, ranks


def losses(df: DataFrame, by: list[str], eps: float = 1e-7) -> DataFrame:
    """Mean cross entropy, and with positives weighted by negatives over positives."""
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    ones, zeros = F.sum(F.when(F.col("y") == 1, -F.log(p)).otherwise(0.0)), F.sum(F.when(F.col("y") == 0, -F.log(1 - p)).otherwise(0.0))
    g = df.groupBy(*by).agg(ones.alias("_a"), zeros.alias("_b"), F.sum("y").alias("_p"), F.count("*").alias("_n"))
    weight = (F.col("_n") - F.col("_p")) / F.greatest(F.col("_p"), F.lit(1))
    return g.select(*by, ((F.col("_a") + F.col("_b")) / F.col("_n")).alias("bce"), ((F.col("_a") * weight + F.col("_b")) / F.col("_n")).alias("weighted_bce"))


def monotonicity_penalty(df: DataFrame, sample: list[str], threshold: str) -> Column | DataFrame:
    """One row: the mean square by which a higher threshold's probability exceeds the one below it."""
    w = Window.partitionBy(*sample).orderBy(threshold)
    rise = F.greatest(F.lit(0.0), F.col("p") - F.lag("p").over(w))
    return df.select(rise.alias("_r"), F.lag("p").over(w).isNotNull().alias("_ok")).where("_ok").agg(F.avg(F.col("_r") * F.col("_r")).alias("penalty"))


def forecast_objective(peak: DataFrame, onset: DataFrame, by: list[str], sample: list[str], threshold: str, onset_weight: float, monotonicity_weight: float) -> DataFrame:
    """One row: the weighted cross entropy of peaks and of onsets (means over the forecasts), the monotonicity penalty of peaks, and their weighted sum."""
    a = losses(peak, by).agg(F.avg("weighted_bce").alias("peak_bce"))
    b = losses(onset, by).agg(F.avg("weighted_bce").alias("onset_bce"))
    parts = a.crossJoin(b).crossJoin(monotonicity_penalty(peak, sample, threshold))  # one row each
    return parts.withColumn("objective", F.col("peak_bce") + onset_weight * F.col("onset_bce") + monotonicity_weight * F.coalesce("penalty", F.lit(0.0)))


def fit_temperature(df: DataFrame, by: list[str], low: float = 0.05, high: float = 20.0, points: int = 41, rounds: int = 3) -> DataFrame:
    """by, temperature: the T that minimises the cross entropy of sigmoid(z / T); 1 where there is one class only.

    Each round is one pass that sums the losses of a grid of T for each row, all at once, then refines the grid around the best.
    """
    grids = df.groupBy(*by).agg(F.min("y").alias("_lo"), F.max("y").alias("_hi")).select(*by, (F.col("_lo") < F.col("_hi")).alias("_two"), F.log(F.lit(low)).alias("_a"), F.log(F.lit(high)).alias("_b"))
    grids = staged(grids, "temperatures")
    width = (F.col("_b") - F.col("_a")) / (points - 1)
    for _ in range(rounds):
        tried = [F.col("_a") + (F.col("_b") - F.col("_a")) * i / (points - 1) for i in range(points)]

        def loss(t: Column) -> Column:
            z = F.col("z") / F.exp(t)
            return F.sum(F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z))))

        summed = df.join(grids, by).groupBy(*by, "_two", "_a", "_b").agg(F.array(*map(loss, tried)).alias("_l"))
        best = F.array_min(F.arrays_zip("_l", F.array(*tried).alias("_t")))["_t"]
        found = summed.withColumn("_m", best)
        grids = found.select(*by, "_two", F.greatest(F.col("_m") - width, F.log(F.lit(low))).alias("_a"), F.least(F.col("_m") + width, F.log(F.lit(high))).alias("_b"), "_m")
        grids = staged(grids, "temperatures")
    return grids.select(*by, F.when(F.col("_two"), F.exp("_m")).otherwise(F.lit(1.0)).alias("temperature"))
