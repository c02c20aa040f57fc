"""Reports that are asked for again and again: missing values, checks of resampling, weights of classes, choices of epochs and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_counts(df: DataFrame, names: list[str], step: str) -> DataFrame:
    """feature, missing, ratio, first_missing (its step): one pass over all columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("_m")) for c in names])).alias("v")
    long = df.select(step, cells).select(step, "v.*")
    return long.groupBy("feature").agg(F.count_if("_m").alias("missing"), F.avg(F.col("_m").cast("int")).alias("ratio"), F.min(F.when(F.col("_m"), F.col(step))).alias("first_missing"))


def missing_ratio(raw: DataFrame, raw_value: str, grid: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n_raw, raw_missing, n_grid, grid_missing, grid_ratio: rows and missing values before and after a table is put on a grid.

    Groups of either table have a row; what the other one lacks counts as 0 rows.
    """
    a = raw.groupBy(*by).agg(F.count("*").alias("n_raw"), F.count_if(F.col(raw_value).isNull()).alias("raw_missing"))
    b = grid.groupBy(*by).agg(F.count("*").alias("n_grid"), F.count_if(F.col(value).isNull()).alias("grid_missing"))
    both = a.join(b, by, "full").na.fill(0, ["n_raw", "raw_missing", "n_grid", "grid_missing"])
    return both.withColumn("grid_ratio", F.try_divide("grid_missing", "n_grid"))


def resampling_check(grid: DataFrame, samples: DataFrame, keys: list[str], value: str, sample_value: str, *tie: Column, tolerance: float = 1e-6) -> DataFrame:
    """keys, value, n_samples, matches: each step with its value made again from the samples, the one of the largest magnitude, then by ``tie``.

    Steps without samples match if they have no value. Samples of steps that the grid lacks are rows too, which don't match unless
    they have no value either.
    """
    best = F.min_by(F.col(sample_value), F.struct(-F.abs(F.col(sample_value)), *tie))
    again = samples.groupBy(*keys).agg(best.alias("_again"), F.count("*").alias("n_samples"))
    both = grid.select(*keys, value).join(again, keys, "full")
    ok = F.coalesce(F.abs(F.col(value) - F.col("_again")) <= tolerance, F.col(value).isNull() & F.col("_again").isNull())
    return both.select(*keys, value, F.coalesce("n_samples", F.lit(0)).alias("n_samples"), ok.alias("matches"))


def class_weights(rows: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """by, n, positives, weight: negatives over positives. A forecast without positives is an error, or with ``strict`` off weighs all its negatives."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    if strict:
        named = F.concat(F.lit("no positives in "), F.to_json(F.struct(*by)))
        g = g.where(F.assert_true(F.col("positives") > 0, named).isNull())
    return g.withColumn("weight", (F.col("n") - F.col("positives")) / F.greatest("positives", F.lit(1)))


def best_epoch(losses: DataFrame, by: list[str], epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """by, epoch, loss: the epoch of the lowest loss, the first one of equal ones; losses that are null or not a number don't count."""
    known = losses.where(F.col(loss).isNotNull() & ~F.isnan(F.col(loss)))
    return known.groupBy(*by).agg(F.min_by(epoch, F.struct(loss, epoch)).alias(epoch), F.min(loss).alias(loss))


def weighted_score(scores: DataFrame, value: str, weight: Column) -> DataFrame:
    """One row: the mean of a score over forecasts by their weights, of those that have one, and the best score. Weights of 0 or less, or null, don't count."""
    w = F.when((weight > 0) & F.col(value).isNotNull(), weight)
    return scores.agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("score"), F.max(value).alias(f"best_{value}"))


def config_comparison(scores: DataFrame, counts: DataFrame, settings: list[str]) -> DataFrame:
    """The scores of each setting with its numbers of valid samples; settings without scores, or without counts, have a row too."""
    return scores.join(counts, settings, "full")


def wide_probabilities(scores: DataFrame, sample: list[str], thresholds: list[int]) -> DataFrame:
    """One row per sample with p_<threshold>, null where a forecast is missing."""
    return scores.groupBy(*sample).agg(*[F.max(F.when(F.col("threshold") == t, F.col("p"))).alias(f"p_{t}") for t in thresholds])
