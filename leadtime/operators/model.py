"""Probability models of folds: logistic regressions of all folds and thresholds in the same passes, and scores of tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .moments import group_moments


class Linear(NamedTuple):
    """z is ``intercept`` plus the sum of the features by their ``weights``, in the features' own units."""

    features: list[str]
    weights: list[float]
    intercept: float


class Fitted(NamedTuple):
    """The model of a fold and threshold, or the share of positives where its training rows have one class."""

    fold: int
    threshold: Any
    model: Linear | None
    share: float

    def z(self) -> Column:
        """The logit of a row, null where it lacks a feature."""
        if self.model is None:
            share = min(max(self.share, 1e-9), 1 - 1e-9)
            return F.log(F.lit(share / (1 - share)))
        total = F.lit(float(self.model.intercept))
        for name, weight in zip(self.model.features, self.model.weights):
            total = total + F.col(name) * weight
        return total

    def p(self) -> Column:
        return F.lit(float(self.share)) if self.model is None else 1 / (1 + F.exp(-self.z()))


def fold_rows(rows: DataFrame, folds: DataFrame, block: str) -> DataFrame:
    """Each row once for each fold that has its block, with ``fold`` and ``role``."""
    return staged(rows.join(folds, block), "fold_rows")


def fit_folds(
    ready: DataFrame, features: list[str], max_iter: int = 20, limit: float = 0.95, sequence: list[str] | None = None, penalty: float = 1e-3, one_class: bool = False
) -> list[Fitted]:
    """For each fold and threshold a logistic model of its training rows; positives weigh negatives over positives.

    ``ready`` (see ``fold_rows``) has a row per sample, fold and threshold with y. Features are screened on the training rows of each
    fold, and scaled by mean and population deviation of those that have all of ``sequence`` (all features if not given); rows that
    lack a feature of their model are left out. A fold and threshold without positives is an error, and so is one without negatives,
    unless ``one_class`` lets the share of positives stand in for a model.

    The moments of all folds are one job. Newton steps follow, each one job for all models: tasks add up gradients and curvatures.
    A step that makes the loss (mean weighted cross entropy, and ``penalty`` by half the squared weights) greater is halved.
    """
    training = ready.where("role = 'train'")
    known = training.groupBy("fold", "threshold").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()  # folds x thresholds
    for k in known:
        if not 0 < k["pos"] < k["n"] and not one_class:
            raise ValueError(f"fold {k['fold']}, threshold {k['threshold']}: {k['pos']} of {k['n']} training rows are positive")
    moments = group_moments(training, "fold", features, sequence)
    kept = {fold: m.keep(limit) for fold, m in moments.items()}
    scales = {fold: m.scale() for fold, m in moments.items()}
    plans = {}
    for k in known:
        names = kept[k["fold"]]
        if 0 < k["pos"] < k["n"] and names:
            mean, deviation = ([x[c] for c in names] for x in scales[k["fold"]])
            plans[(k["fold"], k["threshold"])] = ([features.index(c) for c in names], np.array(mean), np.array(deviation), (k["n"] - k["pos"]) / k["pos"])
    weights = newton(training, features, plans, max_iter, penalty)
    out = []
    for k in sorted(known, key=lambda k: (k["fold"], k["threshold"])):
        key, model = (k["fold"], k["threshold"]), None
        if key in plans:
            at, mean, deviation, _ = plans[key]
            raw = weights[key][1:] / deviation
            model = Linear([features[i] for i in at], raw.tolist(), float(weights[key][0] - raw @ mean))
        out.append(Fitted(k["fold"], k["threshold"], model, k["pos"] / k["n"]))
    return out


def newton(training: DataFrame, features: list[str], plans: dict[tuple, tuple], max_iter: int, penalty: float) -> dict[tuple, np.ndarray]:
    """Intercept and weights (of scaled features) of each model."""
    keys = list(plans)
    beta = {key: np.zeros(1 + len(plans[key][0])) for key in keys}
    last, step, loss, open_keys = dict(beta), {}, dict.fromkeys(keys, np.inf), set(keys)
    which = F.coalesce(*[F.when((F.col("fold") == fold) & (F.col("threshold") == threshold), i) for i, (fold, threshold) in enumerate(keys)]) if keys else F.lit(None)
    rows = training.select(which.cast("int").alias("_k"), F.col("y").cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)]).where("_k is not null")
    for _ in range(max_iter if keys else 0):
        sums = {row["k"]: np.array(row["v"]) for row in newton_sums(rows, plans, beta, keys, len(features)).collect()}  # a row for each model
        for i, key in enumerate(keys):
            if key not in open_keys or i not in sums:
                continue
            d, v = len(beta[key]), sums[i]
            ridge = np.r_[0.0, np.full(d - 1, penalty)]
            now = v[1] / v[0] + (ridge * beta[key] ** 2).sum() / 2
            if now > loss[key] + 1e-12:
                step[key] = step[key] / 2
            else:
                slope, curve = v[2 : 2 + d] / v[0] + ridge * beta[key], v[2 + d :].reshape(d, d) / v[0] + np.diag(ridge)
                last[key], loss[key] = beta[key], now
                step[key] = -np.linalg.solve(curve + 1e-12 * np.eye(d), slope)
            beta[key] = last[key] + step[key]
            if np.abs(step[key]).max() < 1e-9:
                open_keys.discard(key)
        if not open_keys:
            break
    return beta


def newton_sums(rows: DataFrame, plans: dict[tuple, tuple], beta: dict[tuple, np.ndarray], keys: list[tuple], n_features: int) -> DataFrame:
    """k, v: for each model the sum of weights, the loss, its gradient and its curvature, over the rows that have its features."""
    shared = rows.sparkSession.sparkContext.broadcast([(*plans[key], beta[key]) for key in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            k, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            values = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(n_features)]).astype(float)
            for i in np.unique(k).tolist():
                at, mean, deviation, heavier, b = shared.value[i]
                x = (values[k == i][:, at] - mean) / deviation
                ok = np.isfinite(x).all(axis=1)
                x, t = np.column_stack([np.ones(ok.sum()), x[ok]]), y[k == i][ok]
                w, z = np.where(t == 1, heavier, 1.0), x @ b
                p = np.exp(-np.logaddexp(0, -z))
                flat = np.concatenate([[w.sum(), (w * (np.logaddexp(0, z) - t * z)).sum()], x.T @ (w * (p - t)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])
                sums[i] = sums[i] + flat if i in sums else flat
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["k", "v"])

    each = rows.mapInArrow(run, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"))
    return each.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


def score(rows: DataFrame, fitted: Fitted, keep: list[str | Column]) -> DataFrame:
    """keep, fold, threshold, z, p of rows of any table with the features; those that lack one are left out."""
    return rows.select(*keep, F.lit(fitted.fold).alias("fold"), F.lit(fitted.threshold).alias("threshold"), fitted.z().alias("z"), fitted.p().alias("p")).where("z is not null")


def validation_scores(ready: DataFrame, models: list[Fitted], keep: list[str]) -> DataFrame:
    """keep, fold, threshold, y, z, p: each model on the validation rows of its fold and threshold, which are read once."""
    mine = [((F.col("fold") == m.fold) & (F.col("threshold") == m.threshold), m) for m in models]
    z, p = (F.coalesce(*[F.when(here, x(m)) for here, m in mine]) for x in (Fitted.z, Fitted.p))
    return ready.where("role = 'validation'").select(*keep, "fold", "threshold", "y", z.alias("z"), p.alias("p")).where("z is not null")


def fold_scores(rows: DataFrame, folds: DataFrame, features: list[str], block: str, keep: list[str], max_iter: int = 20) -> DataFrame:
    """keep, fold, threshold, y, z, p: for each fold and threshold a logistic model of its training blocks, on its validation blocks."""
    ready = fold_rows(rows, folds, block)
    return validation_scores(ready, fit_folds(ready, features, max_iter), keep)


def mean_scores(rows: DataFrame, models: list[Fitted], sample: list[str]) -> DataFrame:
    """sample, threshold, y, p, n_folds: the rows of each threshold (such as test rows), with the mean probability of the folds' models.

    A fold whose model needs a feature that a row lacks doesn't count for it; rows without any fold are left out.
    """
    each = F.array_compact(F.array(*[F.when((F.col("threshold") == m.threshold) & m.z().isNotNull(), m.p()) for m in models]))
    made = rows.select(*sample, "threshold", "y", each.alias("_p")).where(F.size("_p") > 0)
    mean = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) / F.size("_p")
    return made.select(*sample, "threshold", "y", mean.alias("p"), F.size("_p").cast("bigint").alias("n_folds"))


def out_of_fold(scores: DataFrame, sample: list[str], thresholds: list[int]) -> DataFrame:
    """One row per sample: y_<t> and p_<t> of the fold that validates it. A sample of two folds is an error."""
    wide = scores.groupBy(*sample).agg(
        F.min("fold").alias("fold"), F.max("fold").alias("_last"), *[F.max(F.when(F.col("threshold") == t, F.col(c))).alias(f"{c}_{t}") for t in thresholds for c in ("y", "p")]
    )
    return wide.where(F.assert_true(F.col("fold") == F.col("_last"), F.lit("a sample is validated by two folds")).isNull()).drop("_last")
