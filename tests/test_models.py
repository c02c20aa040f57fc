"""Moments, screens, scalers and logistic models of folds against plain numpy, and the table of test predictions against loops."""

import math
import random

import numpy as np
import pytest
from leadtime.operators import events, model, select
from leadtime.operators.moments import group_moments
from pyspark.sql import functions as F

NAMES = ["a", "b", "c", "flat", "rare"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    rows = []
    for fold in (1, 2):
        for h in range(150):
            a = rng.gauss(1000, 2)
            b = rng.gauss(0, 1) if rng.random() < 0.8 else None
            rows.append((fold, h, a, b, 2 * a + rng.gauss(0, 0.05 * fold), 5.0, 1.0 if h == 3 else None, rng.choice([float("nan"), 1.0, 2.0]), int(rng.random() < 1 / (1 + math.exp(-(a - 1000) + 0.5)))))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "fold int, h int, a double, b double, c double, flat double, rare double, nan double, y int").withColumn("threshold", F.lit(1))


def test_screens_of_all_folds(frame):
    found = group_moments(frame, "fold", NAMES)
    for fold in (1, 2):
        assert found[fold].keep() == select.feature_filter(frame.where(F.col("fold") == fold), NAMES)
        assert found[fold].keep(limit=2.0) == ["a", "b", "c"]


def test_scaler_on_rows_with_all_sequence_features(frame, data):
    mean, deviation = group_moments(frame, "fold", ["a", "b", "c", "flat", "nan"], ["a", "b"])[2].scale()
    whole = [r for r in data if r[0] == 2 and r[3] is not None]
    for name, at in (("a", 2), ("b", 3), ("c", 4), ("nan", 7)):
        x = np.array([r[at] for r in whole], float)
        assert mean[name] == pytest.approx(np.nanmean(x)) and deviation[name] == pytest.approx(np.nanstd(x))
    assert deviation["flat"] == 1


def test_models_minimise_the_loss(frame, data):
    models = model.fit_folds(frame.withColumn("role", F.lit("train")), ["a", "b"], penalty=0.01)
    for m in models:
        rows = [(r[2], r[3], r[8]) for r in data if r[0] == m.fold and r[3] is not None]
        x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
        mean, scale = x.mean(axis=0), x.std(axis=0)
        every = [r[8] for r in data if r[0] == m.fold]
        w = np.where(y == 1, (len(every) - sum(every)) / sum(every), 1.0)

        def loss(b, x=(x - mean) / scale, y=y, w=w):
            z = b[0] + x @ b[1:]
            return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum() + 0.005 * (b[1:] ** 2).sum()

        weights = np.array(m.model.weights) * scale
        best = np.r_[m.model.intercept + np.array(m.model.weights) @ mean, weights]
        for i in range(3):
            for d in (-1e-3, 1e-3):
                assert loss(best) < loss(best + d * np.eye(3)[i])


def test_one_class_is_an_error(frame):
    ready = frame.withColumn("role", F.lit("train")).withColumn("y", F.lit(0))
    with pytest.raises(ValueError, match="0 of 150"):
        model.fit_folds(ready, ["a"])
    assert [m.model for m in model.fit_folds(ready, ["a"], one_class=True)] == [None, None]


def test_prediction_table(spark):
    rng = random.Random(8)
    scores = [(s, t, 2 * h, int(rng.random() < 0.3), round(rng.random(), 3)) for s in "ab" for t in (1, 2) for h in range(60)]
    points = [(1, 0.5, 2, 1, 3), (2, 0.7, 1, 0, 1)]
    spans = [("a", 1, 10, 40), ("a", 12, 38, 60), ("b", 2, -5, 3)]
    table = events.prediction_table(
        spark.createDataFrame(scores, "series string, threshold int, h bigint, y int, p double"), "h", spark.createDataFrame(points, "threshold int, cutoff double, min_run int, merge_gap int, min_length int"),
        ["series"], ["threshold"], spark.createDataFrame(spans, "series string, event_id int, start bigint, end bigint"), 7, 2,
    )
    want = []
    for s in "ab":
        for t, cutoff, least, gap, length in points:
            p = [r[4] for r in scores if r[:2] == (s, t)]
            runs, start = [], None
            for i, x in enumerate([*p, -1]):
                if x >= cutoff and start is None:
                    start = i
                if x < cutoff and start is not None:
                    runs.append([start, i - 1])
                    start = None
            merged = []
            for a, b in (r for r in runs if r[1] - r[0] + 1 >= least):
                if merged and a - merged[-1][1] - 1 <= gap:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            on = {i for a, b in merged if b - a + 1 >= length for i in range(a, b + 1)}
            for i, r in enumerate(x for x in scores if x[:2] == (s, t)):
                ids = ",".join(str(e) for k, e, a, b in spans if k == s and a <= r[2] < b)
                want.append((s, t, r[2], r[3], r[4], cutoff, int(r[4] >= cutoff), int(i in on), ids))
    assert sorted(map(tuple, table.collect())) == sorted(want)
