"""Report operators by hand: missing values, resampling checks, class weights, epochs, scores, column names."""

import pytest
from leadtime.functions import clean
from leadtime.operators import blocks, reports
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_missing_counts(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 2.0, 5.0), (4, None, 1.0)], "k int, a double, b double")
    assert rows(reports.missing_counts(df, ["a", "b"], "k"), "feature", "missing", "ratio", "first_missing") == [("a", 2, 0.5, 2), ("b", 2, 0.5, 1)]


def test_missing_ratio_of_both_tables(spark):
    raw = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 2.0)], "s string, v double")
    grid = spark.createDataFrame([("x", None), ("x", 1.0), ("x", 1.0), ("z", None)], "s string, g double")
    found = rows(reports.missing_ratio(raw, "v", grid, "g", ["s"]), "s", "n_raw", "raw_missing", "n_grid", "grid_missing", "grid_ratio")
    assert found == [("x", 2, 1, 3, 1, pytest.approx(1 / 3)), ("y", 1, 0, 0, 0, None), ("z", 0, 0, 1, 1, 1.0)]


def test_resampling_check_sees_samples_outside_the_grid(spark):
    samples = spark.createDataFrame([(0, 1.0, 1), (0, -2.0, 2), (0, 2.0, 3), (1, 4.0, 4), (9, 5.0, 5), (8, None, 6)], "h int, value double, id int")
    grid = spark.createDataFrame([(0, -2.0), (1, 4.5), (2, None), (3, 1.0)], "h int, x double")
    found = rows(reports.resampling_check(grid, samples, ["h"], "x", "value", F.col("id")), "h", "x", "n_samples", "matches")
    assert found == [(0, -2.0, 3, True), (1, 4.5, 1, False), (2, None, 0, True), (3, 1.0, 0, False), (8, None, 1, True), (9, None, 1, False)]


def test_class_weights(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (2, 0)], "t int, y int")
    with pytest.raises(Exception, match="no positives in"):
        reports.class_weights(df, ["t"]).collect()
    assert rows(reports.class_weights(df, ["t"], strict=False), "t", "n", "positives", "weight") == [(1, 3, 1, 2.0), (2, 1, 0, 1.0)]


def test_best_epoch_takes_the_first_of_equal_losses(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.2), ("a", 3, 0.2), ("a", 4, None), ("a", 5, float("nan")), ("b", 7, 1.0)], "m string, epoch int, loss double")
    assert rows(reports.best_epoch(df, ["m"]), "m", "epoch", "loss") == [("a", 2, 0.2), ("b", 7, 1.0)]


def test_weighted_score(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, None), (4, 0.9)], "t int, csi double")
    weight = F.element_at(F.create_map(*[F.lit(x) for x in (1, 1.0, 2, 3.0, 3, 5.0, 4, 0.0)]), F.col("t"))
    assert rows(reports.weighted_score(df, "csi", weight), "score", "best_csi") == [(pytest.approx(3.5 / 4), 1.0)]


def test_comparison_and_wide_probabilities(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.6)], "lag int, csi double")
    counts = spark.createDataFrame([(2, 10), (3, 20)], "lag int, n int")
    assert rows(reports.config_comparison(scores, counts, ["lag"]), "lag", "csi", "n") == [(1, 0.5, None), (2, 0.6, 10), (3, None, 20)]
    p = spark.createDataFrame([(1, 50, 0.5), (1, 100, 0.25), (2, 50, 0.75)], "h int, threshold int, p double")
    assert rows(reports.wide_probabilities(p, ["h"], [50, 100]), "h", "p_50", "p_100") == [(1, 0.5, 0.25), (2, 0.75, None)]


def test_a_block_of_two_splits_is_an_error(spark):
    once = spark.createDataFrame([(i, i, 1) for i in range(1, 6)], "block int, start int, n_events int")
    assert blocks.forward_folds(once).count() > 0
    with pytest.raises(Exception, match="there twice"):
        blocks.forward_folds(once.unionByName(once.where("block = 2"))).collect()


def test_names_of_solar_wind_columns():
    aliases = {"Btot": ["btot"], "Bx_gse": ["bx"], "By_gse": ["by"], "Vp": ["vp"], "Np": ["np", "density"]}
    found = clean.standard_names(["B (nT)", "By GSE x nT", "proton speed km/s", "flag_sw_speed", "H density 1/cc", "bx"], aliases, like=clean.SOLAR_WIND)
    assert found == {"B (nT)": "Btot", "bx": "Bx_gse", "By GSE x nT": "By_gse", "proton speed km/s": "Vp", "H density 1/cc": "Np"}
    assert clean.standard_names(["ion density", "np_raw", "Np"], aliases, like=clean.SOLAR_WIND) == {}
    assert clean.standard_names(["density_flag", "sw density"], aliases, like=clean.SOLAR_WIND) == {"sw density": "Np"}
    assert clean.standard_names(["my density"], aliases) == {"my density": "Np"}
