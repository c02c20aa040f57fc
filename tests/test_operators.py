"""Rules of the operators on small frames, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from leadtime.functions import clean, times
from leadtime.operators import align, blocks, islands, model, select, spine, validate, verify
from leadtime.operators import windows as w


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def grid(spark, values, series="a"):
    return spark.createDataFrame([(series, i, None if v is None else float(v)) for i, v in enumerate(values)], "series string, h bigint, x double")


def test_argmax_keeps_sign_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", 0, -3.2, 1), ("a", 0, 3.2, 2), ("a", 1, 1.0, 1), ("a", 1, None, 2), ("a", 2, None, 1)], "s string, h int, v double, line int")
    assert rows(spine.resample_argmax(df, ["s", "h"], "v", -F.col("line")), "h", "v") == [(0, -3.2), (1, 1.0), (2, None)]


def test_future_peak_needs_all_steps(spark):
    df = w.chunked(grid(spark, [1, -5, 2, None, 4, 1, 1]), ["series"], "h", 0, 2, lambda o: {"peak": w.future_peak(F.col("x"), o, 2)})
    assert rows(df, "h", "peak") == [(0, 5.0), (1, None), (2, None), (3, 4.0), (4, 1.0), (5, None), (6, None)]


@pytest.mark.parametrize("chunk", [5, 7, 1000])
def test_chunks_with_halos_equal_one_partition(spark, chunk):
    values = [((i * 37) % 11) - 5 if i % 6 else None for i in range(60)]
    make = lambda o: {"p": w.future_peak(F.col("x"), o, 3), "m": w.full(F.avg, F.col("x"), o, -2, 0), "d": w.delta(F.col("x"), o, 4)}
    a = w.chunked(grid(spark, values), ["series"], "h", 4, 3, make, chunk_steps=chunk)
    b = w.chunked(grid(spark, values), ["series"], "h", 4, 3, make, block=[])
    assert rows(a, "h", "p", "m", "d") == rows(b, "h", "p", "m", "d")


def test_onset_needs_both_steps_observed(spark):
    df = w.chunked(grid(spark, [9, 1, 9, 9, None, 9, 1, -9]), ["series"], "h", 1, 0, lambda o: {"on": w.onset(F.col("x"), o, 5)})
    assert [r[1] for r in rows(df, "h", "on")] == [0, 0, 1, 0, 0, 0, 0, 1]


def test_duration_counts_missing_as_zero(spark):
    df = w.chunked(grid(spark, [1, None, 2, -1, 3]), ["series"], "h", 2, 0, lambda o: {"n": w.duration_above(F.col("x"), o, 3)})
    assert [r[1] for r in rows(df, "h", "n")] == [None, None, 2, 1, 2]


@pytest.mark.parametrize("chunk", [2, 3, 1000])
def test_islands_stitch_over_chunks(spark, chunk):
    df = grid(spark, [None, None, 1, None, None, None, None, None, 2, None])
    got = islands.islands(df, ["series"], "h", F.col("x").isNull(), chunk_steps=chunk)
    assert rows(got, "first", "last", "n") == [(0, 1, 2), (3, 7, 5), (9, 9, 1)]


def test_touching_intervals_do_not_merge(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 15, 18), (4, 19, 30)], "event_id int, start int, end int")
    assert rows(islands.merge_intervals(df, [], "start", "end", "event_id"), "event_id", "block") == [(1, 1), (2, 2), (3, 2), (4, 2)]


def test_nines(spark):
    cells = ["99.9", "9999", "9.9", "999", "999.0", "399", "-99.99", '"9999"', "9.99e5", None, ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = dict(rows(df.select("c", clean.repeated_nines(F.col("c")).alias("n")), "c", "n"))
    assert got["99.9"] and got["9999"] and got["-99.99"] and got['"9999"']
    assert not (got["9.9"] or got["999"] or got["999.0"] or got["399"] or got[""])


def test_numbers_are_plain(spark):
    df = spark.createDataFrame([("1d",), ("nan",), (" 2.5 ",), ("1e3",), ("abc",), (None,)], "c string")
    assert [r[0] for r in df.select(clean.number(F.col("c"))).collect()] == [None, None, 2.5, 1000.0, None, None]


def test_times_out_of_range_are_null(spark):
    df = spark.createDataFrame([(2013, 2, 30, 0, 0, 0.0), (2013, 6, 7, 24, 0, 0.0), (2013, 6, 7, 1, 2, 3.5)], "y int, m int, d int, h int, mi int, s double")
    got = [r[0] for r in df.select(times.from_parts(*[F.col(c) for c in df.columns]).cast("string")).collect()]
    assert got == [None, None, "2013-06-07 01:02:03.5"]


def test_axis_report(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 3), ("a", 9)], "s string, h bigint")
    r = validate.axis_report(df, ["s"], "h", 0, 4).first()
    assert (r.n_rows, r.n_expected, r.n_duplicate, r.n_missing, r.first_missing, r.n_extra, r.first_extra, r.exact) == (5, 5, 2, 2, 2, 1, 9, False)
    with pytest.raises(Exception, match="check failed"):
        validate.require(validate.axis_report(df, ["s"], "h", 0, 4), "exact").collect()


def test_require_columns(spark):
    with pytest.raises(ValueError, match="missing columns: z"):
        validate.require_columns(spark.range(1), ["id", "z"])


def test_nearest_tie_goes_back(spark):
    obs = spark.createDataFrame([("a", 0, 50, 100.0), ("a", 0, 150, 100.0), ("a", 1, 400, 100.0)], "s string, segment int, t bigint, reach double")
    assert rows(align.nearest_in_segments(obs, ["s"], "t", "segment", 100, "reach"), "target", "t") == [(0, 50), (100, 50), (400, 400)]


def test_split_keeps_a_block_each(spark):
    b = spark.createDataFrame([(i, i, n) for i, n in enumerate([10, 1, 1])], "block int, start int, n_events int")
    assert rows(blocks.split_blocks(b), "block", "split") == [(0, "train"), (1, "validation"), (2, "test")]


def test_folds_expand(spark):
    b = spark.createDataFrame([(i, i) for i in range(11)], "block int, start int")
    got = blocks.forward_folds(b, 3, 0.0)
    assert sorted(r.block for r in got.where("fold = 1 and role = 'validation'").collect()) == [1, 2, 3, 4]
    assert got.where("fold = 3 and role = 'train'").count() == 8
    assert got.where("role = 'validation'").count() == 10


def predictions(spark, pairs):
    return spark.createDataFrame([("t", i, int(y), float(p)) for i, (y, p) in enumerate(pairs)], "threshold string, h bigint, y int, p double")


def test_scores_by_hand(spark):
    df = predictions(spark, [(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)])
    r = verify.skill_scores(df, ["threshold"], F.lit(0.5)).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.pod, r.far, r.csi, r.bias) == (1, 1, 1, 1, 0.5, 0.5, pytest.approx(1 / 3, rel=1e-12), 1.0)
    assert verify.roc_auc(df, ["threshold"]).first().roc_auc == 0.75
    assert verify.average_precision(df, ["threshold"]).first().pr_auc == pytest.approx((1 + 2 / 3) / 2, rel=1e-12)


def test_ratios_are_null_on_zero_denominators(spark):
    df = predictions(spark, [(0, 0.1), (0, 0.2)])
    r = verify.skill_scores(df, ["threshold"], F.lit(0.5)).first()
    assert r.pod is None and r.far is None and r.csi is None and r.pofd == 0
    assert verify.roc_auc(df, ["threshold"]).first().roc_auc is None


def test_sweep_counts_add_up(spark):
    df = predictions(spark, [(i % 3 == 0, (i * 7 % 20) / 20) for i in range(40)])
    sweep = verify.cutoff_sweep(df, verify.candidate_cutoffs(df, ["threshold"], 5), ["threshold"])
    assert {r.tp + r.fp + r.fn + r.tn for r in sweep.collect()} == {40}


def test_postprocess_identity_and_merge(spark):
    seg = spark.createDataFrame([("a", 0, 1, 2), ("a", 4, 4, 1), ("a", 9, 12, 4)], "k string, first bigint, last bigint, n bigint")
    assert rows(verify.postprocess(seg, ["k"], 1, 0, 1), "first", "last") == [(0, 1), (4, 4), (9, 12)]
    assert rows(verify.postprocess(seg, ["k"], 1, 2, 3), "first", "last") == [(0, 4), (9, 12)]


def test_match_is_greedy_in_alarm_order(spark):
    truth = spark.createDataFrame([("a", 5, 8), ("a", 10, 20)], "k string, first bigint, last bigint")
    alarms = spark.createDataFrame([("a", 6, 11), ("a", 7, 12), ("a", 30, 31)], "k string, first bigint, last bigint")
    assert rows(verify.match_events(truth, alarms, ["k"]), "alarm_first", "truth_first") == [(6, 5), (7, 10)]


def test_lead_time(spark):
    onsets = spark.createDataFrame([("a", 10), ("a", 20)], "k string, onset bigint")
    alarms = spark.createDataFrame([("a", 3), ("a", 4), ("a", 9), ("a", 20)], "k string, t bigint")
    got = verify.lead_times(onsets, alarms, ["k"], "t", "onset", 6)
    assert rows(got, "onset", "first_alarm", "lead") == [(10, 4, 6), (20, None, None)]


def test_feature_filter_drops_copies(spark):
    df = spark.createDataFrame([(float(i), float(2 * i + 1), 7.0, float((i * 7) % 5)) for i in range(30)], "a double, b double, c double, d double")
    assert select.feature_filter(df, ["a", "b", "c", "d"]) == ["a", "d"]


def test_fold_scores_rank_the_signal(spark):
    data = [(b, i, int((i * 13) % 10 > 4), float((i * 13) % 10)) for b in range(4) for i in range(40)]
    df = spark.createDataFrame(data, "block int, h int, y int, f double").withColumn("threshold", F.lit(1))
    folds = spark.createDataFrame([(1, 0, "train"), (1, 1, "validation"), (2, 0, "train"), (2, 1, "train"), (2, 2, "validation")], "fold int, block int, role string")
    out = model.fold_scores(df, folds, ["f"], "block", ["block", "h"])
    assert out.count() == 80 and verify.roc_auc(out, ["fold"]).agg(F.min("roc_auc")).first()[0] == 1.0


def test_models_of_folds_on_new_rows(spark):
    data = [(b, i, int((i * 13) % 10 > 4), float((i * 13) % 10), 2.0 * ((i * 13) % 10), 1.0) for b in range(4) for i in range(40)]
    df = spark.createDataFrame(data, "block int, h int, y int, f double, copy double, flat double").withColumn("threshold", F.lit(1))
    folds = spark.createDataFrame([(1, 0, "train"), (1, 1, "validation"), (2, 0, "train"), (2, 1, "train"), (2, 2, "validation")], "fold int, block int, role string")
    ready = model.fold_rows(df, folds, "block")
    models = model.fit_folds(ready, ["f", "copy", "flat"])
    assert [m.model.features for m in models] == [["f"], ["f"]]
    test = df.where("block = 3")
    single = [{r.h: r.p for r in model.score(test, m, ["h"]).collect()} for m in models]
    mean = {r.h: (r.p, r.n_folds) for r in model.mean_scores(test, models, ["block", "h"]).collect()}
    assert len(mean) == 40 and all(mean[h] == (pytest.approx((single[0][h] + single[1][h]) / 2), 2) for h in mean)
    one = model.score(test, model.Fitted(1, 1, None, 0.25), ["h"]).first()
    assert one.p == 0.25 and one.z == pytest.approx(-1.0986123)


def test_a_sample_of_two_folds_is_an_error(spark):
    ok = spark.createDataFrame([(1, 1, 5, 1, 0.2), (1, 1, 6, 0, 0.1), (2, 2, 5, 0, 0.4)], "h int, fold int, threshold int, y int, p double")
    assert rows(model.out_of_fold(ok, ["h"], [5, 6]), "h", "fold", "y_5", "p_5", "y_6", "p_6") == [(1, 1, 1, 0.2, 0, 0.1), (2, 2, 0, 0.4, None, None)]
    with pytest.raises(Exception, match="two folds"):
        model.out_of_fold(ok.withColumn("h", F.lit(1)), ["h"], [5, 6]).collect()


@pytest.mark.parametrize("chunk", [3, 1000])
def test_sequences_of_all_features_with_context(spark, chunk):
    data = [(k, float(k), None if k == 5 else 10.0 * k, None if k == 2 else -k) for k in range(9)]
    df = spark.createDataFrame(data, "k bigint, a double, b double, c int")
    got = dict(rows(w.sequence_matrix(df, [], "k", ["a", "b"], ["c"], 1, 2, chunk_steps=chunk), "k", "matrix"))
    assert got[2] == [[0.0, 0.0, -1.0], [1.0, 10.0, -1.0]] and got[8] == [[6.0, 60.0, -7.0], [7.0, 70.0, -7.0]]
    assert [k for k, v in sorted(got.items()) if v is None] == [0, 1, 3, 6, 7]


@pytest.mark.parametrize("chunk,lag,length", [(5, 1, 2), (7, 3, 4), (1000, 2, 3)])
def test_matrices_at_endpoints(spark, chunk, lag, length):
    data = [(s, k, float(k) if k % 11 else None, 10.0 * k, -k if k % 13 else None, k % 3 == 0) for s in "xy" for k in range(60)]
    df = spark.createDataFrame(data, "s string, k bigint, a double, b double, c int, wanted boolean")
    all_rows = w.sequence_matrix(df, ["s"], "k", ["a", "b"], ["c"], lag, length)
    want = {(r.s, r.k): r.matrix for r in all_rows.where("wanted and matrix is not null").collect()}
    got = {(r.s, r.k): r.matrix for r in w.endpoint_matrices(df, ["s"], "k", F.col("wanted"), ["a", "b"], ["c"], lag, length, keep=["b"], chunk_steps=chunk).collect()}
    assert got == want and len(got) > 10


def test_objective_by_hand(spark):
    peak = spark.createDataFrame([("a", 1, 5, 1, 0.5), ("a", 2, 5, 0, 0.5), ("a", 1, 9, 1, 0.75), ("a", 2, 9, 0, 0.25)], "s string, h int, threshold int, y int, p double")
    onset = peak.where("threshold = 5")
    r = verify.forecast_objective(peak, onset, ["threshold"], ["s", "h"], "threshold", 0.5, 2.0).first()
    assert r.onset_bce == pytest.approx(0.6931472) and r.peak_bce == pytest.approx((0.6931472 + 0.2876821) / 2) and r.penalty == pytest.approx(0.0625 / 2)
    assert r.objective == pytest.approx(r.peak_bce + 0.5 * r.onset_bce + 2 * r.penalty)
