"""Checks that a pipeline relies on, as tables that a caller can read or fail on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only these columns; an error that names the missing ones."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def require(report: DataFrame, ok: str) -> DataFrame:
    """The report, failing on execution if a row's ``ok`` column is not true."""
    checked = F.assert_true(F.coalesce(F.col(ok), F.lit(False)), F.concat(F.lit("check failed: "), F.to_json(F.struct(*report.columns))))
    return report.where(checked.isNull())


def axis_report(df: DataFrame, keys: list[str], step: str, first: int, last: int, stored: Column | None = None, chunk: int = 100_000) -> DataFrame:
    """For each series: rows, expected rows, rows with a repeated step, missing and extra steps, the first of each, exact.

    ``stored`` is the order in which rows are stored, for the monotone flag; by default that of the steps. It is gone through
    in ranges of ``chunk`` units.
    """
    stored = F.col(step) if stored is None else stored
    inside = F.col(step).between(first, last)
    counted = df.groupBy(*keys, step).agg(F.count("*").alias("_n"))
    per_step = counted.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("n_duplicate"), F.count_if(inside).alias("_inside"),
        F.count_if(~inside).alias("n_extra"), F.min(F.when(~inside, F.col(step))).alias("first_extra"),
    )
    known = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))).alias(step))
    absent = known.join(counted, [*keys, step], "left_anti").groupBy(*keys).agg(F.count("*").alias("n_missing"), F.min(step).alias("first_missing"))
    seen = running(df.select(*keys, step, stored.alias("_at")), keys, ["_at"], F.floor(F.col("_at") / chunk), maxima={"_before": F.col(step)}, before=True)
    monotone = seen.groupBy(*keys).agg((F.count_if(F.col(step) < F.col("_before")) == 0).alias("monotone"))
    out = per_step.join(absent, keys, "left").join(monotone, keys)
    n_missing = F.coalesce("n_missing", F.lit(0))
    return out.select(
        *keys, "n_rows", F.lit(last - first + 1).cast("bigint").alias("n_expected"), "n_duplicate", n_missing.alias("n_missing"), "first_missing", "n_extra", "first_extra", "monotone",
        ((n_missing == 0) & (F.col("n_extra") == 0) & (F.col("n_duplicate") == 0)).alias("exact"),
    )


def row_count(df: DataFrame, expected: int) -> DataFrame:
    """One row: n_rows, n_expected, ok; to be read, or failed on by ``require``."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(expected).cast("bigint").alias("n_expected"), (F.col("n_rows") == expected).alias("ok"))


def covered(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each group of ``keys`` with its number of rows and ``ok``, false where it has none."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    found = groups.select(*keys).join(counted, keys, "left").na.fill(0, ["n_rows"])
    return found.withColumn("ok", F.col("n_rows") > 0)


def axes_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: steps only in either table, repeated steps of each, and whether a one-to-one join is safe."""

    def side(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        g = x.groupBy(*keys).agg(F.count("*").alias("n"))
        marked = g.join(y.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
        return marked.agg(F.count_if(F.col("_there").isNull()).alias(f"only_{name}"), F.count_if(F.col("n") > 1).alias(f"repeated_{name}"))

    both = side(a, b, "a").withColumn("_k", F.lit(1)).join(side(b, a, "b").withColumn("_k", F.lit(1)), "_k").drop("_k")
    total = sum((F.col(c) for c in ("only_a", "repeated_a", "only_b", "repeated_b")), F.lit(0))
    return both.withColumn("aligned", total == 0)


def split_integrity(rows: DataFrame, group: str, split: str, known: list[str]) -> DataFrame:
    """One row: rows without group or split, rows of unknown splits, groups in more than one split."""
    per_group = rows.groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n"), F.count_if(F.col(split).isNull()).alias("n_null"), F.count_if(~F.col(split).isin(*known)).alias("n_unknown"))
    null_group = F.when(F.col(group).isNull(), F.col("n")).otherwise(F.col("n_null"))
    return per_group.agg(F.sum(null_group).alias("n_null"), F.sum("n_unknown").alias("n_unknown"), F.count_if(F.col("n_splits") > 1).alias("n_torn_groups"))


def fold_integrity(rows: DataFrame, sample: list[str], fold: str, label: str) -> DataFrame:
    """One row: samples that more than one fold validates, samples whose label differs between folds."""
    g = rows.groupBy(*sample).agg(F.countDistinct(fold).alias("n_folds"), F.countDistinct(label).alias("n_labels"))
    return g.agg(F.count("*").alias("n_samples"), F.count_if(F.col("n_folds") > 1).alias("n_shared"), F.count_if(F.col("n_labels") > 1).alias("n_contradicted"))
