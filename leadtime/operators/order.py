"""Order statistics of groups of any size: places in sorted arrays, ranges of equal shares, exact quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Groups up to so many rows are put in order whole; of larger ones only what a sketch leaves open.
SMALL_GROUP = 10_000


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns of their group, null keys too; without keys, of the one row."""
    if not by:
        return rows.crossJoin(groups)
    named = groups.withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(by)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(by)])
    return rows.join(named, same).drop(*[f"_g{i}" for i in range(len(by))])


def place(values: Column, x: Column, most: int = (1 << 16) - 1) -> Column:
    """How many elements of a sorted array (of up to ``most``) are ``x`` or less, found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, k: at + F.when(F.coalesce(F.get(values, at + k - 1) <= x, F.lit(False)), k).otherwise(0))


def ranges(df: DataFrame, order: list[str], name: str = "_r") -> DataFrame:
    """The rows, staged, with the number of their range: ranges grow along ``order`` and have about equal shares of rows.

    Bounds come from a sample of the rows, as many ranges as there are shuffle partitions, so they follow the values however
    these are spread. Rows that are equal in ``order`` share a range.
    """
    return staged(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranges")


def quantiles(df: DataFrame, by: list[str], value: str, fractions: list[float], slack: float = 2.0) -> DataFrame:
    """by, place, quantile: for each group the exact quantiles of ``fractions`` (ascending), interpolated between neighbours; nulls don't count.

    A sketch of bounded size brackets the rank of each quantile. One pass counts the rows between brackets and each value inside
    them, where the ranks are then found. Should the sketch be farther off than it promises, the brackets are widened.
    """
    n = len(fractions)
    accuracy = max(10_000, 50 * n)
    rows = staged(df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null"), "values")
    low, high = [max(0.0, f - slack / accuracy) for f in fractions], [min(1.0, f + slack / accuracy) for f in fractions]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [*low, *high], accuracy).alias("_q"))
    position = F.transform(F.array(*map(F.lit, fractions)), lambda f: (F.col("_n") - 1) * f)
    around = F.flatten(F.transform(position, lambda x: F.array(F.floor(x), F.ceil(x))))
    small = F.col("_n") <= SMALL_GROUP
    groups = staged(sketch.select(
        *by, "_n", F.array_sort(F.array_distinct(around)).alias("_ranks"), F.when(small, F.array_repeat(F.lit(float("-inf")), n)).otherwise(F.slice("_q", 1, n)).alias("_low"),
        F.when(small, F.array_repeat(F.lit(float("nan")), n)).otherwise(F.slice("_q", n + 1, n)).alias("_high"),
    ), "brackets")
    # A value is in some bracket if it is in the last one that begins at or below it.
    number = place(F.col("_low"), F.col("_v"), n)
    put = with_groups(rows, groups.select(*by, "_low", "_high"), by).select(*by, "_v", "_high", number.alias("_j"))
    inside = F.coalesce(F.col("_v") <= F.get("_high", F.col("_j") - 1), F.lit(False))
    cells = staged(put.groupBy(*by, "_j", F.when(inside, F.col("_v")).alias("_x")).agg(F.count("*").alias("_c")), "cells")
    between = Window.partitionBy(*by).orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)  # a row for each quantile
    before = cells.groupBy(*by, "_j").agg(F.sum("_c").alias("_c")).select(*by, "_j", F.coalesce(F.sum("_c").over(between), F.lit(0)).alias("_b"))
    within = Window.partitionBy(*by, "_j").orderBy(F.col("_x").asc_nulls_last())
    counted = with_groups(cells.withColumn("_upto", F.sum("_c").over(within)), before, [*by, "_j"]).withColumn("_upto", F.col("_upto") + F.col("_b"))
    ranked = with_groups(counted, groups.select(*by, "_ranks"), by)
    first, last = place(F.col("_ranks"), F.col("_upto") - F.col("_c") - 1, 2 * n), place(F.col("_ranks"), F.col("_upto") - 1, 2 * n)
    hits = ranked.select(*by, "_x", first.alias("_a"), last.alias("_z"), "_ranks").where("_z > _a")
    found = staged(hits.select(*by, "_x", F.explode(F.slice("_ranks", F.col("_a") + 1, F.col("_z") - F.col("_a"))).alias("_rank")), "ranks")
    if not found.where("_x is null").isEmpty():
        return quantiles(df, by, value, fractions, slack * 16)
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))  # two ranks for each quantile

    def interpolated(x: Column) -> Column:
        lower, upper = F.floor(x), F.ceil(x)
        a, b = F.element_at("_at", lower), F.element_at("_at", upper)
        return F.when((lower == upper) | (a == b), a).otherwise((upper - x) * a + (x - lower) * b)

    return with_groups(groups.select(*by, "_n"), at, by).select(*by, F.posexplode(F.transform(position, interpolated)).alias("place", "quantile"))


def median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, and the exact median of each group that has one."""
    return quantiles(df, by, value, [0.5]).select(*by, F.col("quantile").alias(name))
