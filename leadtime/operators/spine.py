"""Complete grids: resampling to one value per step, spines, and grids with their gaps filled by nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample_argmax(df: DataFrame, keys: list[str], value: str, *prefer: Column) -> DataFrame:
    """For each group of ``keys``, the value of the largest magnitude, with its sign. Nulls never win.

    Ties go to the greatest of the ``prefer`` columns, in their order (say file order, then minus line number).
    One partial aggregate per task, so a step with very many samples is no problem.
    """
    order = F.struct(F.abs(F.col(value)), *prefer)
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order)).alias(value))


def step_spine(df: DataFrame, series: list[str], step: str, first: int, last: int) -> DataFrame:
    """Each series with all steps from ``first`` to ``last``."""
    return df.select(*series).distinct().select(*series, F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))).alias(step))


def reindex(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the spine with the values of ``df`` where it has them."""
    return spine.join(df, keys, "left")


def dedup_keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each group of ``keys`` by ``order``, and the number of its rows as ``n_rows``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"), F.count("*").alias("n_rows")).select("_row.*", "n_rows")


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, by column name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
