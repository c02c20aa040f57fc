"""Joins of series: nearest as-of inside segments, intervals against steps."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def nearest_in_segments(obs: DataFrame, keys: list[str], time: str, segment: str, step: int, reach: str) -> DataFrame:
    """keys, target, obs time (``time``), offset: the nearest observation for each step that a segment touches.

    Targets are the multiples of ``step`` from the one at or before a segment's first observation to that of its
    last. Ties go to the earlier observation; a target of two segments takes the nearer one. ``reach`` is a
    column with the longest step inside segments of a series, so no nearest observation is farther off than
    the larger of it and ``step``; a join on buckets of this size with both neighbours finds it without a
    range join.
    """
    size = F.greatest(F.ceil(reach).cast("bigint"), F.lit(step).cast("bigint"))
    spans = obs.groupBy(*keys, segment).agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.max(size).alias("_size"))
    grid = F.sequence(F.floor(F.col("_a") / step) * step, F.floor(F.col("_b") / step) * step, F.lit(step).cast("bigint"))
    targets = spans.select(*keys, segment, "_size", F.explode(grid).alias("target"))
    around = F.floor(F.col("target") / F.col("_size"))
    targets = targets.select(*keys, segment, "target", F.explode(F.array(around - 1, around, around + 1)).alias("_bucket"))
    placed = obs.select(*keys, segment, time, F.floor(F.col(time) / size).alias("_bucket"))
    pairs = targets.join(placed, [*keys, segment, "_bucket"])
    away = F.abs(F.col(time) - F.col("target"))
    best = pairs.groupBy(*keys, "target").agg(F.min_by(F.struct(F.col(time), away.alias("offset"), F.col(segment)), F.struct(away, F.col(time))).alias("_o"))
    return best.select(*keys, "target", f"_o.{time}", "_o.offset", f"_o.{segment}")


#: A cell of a level holds so many of the level below; the highest level has few cells for any interval of 64-bit steps.
FAN, LEVELS = 16, 14


def at_level(level: Column, cell: Column) -> Column:
    return F.struct(level.alias("level"), cell.alias("cell"))


def cover(start: Column, end: Column, bucket: int) -> Column:
    """Cells (level, cell) that cover the buckets of a half-open interval: at each level those at both ends that don't fill a cell of the next.

    Their number grows with the logarithm of the length: at most twice ``FAN`` for each level.
    """
    low, high = F.floor(start / bucket), F.floor((end - 1) / bucket)
    none = F.array().cast("array<bigint>")
    levels = []
    for k in range(LEVELS):
        a, b = -F.floor(-low / FAN**k), F.floor((high + 1) / FAN**k) - 1  # whole cells of this level
        up, down = -F.floor(-low / FAN ** (k + 1)), F.floor((high + 1) / FAN ** (k + 1)) - 1
        left, right = F.least(b, up * FAN - 1), F.greatest(a, (down + 1) * FAN)
        apart = up <= down if k < LEVELS - 1 else F.lit(False)
        cells = F.when(~apart, F.when(a <= b, F.sequence(a, b)).otherwise(none)).otherwise(
            F.concat(F.when(a <= left, F.sequence(a, left)).otherwise(none), F.when(right <= b, F.sequence(right, b)).otherwise(none))
        )
        levels.append(F.transform(cells, partial(at_level, F.lit(k))))
    return F.concat(*levels)


def steps_in_intervals(rows: DataFrame, step: str, intervals: DataFrame, start: str, end: str, bucket: int, keys: list[str] | None = None) -> DataFrame:
    """Each row with each half-open interval that holds its step, of the same ``keys`` if there are any.

    Intervals are covered by cells of a hierarchy (see :func:`cover`) over buckets of ``bucket`` steps, so a long one has few rows. A
    step asks for its cell at each level that occurs, an equi-join followed by the exact test.
    """
    cells = intervals.where(F.col(start) < F.col(end)).select("*", F.explode(cover(F.col(start), F.col(end), bucket)).alias("_in_cell"))
    spread = staged(cells.select(*intervals.columns, "_in_cell.level", "_in_cell.cell").withColumnsRenamed({"level": "_level", "cell": "_cell"}), "cells")
    found = sorted(r["_level"] for r in spread.select("_level").distinct().collect())  # LEVELS at most
    own = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col(step) / (bucket * FAN**k)).alias("_cell")) for k in found]) if found else F.array().cast("array<struct<_level:int,_cell:bigint>>")
    placed = rows.select("*", F.explode(own).alias("_in_cell")).select(*rows.columns, "_in_cell.*")
    return placed.join(spread, [*(keys or []), "_level", "_cell"]).where((F.col(step) >= F.col(start)) & (F.col(step) < F.col(end))).drop("_level", "_cell")


def floor_to_step(df: DataFrame, time: str, step: int) -> DataFrame:
    """Adds ``step`` (the number of the step that holds the time) and ``offset`` (the time from its start)."""
    return df.withColumn("step", F.floor(F.col(time) / step)).withColumn("offset", F.pmod(F.col(time), F.lit(step)))


def alignment_report(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Per series of rows put on steps: steps, steps that hold more than one row, distinct offsets, the least one, and ``ok`` without collisions.

    ``validate.require`` makes a collision an error.
    """
    per = aligned.groupBy(*keys, "step").agg(F.count("*").alias("_n"))
    offsets = aligned.groupBy(*keys, "offset").count().groupBy(*keys).agg(F.count("*").alias("n_offsets"), F.min("offset").alias("least_offset"))
    steps = per.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.count_if(F.col("_n") > 1).alias("n_collisions"))
    return steps.join(offsets, keys).withColumn("ok", F.col("n_collisions") == 0)


def coverage(expected: DataFrame, audit: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Each expected key with its audit columns, and whether it was found and passes ``ok``."""
    return expected.join(audit.withColumn("_found", F.lit(True)), keys, "left").select(
        *keys, *[c for c in audit.columns if c not in keys], F.coalesce("_found", F.lit(False)).alias("found"), F.coalesce(F.col("_found") & ok, F.lit(False)).alias("passes")
    )
