"""Gaps and islands: runs of a flag, segments between gaps, merged intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running


#: Chunks of the next level are so many times as long.
WIDER = 1000


def coalesced(
    df: DataFrame, keys: list[str], first: str, last: str, max_step: Column | int, aggregates: dict[str, Callable[[Column], Column]], chunk_steps: int = 10_000
) -> DataFrame:
    """keys, first, last and ``aggregates`` (of columns named alike) of disjoint intervals, those merged that begin ``max_step`` or less after the one before.

    An interval is a step, a run of steps or longer. Neighbours merge inside chunks; all but the first and the last of a chunk are then
    done, and only those two can go on. They merge in the same way in chunks of chunks, and what the edges of these leave, two rows in
    ``WIDER`` chunks at most, for each group. ``aggregates`` must be sums, minima or maxima.
    """
    limit = max_step if isinstance(max_step, Column) else F.lit(max_step)

    def merged(parts: DataFrame, size: int | None) -> DataFrame:
        group = [*keys, "_home"]
        order = Window.partitionBy(*group).orderBy("first")
        apart = F.when(F.col("first") - F.lag("last").over(order) <= limit, 0).otherwise(1)
        placed = parts.withColumn("_home", F.floor(F.col("first") / size) if size else F.lit(0))
        numbered = placed.select("*", apart.alias("_new"), F.lead("first").over(order).isNull().alias("_tail")).select("*", F.sum("_new").over(order).alias("_run"))
        runs = numbered.groupBy(*group, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[f(F.col(name)).alias(name) for name, f in aggregates.items()], F.max("_tail").alias("_tail"))
        return runs.select(*keys, "first", "last", *aggregates, ((F.col("_run") == 1) | F.col("_tail")).alias("_edge"))

    near = merged(df.select(*keys, F.col(first).alias("first"), F.col(last).alias("last"), *aggregates), chunk_steps)
    wide = merged(near.where("_edge").drop("_edge"), chunk_steps * WIDER)
    whole = merged(wide.where("_edge").drop("_edge"), None)
    return near.where("not _edge").unionByName(wide.where("not _edge")).unionByName(whole).drop("_edge")


def islands(df: DataFrame, keys: list[str], step: str, flag: Column, max_step: int = 1, extra: dict[str, tuple[Column, Callable]] | None = None, chunk_steps: int = 10_000) -> DataFrame:
    """keys, first, last, n (and ``extra`` aggregates) of each run of rows with ``flag``, not more than ``max_step`` apart.

    ``extra`` aggregates must be sums, minima or maxima of columns. See :func:`coalesced` for long series.
    """
    extra = extra or {}
    rows = df.where(flag).select(*keys, F.col(step).alias("_t"), F.lit(1).alias("n"), *[c.alias(name) for name, (c, _) in extra.items()])
    return coalesced(rows, keys, "_t", "_t", max_step, {"n": F.sum} | {name: agg for name, (_, agg) in extra.items()}, chunk_steps)


def runs_by_level(df: DataFrame, keys: list[str], step: str, level: str, opening: dict[str, Column], closing: dict[str, Column], chunk_steps: int = 10_000) -> DataFrame:
    """keys, level, first, last, n: for each whole number from 1 on the runs of consecutive steps whose ``level`` is that or more.

    Also ``opening`` as it is at the first step and ``closing`` as it is at the last, which must grow with the steps. Runs are
    nested, like the superlevel sets of a merge tree: a step opens as many of them as it rises above the step before, and closes as many
    as it falls to the next, so there is a row for each end of a run, not one for each step and level.
    """
    rows = df.select(*keys, F.col(step).alias("_t"), F.floor(F.col(step) / chunk_steps).alias("_c"), F.col(level).alias("_v"), *[c.alias(name) for name, c in (opening | closing).items()])
    local = Window.partitionBy(*keys, "_c").orderBy("_t")
    before = F.when(F.lag("_t").over(local) == F.col("_t") - 1, F.lag("_v").over(local)).otherwise(0)
    after = F.when(F.lead("_t").over(local) == F.col("_t") + 1, F.lead("_v").over(local)).otherwise(0)

    def ends(low: str, kind: int) -> Column:
        levels = F.when(F.col("_v") > F.col(low), F.sequence(F.col(low) + 1, F.col("_v"))).otherwise(F.array().cast("array<int>"))
        return F.transform(levels, lambda k: F.struct(k.alias("level"), F.lit(kind).alias("kind")))

    seen = rows.select("*", before.alias("_p"), after.alias("_q")).where("_v > 0")
    each = seen.select("*", F.explode(F.concat(ends("_p", 0), ends("_q", 1))).alias("_e")).select("*", "_e.level", "_e.kind")
    # Inside a chunk the runs of a level open and close in turn.
    turns = Window.partitionBy(*keys, "_c", "level").orderBy("_t", "kind")
    runs = each.select(*keys, "level", "kind", F.col("_t").alias("_a"), F.lead("_t").over(turns).alias("_z"), *opening, *[F.lead(c).over(turns).alias(c) for c in closing]).where("kind = 0")
    runs = runs.withColumn("n", F.col("_z") - F.col("_a") + 1)
    return coalesced(runs, [*keys, "level"], "_a", "_z", 1, {"n": F.sum} | dict.fromkeys(opening, F.min) | dict.fromkeys(closing, F.max), chunk_steps)


def gap_segments(df: DataFrame, keys: list[str], order: str, gap_break: Column | float, chunk: int = 10_000) -> DataFrame:
    """Adds ``segment`` (from 0): it grows where the step from the row before is longer than ``gap_break``.

    A series is gone through in ranges of ``chunk`` units of ``order``.
    """
    place = F.floor(F.col(order) / chunk)
    seen = running(df, keys, [order], place, maxima={"_before": F.col(order)}, before=True)
    limit = gap_break if isinstance(gap_break, Column) else F.lit(gap_break)
    marked = seen.withColumn("_new", F.when(F.col(order) - F.col("_before") > limit, 1).otherwise(0)).drop("_before")
    return running(marked, keys, [order], place, sums={"segment": F.col("_new")}).drop("_new")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, *tie: str, chunk: int = 10_000) -> DataFrame:
    """Adds ``block`` (from 1): half-open intervals that overlap share one; those that only touch don't.

    Intervals are gone through in ranges of ``chunk`` units of ``start``.
    """
    place = F.floor(F.col(start) / chunk)
    reached = running(df, keys, [start, *tie], place, maxima={"_reach": F.col(end)}, before=True)
    marked = reached.withColumn("_new", F.when(F.col(start) < F.col("_reach"), 0).otherwise(1)).drop("_reach")
    return running(marked, keys, [start, *tie], place, sums={"block": F.col("_new")}).drop("_new")


def downsample_peaks(df: DataFrame, keys: list[str], order: str, value: str, points: int, chunk: int = 10_000) -> DataFrame:
    """At most ``points`` rows of each group: of each positional bucket the row of the largest magnitude, else the first."""
    placed = running(df, keys, [order], F.floor(F.col(order) / chunk), sums={"_place": F.lit(1)})
    total = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    bucket = F.floor((F.col("_place") * points - 1) / F.greatest("_total", F.lit(points)))
    row = F.struct(*[F.col(c) for c in df.columns])
    # Larger magnitudes first, then earlier rows; a bucket without values gives its first row.
    best = F.min_by(row, F.struct(F.coalesce(-F.abs(F.col(value)), F.lit(float("inf"))), F.col(order)))
    return placed.join(total, keys).groupBy(*keys, bucket.alias("_b")).agg(best.alias("_row")).select("_row.*")


def sample_index(df: DataFrame, keys: list[str], order: str, stride: int, needed: Column, chunk: int = 10_000) -> DataFrame:
    """Of every ``stride``-th row of each group (such as a split), by its place and from the first on, those that meet ``needed``."""
    placed = running(df, keys, [order], F.floor(F.col(order) / chunk), sums={"_place": F.lit(1)})
    return placed.where((F.pmod(F.col("_place") - 1, F.lit(stride)) == 0) & needed).drop("_place")
