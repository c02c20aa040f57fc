"""Bounded frames over steps of a complete grid, in chunks with halos so that long series spread over tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def chunked(
    df: DataFrame, series: list[str], step: str, back: int, ahead: int, make: Callable[[WindowSpec], dict[str, Column]], chunk_steps: int = 10_000, block: list[str] | None = None
) -> DataFrame:
    """Adds the columns that ``make`` builds on a window ordered by ``step``, whose frames reach ``back`` and ``ahead`` rows.

    A series of any length is cut into chunks of ``chunk_steps``. Each row is copied to a neighbour chunk if it lies
    within the reach of that chunk's frames, so each chunk computes its own rows alone; copies are (back +
    ahead) / chunk_steps of the rows. The grid must be complete, so that rows are steps. With ``block``, frames
    end at block borders and blocks are short; they are not cut.
    """
    if block is not None:
        window = Window.partitionBy(*series, *block).orderBy(step)
        return df.select("*", *[c.alias(name) for name, c in make(window).items()])
    size = max(chunk_steps, back, ahead, 1)
    own = F.floor(F.col(step) / size)
    place = F.pmod(F.col(step), F.lit(size))
    homes = F.array_compact(F.array(own, F.when(place >= size - back, own + 1), F.when(place < ahead, own - 1)))
    window = Window.partitionBy(*series, "_chunk").orderBy(step)
    made = df.select("*", own.alias("_own"), F.explode(homes).alias("_chunk")).select("*", *[c.alias(name) for name, c in make(window).items()])
    return made.where("_own = _chunk").drop("_own", "_chunk")


def full(aggregate: Callable[[Column], Column], x: Column, window: WindowSpec, low: int, high: int) -> Column:
    """An aggregate over rows low..high from here, null unless all of them are there and not null."""
    frame = window.rowsBetween(low, high)
    return F.when(F.count(x).over(frame) == high - low + 1, aggregate(x).over(frame))


def future_peak(x: Column, window: WindowSpec, horizon: int) -> Column:
    """The largest magnitude in the ``horizon`` steps after this one."""
    return full(F.max, F.abs(x), window, 1, horizon)


def exceedance(peak: Column, threshold: float) -> Column:
    return F.when(peak.isNotNull(), (peak >= threshold).cast("int"))


def onset(x: Column, window: WindowSpec, threshold: float) -> Column:
    """1 where the magnitude reaches the threshold and did not one step before; both steps must be observed."""
    before = F.lag(F.abs(x)).over(window)
    return F.coalesce(((F.abs(x) >= threshold) & (before < threshold)).cast("int"), F.lit(0))


def future_onset(x: Column, flag: Column, window: WindowSpec, horizon: int) -> Column:
    """Whether an onset comes in the next ``horizon`` steps; null unless this step and all those are observed."""
    frame = window.rowsBetween(1, horizon)
    return F.when(x.isNotNull() & (F.count(x).over(frame) == horizon), F.max(flag).over(frame))


def window_mask(valid: Column, target: Column, window: WindowSpec, lag: int, length: int) -> Column:
    """1 where the ``length`` steps that end ``lag`` steps before this one are all valid, and so is the target."""
    frame = window.rowsBetween(-(lag + length - 1), -lag)
    return (target & (F.coalesce(F.sum(valid.cast("int")).over(frame), F.lit(0)) == length)).cast("int")


def delta(x: Column, window: WindowSpec, steps: int) -> Column:
    """The change over ``steps`` rows; 0 at a block's start and where either value is missing."""
    return F.coalesce(x - F.lag(x, steps).over(window), F.lit(0.0))


def rolling(x: Column, window: WindowSpec, length: int) -> dict[str, Column]:
    return {name: full(f, x, window, -(length - 1), 0) for name, f in (("mean", F.avg), ("max", F.max), ("std", F.stddev_pop))}


def duration_above(x: Column, window: WindowSpec, length: int, level: float = 0.0) -> Column:
    """How many of the last ``length`` rows are above ``level``; missing counts as no, only missing rows give null."""
    frame = window.rowsBetween(-(length - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) == length, F.sum(F.coalesce((x > level).cast("int"), F.lit(0))).over(frame))


def sequences(values: Column, window: WindowSpec, lag: int, length: int) -> Column:
    """The values of the ``length`` rows that end ``lag`` rows before this one, oldest first; null unless all are there."""
    frame = window.rowsBetween(-(lag + length - 1), -lag)
    return F.when(F.count(values).over(frame) == length, F.collect_list(values).over(frame))


def sequence_matrix(df: DataFrame, series: list[str], step: str, sequence: list[str], context: list[str], lag: int, length: int, name: str = "matrix", chunk_steps: int = 10_000) -> DataFrame:
    """Adds ``name``: the rows of ``sequence`` features of the ``length`` steps that end ``lag`` steps before, oldest first.

    Each row also has the ``context`` features as they are at the last of these steps. Null unless all sequence
    features are there at all steps, and the context at the last.
    """
    row, end = F.array(*[F.col(c).cast("double") for c in sequence]), F.array(*[F.col(c).cast("double") for c in context]).cast("array<double>")

    def make(window: WindowSpec) -> dict[str, Column]:
        return {"_rows": sequences(F.when(F.forall(row, lambda v: v.isNotNull()), row), window, lag, length), "_end": F.lag(end, lag).over(window)}

    made = chunked(df, series, step, lag + length - 1, 0, make, chunk_steps)
    whole = F.col("_rows").isNotNull() & F.forall("_end", lambda v: v.isNotNull())
    return made.withColumn(name, F.when(whole, F.transform("_rows", lambda r: F.concat(r, F.col("_end"))))).drop("_rows", "_end")


def endpoint_matrices(
    df: DataFrame, series: list[str], step: str, endpoint: Column, sequence: list[str], context: list[str], lag: int, length: int, keep: list[str] | None = None, name: str = "matrix", chunk_steps: int = 1_000
) -> DataFrame:
    """series, step, ``keep`` and ``name`` of the rows with ``endpoint`` (such as samples with all labels) that have a whole matrix, as ``sequence_matrix`` gives it.

    Whether the steps are all there is a difference of running counts. The values of a chunk, with a halo of ``lag`` and ``length``, are packed
    into one array, of which each endpoint takes its slice; other rows carry no matrix.
    """
    back, keep = lag + length - 1, keep or []
    size = max(chunk_steps, back, 1)
    own = F.floor(F.col(step) / size)
    homes = F.array_compact(F.array(own, F.when(F.pmod(F.col(step), F.lit(size)) >= size - back, own + 1)))
    row, end = F.array(*[F.col(c).cast("double") for c in sequence]), F.array(*[F.col(c).cast("double") for c in context]).cast("array<double>")
    there = F.forall(row, lambda v: v.isNotNull())
    placed = df.select(*series, step, *keep, endpoint.alias("_wanted"), row.alias("_row"), end.alias("_context"), there.cast("int").alias("_ok"), own.alias("_own"), F.explode(homes).alias("_chunk"))
    window = Window.partitionBy(*series, "_chunk").orderBy(step)
    counted = placed.withColumn("_upto", F.sum("_ok").over(window))
    whole = F.lag("_upto", lag).over(window) - F.coalesce(F.lag("_upto", lag + length).over(window), F.lit(0)) == length
    seen = counted.select("*", whole.alias("_whole"), F.lag("_context", lag).over(window).alias("_end"))
    chosen = (F.col("_own") == F.col("_chunk")) & F.col("_wanted") & F.col("_whole") & F.forall("_end", lambda v: v.isNotNull())
    packed = seen.groupBy(*series, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct(step, "_row"))).alias("_rows"), F.min(step).alias("_first"), F.collect_list(F.when(chosen, F.struct(step, *keep, "_end"))).alias("_ends")
    )
    start = lambda e: (e[step] - F.lit(back) - F.col("_first") + 1).cast("int")
    made = F.transform("_ends", lambda e: F.struct(e.alias("e"), F.transform(F.slice(F.col("_rows._row"), start(e), length), lambda r: F.concat(r, e["_end"])).alias("m")))
    return packed.where(F.size("_ends") > 0).select(*series, F.explode(made).alias("_x")).select(*series, *[F.col(f"_x.e.{c}").alias(c) for c in (step, *keep)], F.col("_x.m").alias(name))
