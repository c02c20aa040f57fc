"""Catalogued events: parsing, availability, timelines of their blocks, onsets, manifests, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..sources.staging import staged
from .align import steps_in_intervals
from .islands import islands
from .order import median
from .verify import alarm_segments, lead_times, postprocess

# Events left out for work at the measuring site.
ENGINEERING = (18, 19)


def parse_catalog(cells: DataFrame, number: str, date: str, clock: str, peak: str, storm: str, keep: list[str] | None = None, excluded: tuple[int, ...] = ENGINEERING) -> DataFrame:
    """keep, event_id, peak_time, peak_abs, driver, status from text cells; rows whose number is not digits (and one "*") go.

    Dates are day.month.year, clocks hour:minute or hour.minute with blanks, peaks have a decimal comma. A storm with CIR is
    CIR, else one with CME that doesn't start with SC is CME. ``status`` tells why an event isn't selected.
    """
    day = F.split(F.trim(date), r"\.")
    at = F.split(F.regexp_replace(F.regexp_replace(clock, " ", ""), r"\.", ":"), ":")

    def part(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    moment = times.from_parts(part(day, 2), part(day, 1), part(day, 0), part(at, 0), part(at, 1), F.lit(0.0))
    driver = F.when(F.col(storm).contains("CIR"), "CIR").when(F.col(storm).contains("CME") & ~F.col(storm).startswith("SC"), "CME")
    parsed = cells.where(F.col(number).rlike(r"^\d+\*?$")).select(
        *(keep or []), F.regexp_extract(number, r"\d+", 0).cast("int").alias("event_id"), moment.alias("peak_time"),
        F.abs(F.regexp_replace(peak, ",", ".").try_cast("double")).alias("peak_abs"), driver.alias("driver"),
    )
    status = F.when(F.col("event_id").isin(*excluded), "excluded_engineering").when(F.col("driver").isNull(), "excluded_driver").when(F.col("peak_time").isNull(), "excluded_time").otherwise("selected")
    return parsed.withColumn("status", status)


def availability(rows: DataFrame, step: str, features: list[str], events: DataFrame, limit: int, bucket: int, keys: list[str] | None = None) -> DataFrame:
    """event_id, longest, worst, excluded: the longest run of missing steps in an event's window, its feature (the last by name), and whether it reaches the limit."""
    keys = keys or []
    pairs = steps_in_intervals(rows.select(*keys, step, *features), step, events.select(*keys, "event_id", "start", "end"), "start", "end", bucket, keys)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).isNull().alias("missing")) for f in features])).alias("v")
    runs = islands(pairs.select("event_id", step, cells).select("event_id", step, "v.*"), ["event_id", "feature"], step, F.col("missing")).groupBy("event_id", "feature").agg(F.max("n").alias("longest"))
    each = events.select("event_id", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature")).join(runs, ["event_id", "feature"], "left").na.fill(0, ["longest"])
    worst = each.groupBy("event_id").agg(F.max("longest").alias("longest"), F.max_by("feature", F.struct("longest", "feature")).alias("worst"))
    return worst.withColumn("excluded", F.col("longest") >= limit)


def event_timeline(rows: DataFrame, step: str, blocks: DataFrame, masks: dict[str, tuple[int, int]], horizon: int, bucket: int, keys: list[str] | None = None) -> DataFrame:
    """The rows inside blocks with the blocks' columns; each mask (name: lag, length) needs its input and target inside the block too."""
    placed = steps_in_intervals(rows, step, blocks, "start", "end", bucket, keys)
    ahead = F.col(step) + horizon < F.col("end")
    inside = {name: ((F.col(name) == 1) & (F.col(step) - (lag + length - 1) >= F.col("start")) & ahead).cast("int") for name, (lag, length) in masks.items()}
    return placed.withColumns({name: F.coalesce(c, F.lit(0)) for name, c in inside.items()})


def split_manifest(blocks: DataFrame, timeline: DataFrame, splits: list[str], masks: list[str], step: str) -> DataFrame:
    """Per split, empty ones too: blocks, events, steps, the first and last one, and the valid ones of each mask."""
    known = blocks.sparkSession.createDataFrame([(x,) for x in splits], "split string")
    grouped = blocks.groupBy("split").agg(F.count("*").alias("n_blocks"), F.sum("n_events").alias("n_events"))
    counted = timeline.groupBy("split").agg(F.count("*").alias("n_steps"), F.min(step).alias("first_step"), F.max(step).alias("last_step"), *[F.sum(m).alias(f"valid_{m}") for m in masks])
    out = known.join(grouped, "split", "left").join(counted, "split", "left")
    return out.na.fill(0, ["n_blocks", "n_events", "n_steps", *[f"valid_{m}" for m in masks]])


def dataset_metadata(events: DataFrame, blocks: DataFrame, timeline: DataFrame, masks: list[str]) -> DataFrame:
    """One row of what a dataset holds: events, blocks and steps, and as JSON texts events by driver and by split, blocks by split, valid steps by mask."""

    def counts(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        per = df.groupBy(F.coalesce(key, F.lit("none")).alias("key")).agg(value.cast("bigint").alias("value"))
        return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias(name))

    valid = timeline.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(m).alias("v")) for m in masks])).alias("m")).select("m.*")
    parts = [
        events.agg(F.count("*").alias("n_events")), blocks.agg(F.count("*").alias("n_blocks")), timeline.agg(F.count("*").alias("n_steps")),
        counts(events, "driver", F.count("*"), "drivers"), counts(blocks, "split", F.sum("n_events"), "split_events"), counts(blocks, "split", F.count("*"), "split_blocks"),
        counts(valid, "mask", F.sum("v"), "valid_steps"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def event_onsets(rows: DataFrame, step: str, value: str, events: DataFrame, thresholds: list[float], bucket: int, keys: list[str] | None = None) -> DataFrame:
    """keys, event_id, threshold, onset: the first step of the run at or above a threshold that is nearest to the peak, in the event's window.

    The earlier step wins a tie. Events that don't reach a threshold have no row.
    """
    keys = keys or []
    pairs = steps_in_intervals(rows.select(*keys, step, value), step, events.select(*keys, "event_id", "peak", "start", "end"), "start", "end", bucket, keys)
    long = pairs.select(*keys, "event_id", "peak", step, value, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    high = long.where(F.abs(F.col(value)) >= F.col("threshold"))
    by = [*keys, "event_id", "threshold"]
    run = F.col(step) - F.row_number().over(Window.partitionBy(*by).orderBy(step))  # windows are short
    starts = high.withColumn("_run", run).withColumn("_start", F.min(step).over(Window.partitionBy(*by, "_run")))
    return starts.groupBy(*by).agg(F.min_by("_start", F.struct(F.abs(F.col(step) - F.col("peak")), F.col(step))).alias("onset"))


def decided_alarms(rows: DataFrame, step: str, points: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """keys, by, first, last of the processed alarms, where ``points`` has the cutoff, min_run, merge_gap and min_length of each forecast."""
    each = list(dict.fromkeys([*keys, *by, "min_run", "merge_gap", "min_length"]))
    found = alarm_segments(rows.join(points, by), each, step, F.col("p") >= F.col("cutoff"))
    return postprocess(found, each, F.col("min_run"), F.col("merge_gap"), F.col("min_length")).drop("min_run", "merge_gap", "min_length")


def event_warnings(rows: DataFrame, step: str, alarms: DataFrame, onsets: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Each onset with the first forecast step inside an alarm in the ``horizon`` steps before it, if any, and the lead.

    An alarm may bridge steps without a forecast, which warn nobody.
    """
    inside = alarms.select(*keys, F.explode(F.sequence("first", "last")).alias(step)).join(rows.select(*keys, step), [*keys, step])
    return lead_times(onsets, inside, keys, step, "onset", horizon)


def event_ids(rows: DataFrame, step: str, events: DataFrame, bucket: int, keys: list[str]) -> DataFrame:
    """keys, step, event_id: a row for each step and each event of the same keys whose window holds it."""
    return steps_in_intervals(rows.select(*keys, step).distinct(), step, events.select(*keys, "event_id", "start", "end"), "start", "end", bucket, keys).select(*keys, step, "event_id")


def prediction_table(scores: DataFrame, step: str, points: DataFrame, keys: list[str], by: list[str], events: DataFrame, bucket: int, stride: int = 1) -> DataFrame:
    """Each score (keys, by, step, y, p) with the cutoff of its forecast, ``raw`` and ``processed`` decisions, and the ``event_ids`` of its step.

    ``points`` has the cutoff and alarm setting of each forecast. Samples are ``stride`` steps apart, so settings count samples. The
    ids are one text, in order, comma-joined, empty without events.
    """
    rows = staged(scores, "scores")
    each = list(dict.fromkeys([*keys, *by]))
    places = rows.withColumn("_at", F.floor(F.col(step) / stride))
    alarms = decided_alarms(places.select(*each, "_at", "p"), "_at", points, keys, by)
    inside = steps_in_intervals(places.select(*each, "_at"), "_at", alarms.withColumn("_end", F.col("last") + 1).select(*each, "first", "_end"), "first", "_end", bucket, each)
    hit = inside.select(*each, "_at").distinct().withColumn("processed", F.lit(1))
    ids = event_ids(rows, step, events, bucket, keys).groupBy(*keys, step).agg(F.array_join(F.array_sort(F.collect_set("event_id")).cast("array<string>"), ",").alias("event_ids"))
    out = places.join(points.select(*by, "cutoff"), by).join(hit, [*each, "_at"], "left").join(ids, [*keys, step], "left")
    decided = (F.col("p") >= F.col("cutoff")).cast("int").alias("raw")
    return out.select(*each, step, "y", "p", "cutoff", decided, F.coalesce("processed", F.lit(0)).alias("processed"), F.coalesce("event_ids", F.lit("")).alias("event_ids"))


def alarm_episodes(rows: DataFrame, step: str, alarms: DataFrame, keys: list[str]) -> DataFrame:
    """Each alarm with its length, its target steps, whether it has any (``matched``), and ``false_alarm``."""
    inside = alarms.select(*keys, "first", "last", F.explode(F.sequence("first", "last")).alias(step)).join(rows.select(*keys, step, "y"), [*keys, step], "left")
    out = inside.groupBy(*keys, "first", "last").agg(F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("target_steps"))
    return out.select("*", (F.col("last") - F.col("first") + 1).alias("duration"), (F.col("target_steps") > 0).alias("matched"), (F.col("target_steps") == 0).alias("false_alarm"))


def warning_summary(warnings: DataFrame, episodes: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """Per forecast of ``points``, whose columns stay: eligible, detected and missed events, POD, median lead, alarms and false ones."""
    w = warnings.groupBy(*by).agg(F.count("*").alias("eligible"), F.count_if("detected").alias("detected"))
    w = w.join(median(warnings, by, "lead", "median_lead"), by, "left")
    e = episodes.groupBy(*by).agg(F.count("*").alias("episodes"), F.count_if("false_alarm").alias("false_episodes"))
    out = points.join(w, by, "left").join(e, by, "left").na.fill(0, ["eligible", "detected", "episodes", "false_episodes"])
    return out.select(
        "*", (F.col("eligible") - F.col("detected")).alias("missed"), F.try_divide("detected", "eligible").alias("pod"), (F.col("episodes") - F.col("false_episodes")).alias("true_episodes"),
        F.try_divide("false_episodes", "episodes").alias("false_ratio"),
    )


def event_day_summary(raw: DataFrame, grid: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per series and day: raw rows, valid ones, the first and last; steps, valid and missing ones, those that do and don't match their raw rows.

    ``raw`` has ``value`` and ``order``; ``grid`` has ``value`` and ``matches``, as ``resampling_check`` gives it.
    """
    a = raw.groupBy(*keys).agg(F.count("*").alias("raw_rows"), F.count(value).alias("raw_valid"), F.min(order).alias("raw_first"), F.max(order).alias("raw_last"))
    b = grid.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.count(value).alias("steps_valid"), F.count_if(F.col(value).isNull()).alias("steps_missing"), F.count_if("matches").alias("steps_matching"),
        F.count_if(~F.col("matches")).alias("steps_not_matching"),
    )
    return b.join(a, keys, "left").na.fill(0, ["raw_rows", "raw_valid"])
