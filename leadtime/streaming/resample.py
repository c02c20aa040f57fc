"""Resampling and file audits as streams over newly landed files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times


class Progress(NamedTuple):
    """What a run of a stream reports: batches, the most rows of state after one of them, and rows that came too late."""

    batches: int
    state_rows: int
    late_rows: int


def instant(time: Column) -> Column:
    """A wall-clock time as the same time in UTC, whatever the session's zone."""
    return F.timestamp_micros(times.micros(time))


def wall_clock(time: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(time), F.lit("1970-01-01").cast("timestamp_ntz"))


def stream_resample(stream: DataFrame, series: str, time: str, value: str, tie: str, step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """series, start, end, value: the value of the largest magnitude of each step, ties to the smallest ``tie``.

    For append mode: a step is given out, and its state dropped, once the stream is ``late`` past its end; rows that come even
    later are left out and counted (see ``drain``). Steps that are still open are read from the state (see ``open_steps``).
    """
    stamped = stream.withColumn("_t", instant(F.col(time))).withWatermark("_t", late)
    best = F.max_by(F.struct(value), F.struct(F.abs(F.col(value)), -F.col(tie)))
    return stamped.groupBy(series, F.window("_t", step).alias("_w")).agg(best.alias("_best")).select(series, wall_clock(F.col("_w.start")).alias("start"), wall_clock(F.col("_w.end")).alias("end"), F.col(f"_best.{value}").alias(value))


def open_steps(spark: SparkSession, folder: str, series: str, value: str) -> DataFrame:
    """The steps of ``stream_resample`` that aren't final yet, as far as the stream has come: its state, in the same columns."""
    state = spark.read.format("statestore").load(f"{folder}/state")
    window = state.schema["key"].dataType.names[1]
    best = state.schema["value"].dataType.names[0]
    key = F.col("key")
    return state.select(key[series].alias(series), wall_clock(key[window]["start"]).alias("start"), wall_clock(key[window]["end"]).alias("end"), F.col("value")[best][value].alias(value))


def stream_file_audit(stream: DataFrame, value: str) -> DataFrame:
    """Per landed file: rows and missing values; a running total in update or complete mode."""
    return stream.groupBy("source_file").agg(F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_missing"))


def drain(result: DataFrame, folder: str, mode: str) -> Progress:
    """Runs a stream over all files that are there, batch by batch into Parquet below ``folder``, then stops.

    A batch has a folder of its own, which it replaces when it is run again. In append mode the rows are those of all batches; in
    complete mode the newest batch has them.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number:08d}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return Progress(len(query.recentProgress), max((s["numRowsTotal"] for s in states), default=0), sum(s["numRowsDroppedByWatermark"] for s in states))


def resampled(spark: SparkSession, folder: str, series: str, value: str) -> DataFrame:
    """All steps that a drained ``stream_resample`` knows: the final ones, and the open ones as they are."""
    final = spark.read.parquet(f"{folder}/out").select(series, "start", "end", value)
    return final.unionByName(open_steps(spark, folder, series, value))
