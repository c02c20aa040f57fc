"""Matching alarms with true segments: the greedy choice in time order, without going through them one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .running import running


def match_events(truth: DataFrame, alarms: DataFrame, keys: list[str], chunk: int = 10_000) -> DataFrame:
    """keys, alarm_first, truth_first: alarms in time order each take the overlapping true segment with the nearest start that is still free.

    Of equally near ones the earlier. Alarms of a series are disjoint, and so are true segments. ``keys`` tell the series of the
    alarms apart; ``truth`` has some of them, so one set of true segments serves alarms of many settings.

    Starts after an alarm's own lie in order, so an alarm chooses between the first two segments it overlaps, and only the first
    of these can have been taken before. Whether it is depends on the alarm before: it surely is if that has the same first one or
    chose it for good, it surely is not if that doesn't overlap it, and else it is if that alarm found its own first one taken. So
    the answer is that of the last alarm for which it is sure: a running maximum, no loop.
    """
    shared = [k for k in keys if k in truth.columns]

    def part(c: str, size: int = chunk) -> Column:
        return F.floor(F.col(c) / size)

    # The next true segment of each; then, going back in time, the nearest one that ends at or after each alarm's first step.
    backward = truth.select(*shared, "first", "last", (-F.col("first")).alias("_o"))
    following = running(backward, shared, ["_o"], part("_o"), maxima={"_next": F.col("_o")}, before=True)
    true = following.select(*shared, (-F.col("last")).alias("_o"), F.lit(0).alias("_kind"), F.struct((-F.col("last")).alias("end"), "first", (-F.col("_next")).alias("next")).alias("_true"))
    mine = alarms.select(*keys, "first", "last", (-F.col("first")).alias("_o"), F.lit(1).alias("_kind"))
    both = staged(true.unionByName(mine, allowMissingColumns=True), "ends")
    seen = running(both, shared, ["_o", "_kind"], part("_o"), maxima={"_t": F.col("_true")}).where("_kind = 1")
    near = seen.select(*keys, "first", "last", F.col("_t.first").alias("_f"), F.when(F.col("_t.next") <= F.col("last"), F.col("_t.next")).alias("_s")).where("_f <= last")
    # Whether the first one is the nearer, if both are free.
    prefers = F.col("_s").isNull() | (F.abs(F.col("_f") - F.col("first")) <= F.abs(F.col("_s") - F.col("first")))
    near = staged(near.withColumn("_own", prefers), "nearest")
    ordered = staged(running(near, keys, ["first"], part("first"), maxima={"_b": F.struct("first", "_f", "_s", "_own", "last")}, before=True), "neighbours")
    b = F.col("_b")
    depends = (b["_s"] == F.col("_f")) & b["_own"]
    sure = F.when(b["_f"] == F.col("_f"), True).when(depends, F.lit(None).cast("boolean")).otherwise(F.coalesce(b["_s"] == F.col("_f"), F.lit(False)))
    told = ordered.withColumn("_sure", sure).withColumn("_at", F.when(F.col("_sure").isNotNull(), F.struct("first", F.col("_sure").alias("taken"))))
    settled = running(told, keys, ["first"], part("first"), maxima={"_last": F.col("_at")})
    choice = F.when(F.col("_own") & ~F.col("_last.taken"), F.col("_f")).otherwise(F.col("_s"))
    return settled.select(*keys, F.col("first").alias("alarm_first"), choice.alias("truth_first")).where("truth_first is not null")
