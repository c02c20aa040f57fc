"""Event windows merged into blocks, splits of whole blocks, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .islands import merge_intervals
from .running import running


def event_blocks(events: DataFrame, keys: list[str] | None = None, start: str = "start", end: str = "end", event: str = "event_id", peak: str = "peak") -> DataFrame:
    """keys, block, start, end, n_events, event_ids (in the order of peaks): overlapping windows of a series as one block."""
    keys = keys or []
    merged = merge_intervals(events, keys, start, end, event)
    ids = F.array_sort(F.collect_list(F.struct(peak, event)))
    grouped = merged.groupBy(*keys, "block").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_events"), ids.alias("_ids"))
    return grouped.select(*keys, "block", "start", "end", "n_events", F.array_join(F.transform("_ids", lambda s: s[event].cast("string")), ",").alias("event_ids"))


def split_blocks(blocks: DataFrame, train: float = 0.7, validation: float = 0.15, order: list[str] | None = None, weight: str = "n_events", chunk: int = 1_000) -> DataFrame:
    """Adds ``split``: whole blocks in time order, cut where the running number of events is nearest to the targets.

    The first block wins ties; each split keeps at least one block; the validation target is measured from the
    running number at the end of training. ``order`` must tell blocks apart; it begins with their start, whose
    ranges of ``chunk`` units are gone through one by one.
    """
    order = order or ["start"]
    placed = running(blocks, [], order, F.floor(F.col(order[0]) / chunk), sums={"_i": F.lit(1), "_cum": F.col(weight)}).withColumn("_i", F.col("_i") - 1)
    placed = staged(placed, "blocks")
    total = placed.agg(F.sum(weight).alias("_total"), F.count("*").alias("_n"))
    with_total = placed.crossJoin(F.broadcast(total))  # one row
    off = F.abs(F.col("_cum") - train * F.col("_total"))
    cut = with_total.where("_i <= _n - 3").agg(F.min_by(F.struct(F.col("_i").alias("_ti"), F.col("_cum").alias("_tc")), F.struct(off, "_i")).alias("c")).select("c.*")
    off = F.abs(F.col("_cum") - (F.col("_tc") + validation * F.col("_total")))
    second = with_total.crossJoin(F.broadcast(cut)).where("_i > _ti and _i <= _n - 2").agg(F.min_by("_i", F.struct(off, "_i")).alias("_vi"), F.max("_ti").alias("_ti"))
    split = F.when(F.col("_i") <= F.col("_ti"), "train").when(F.col("_i") <= F.col("_vi"), "validation").otherwise("test")
    return placed.crossJoin(F.broadcast(second)).withColumn("split", split).drop("_i", "_cum", "_ti", "_vi")  # one row each


def forward_folds(blocks: DataFrame, folds: int = 3, initial: float = 0.4, order: list[str] | None = None, keys: list[str] | None = None, chunk: int = 1_000) -> DataFrame:
    """fold, keys, block, role: expanding folds. The first blocks train only; the rest is cut into ``folds`` runs, the first ones one longer.

    Fold k validates run k and trains on all before it. Fewer blocks than one more than the folds are an error, and so is a block
    that is there more than once, such as in two splits.
    """
    order, keys = order or ["start"], keys or []
    twice = Window.partitionBy(*keys, "block")  # a row each
    blocks = blocks.withColumn("_n", F.count("*").over(twice)).where(F.assert_true(F.col("_n") == 1, F.lit("a block is there twice")).isNull()).drop("_n")
    placed = running(blocks, [], order, F.floor(F.col(order[0]) / chunk), sums={"_i": F.lit(1)})
    placed = staged(placed, "blocks")
    counted = placed.crossJoin(F.broadcast(placed.agg(F.count("*").cast("int").alias("_n"))))  # one row
    counted = counted.where(F.assert_true(F.col("_n") > folds, F.lit(f"{folds} folds need {folds + 1} blocks")).isNull())
    n, i = F.col("_n"), F.col("_i") - 1
    head = F.least(F.greatest(F.ceil(n * initial).cast("int"), F.lit(1)), n - folds)
    rest = n - head
    size, longer = F.floor(rest / folds).cast("int"), rest % folds
    past = i - head
    run = F.when(past < longer * (size + 1), F.floor(past / (size + 1))).otherwise(longer + F.floor((past - longer * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    runs = counted.select(*keys, "block", F.when(i < head, 0).otherwise(run).cast("int").alias("run"))
    each = runs.select(*keys, "block", "run", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    return each.where("run <= fold").select("fold", *keys, "block", F.when(F.col("run") == F.col("fold"), "validation").otherwise("train").alias("role"))
