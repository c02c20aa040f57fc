"""Mixing sources to target weights by distributed prefix sums over hash-random orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_keys, stage

#: A source of this many documents has one bucket of its order; larger ones have more.
BUCKET_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """source, source_size, target for each source of (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn. They share the sum of all sizes by weight,
    none above ``max_epochs`` times its own size; what is cut off is shared again. That ends at one level for
    all sources that are not cut: target = least(max_epochs * size, level * weight). Ordered by the level at
    which each source is cut, the level follows from running sums over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.select("source", "source_size", F.element_at(cycle, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    full = (F.col("source_size") * max_epochs).cast("double")
    order = Window.orderBy((full / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy(F.lit(1)))
    cut_before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.select("*", full.alias("full"), ((everything - cut_before) / weight_left).alias("level"))
    level = F.max(F.when(F.col("full") / F.col("weight") > F.col("level"), F.col("level"))).over(Window.partitionBy(F.lit(1)))
    return levels.select("source", "source_size", F.least(F.col("full"), F.coalesce(level * F.col("weight"), F.col("full"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_rows: int = BUCKET_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, and with ``carry`` those columns as a struct ``carried``.

    ``size`` is the number of words of the text (0 for null or empty), ``taken`` how many words the mix
    takes, repeats counted. Each source's documents have a random order, by the md5 of seed and id (rows that
    repeat an id, or have none, are told apart by size and by a key made for them). A source takes whole
    epochs of its documents while its budget lasts, then documents in that order; the last one is cut where
    the budget, the whole part of the target, is used up. A null source is a source of its own. An empty
    table gives an empty result, and sources without words take nothing. Other columns are ignored.

    The order is by hash, so equal ranges of the hash hold equal shares of a source. Rows meet in (source,
    range) buckets of bounded size; a bucket's offset is the running sum of the bucket totals before it. No
    task sees a whole source. That gives, for each source, the document at which its budget ends: one row, which all
    documents of the source are compared with where they are read, so their texts are not moved.
    """
    docs, key_col = row_keys(docs, id_col)

    def placed(*more: Column) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
        size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
        return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.struct(key.alias("key"), size.alias("size"), F.col(key_col).alias("row")).alias("place"), *more)

    sizes = stage(placed(), "sizes")
    plan = stage(source_plan(sizes, weights, max_epochs, bucket_rows), "plan")
    rows = placed(F.struct(*carry).alias("carried")) if carry else sizes
    both = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    last = F.when(F.col("end").isNull() | (F.col("place") < F.col("end")), F.col("size")).when(F.col("place") == F.col("end"), F.col("of_last")).otherwise(0)
    return both.select(
        F.col("id").alias(id_col), F.col("d.source").alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        *(["carried"] if carry else []),
    )


def source_plan(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int, bucket_rows: int) -> DataFrame:
    """source, source_size, target, epochs, end, of_last: the whole epochs of each source, the place at which its budget ends after them, and the words taken there.

    ``sizes`` has source, size, and places that differ from each other. ``end`` is null if the budget has no end.
    """
    buckets = max(64, -(-sizes.count() // bucket_rows))
    ranged = sizes.withColumn("range_no", F.floor(F.conv(F.substring("place.key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)))
    bucket_sums = stage(ranged.groupBy("source", "range_no").agg(F.sum("size").alias("bucket_size")), "buckets")
    by_range = Window.partitionBy("source").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucket_sums.select("source", "range_no", "bucket_size", F.coalesce(F.sum("bucket_size").over(by_range), F.lit(0)).alias("before_range"))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.try_divide(budget - F.pmod(budget, F.greatest("source_size", F.lit(1))), F.col("source_size")), F.lit(0)).cast("long")
    aims = targets(bucket_sums.withColumnRenamed("bucket_size", "size"), weights, max_epochs).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    aims = stage(aims, "targets")
    # The one range of each source in which the rest of its budget ends; only its rows are put in order.
    ending = offsets.alias("o").join(aims.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).where((F.col("before_range") <= F.col("rest")) & (F.col("rest") < F.col("before_range") + F.col("bucket_size")))
    ending = stage(ending.select("o.source", "range_no", (F.col("rest") - F.col("before_range")).alias("left")), "ending")
    here = ranged.alias("r").join(ending.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.range_no") == F.col("e.range_no"))).select("r.source", "size", "place", "left")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = here.withColumn("before", before).where(F.col("before") + F.col("size") > F.col("left"))
    ends = over.groupBy("source").agg(F.min("place").alias("end"), F.min_by(F.greatest(F.lit(0), F.col("left") - F.col("before")), "place").alias("of_last"))
    return aims.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left").select("t.source", "source_size", "target", "epochs", "end", "of_last")
