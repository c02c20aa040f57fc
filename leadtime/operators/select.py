"""Feature screening, scaling, histograms, quantiles, rankings of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corr_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, on the rows where both are there; one aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(F.col(f"r{i}"), F.lit(None)).alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("v")).select("v.*")


def feature_filter(df: DataFrame, names: list[str], limit: float = 0.95, min_variance: float = 1e-10) -> list[str]:
    """The features to keep: at least two values, some variance, and not correlated with a kept one; in their order."""
    stats = df.agg(*[F.struct(F.count(c).alias("n"), F.var_pop(c).alias("v")).alias(c) for c in names]).first()
    alive = [c for c in names if stats[c]["n"] >= 2 and stats[c]["v"] > min_variance]
    r = {(row["a"], row["b"]): row["r"] for row in corr_matrix(df, alive).collect()} if len(alive) > 1 else {}  # one row per pair of features
    kept: list[str] = []
    for c in alive:
        if all(r.get((k, c)) is None or abs(r[(k, c)]) < limit for k in kept):
            kept.append(c)
    return kept


def standard_scale(df: DataFrame, names: list[str], training: Column) -> DataFrame:
    """Each column less its mean over its population deviation, both from the training rows; deviation 0 counts as 1."""
    fitted = df.where(training).agg(*[x for c in names for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    both = df.join(F.broadcast(fitted))  # one row
    deviation = {c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in names}
    return both.select(*[c for c in df.columns if c not in names], *[((F.col(c) - F.col(f"_m_{c}")) / deviation[c]).alias(c) for c in names])


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """by, bin, center, n, log10_n: equal bins, the last one closed; empty bins too. Values outside don't count."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return all_bins.join(counted, [*by, "bin"], "left").select(*by, "bin", (low + (F.col("bin") + 0.5) * width).alias("center"), n.alias("n"), F.when(n > 0, F.log10(n)).alias("log10_n"))


def labelled_histogram(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """by, label, n of the magnitudes: between the edges, and from the last edge on."""
    x = F.abs(F.col(value))
    labels = [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:])] + [f">={edges[-1]:g}"]
    label = F.when(x >= edges[-1], labels[-1])
    for text, a, b in zip(labels, edges, edges[1:]):
        label = label.when((x >= a) & (x < b), text)
    counted = df.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))
    known = df.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(t) for t in labels])).alias("label"))
    return known.join(counted, [*by, "label"], "left").select(*by, "label", F.coalesce("n", F.lit(0)).alias("n"))


def rank_configurations(scores: DataFrame, by: list[str], *tie: str) -> DataFrame:
    """Adds ``rank``: highest CSI, then lowest FAR, then Bias nearest 1; nulls last."""
    order = [F.col("csi").desc_nulls_last(), F.col("far").asc_nulls_last(), F.abs(F.col("bias") - 1).asc_nulls_last(), *tie]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def choose_window(scores: DataFrame, window: str, cap: float) -> DataFrame:
    """The window with the best mean CSI among those whose mean POFD is within the cap; else that of the lowest POFD."""
    means = scores.groupBy(window).agg(F.avg("csi").alias("csi"), F.avg("pofd").alias("pofd"))
    ok = F.coalesce(F.col("pofd") <= cap, F.lit(False))
    order = F.struct(F.when(ok, 0).otherwise(1), F.when(ok, -F.col("csi")).otherwise(F.col("pofd")), F.col(window))
    best = F.min_by(F.struct(window, "csi", "pofd", ok.alias("within_cap")), order)
    return means.agg(best.alias("b")).select("b.*")
