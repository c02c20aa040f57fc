"""Moments of pairs of columns that add up, so that the screens and scalers of many groups come from one pass."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Moments(NamedTuple):
    """Of the rows where both columns are finite, for each pair (i, j): rows, and sums of i, of its square, and of the product.

    ``whole`` has rows, sums and sums of squares of each column on the rows where all of ``complete`` are finite. Values are less ``center``.
    """

    names: list[str]
    center: np.ndarray
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    whole: np.ndarray

    def keep(self, limit: float = 0.95, min_variance: float = 1e-10) -> list[str]:
        """At least two values, some variance, and not correlated with one that is kept; in the order of the columns."""
        with np.errstate(divide="ignore", invalid="ignore"):
            variance = np.diag(self.xx) / np.diag(self.n) - (np.diag(self.x) / np.diag(self.n)) ** 2
            spread = self.xx - self.x**2 / self.n
            r = (self.xy - self.x * self.x.T / self.n) / np.sqrt(spread * spread.T)
        kept: list[int] = []
        for i in range(len(self.names)):
            if self.n[i, i] >= 2 and variance[i] > min_variance and all(not np.isfinite(r[k, i]) or abs(r[k, i]) < limit for k in kept):
                kept.append(i)
        return [self.names[i] for i in kept]

    def scale(self) -> tuple[dict[str, float], dict[str, float]]:
        """Means and population deviations on the complete rows, missing values apart; a deviation of 0 counts as 1."""
        n, x, xx = self.whole
        mean = x / np.maximum(n, 1)
        deviation = np.sqrt(np.maximum(xx / np.maximum(n, 1) - mean**2, 0))
        deviation[deviation <= 1e-12 * np.maximum(np.abs(mean), 1)] = 1
        return dict(zip(self.names, (mean + self.center).tolist())), dict(zip(self.names, deviation.tolist()))


def group_moments(df: DataFrame, by: str, names: list[str], complete: list[str] | None = None) -> dict[Any, Moments]:
    """Of each value of ``by`` the moments of these columns, by one job after one for the columns' means.

    Tasks multiply batches of rows as matrices and add them up, so a task gives one row for each group, of four numbers for each
    pair of columns, and the driver gets as much for each group. There are few groups, such as folds.
    """
    m = len(names)
    center = np.array([x or 0.0 for x in df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"_{i}") for i, c in enumerate(names)]).first()], float)
    needed = [names.index(c) for c in (names if complete is None else complete)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[Any, np.ndarray] = {}
        for batch in batches:
            group = np.array(batch.column(0).to_pylist(), object)
            values = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)]).astype(float) - center
            there = np.isfinite(values)
            for g in dict.fromkeys(group.tolist()):
                ok = there[group == g]
                x, k = np.where(ok, values[group == g], 0.0), ok.astype(float)
                whole = ok[:, needed].all(axis=1).astype(float)
                parts = [k.T @ k, x.T @ k, (x**2).T @ k, x.T @ x, whole @ k, whole @ x, whole @ x**2]
                flat = np.concatenate([p.ravel() for p in parts])
                sums[g] = sums[g] + flat if g in sums else flat
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["g", "v"])

    rows = df.select(F.col(by).alias("g"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    kind = rows.select("g").limit(0).toArrow().schema.field("g").type
    added = rows.mapInArrow(run, f"g {rows.schema['g'].dataType.simpleString()}, v array<double>")
    each = added.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    out = {}
    for row in each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():  # one row for each group
        v = np.array([p["x"] for p in row["v"]])
        square = v[: 4 * m * m].reshape(4, m, m)
        out[row["g"]] = Moments(names, center, *square, v[4 * m * m :].reshape(3, m))
    return out
