"""Running sums and maxima of long series in two levels, so that no task sorts a whole series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: bool = False
) -> DataFrame:
    """Adds running sums and maxima in the order of ``order`` for each group of ``keys``; with ``before``, of earlier rows only.

    ``chunk`` cuts a group into ranges and must not fall along ``order``. Rows are gone through inside chunks; what came
    before a chunk is taken from the table of chunk totals.
    """
    made = {name: (F.sum, c) for name, c in (sums or {}).items()} | {name: (F.max, c) for name, c in (maxima or {}).items()}
    rows = df.select("*", chunk.alias("_c"), *[c.alias(f"_v_{name}") for name, (_, c) in made.items()])
    local = Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = rows.select("*", *[f(f"_v_{name}").over(local).alias(f"_l_{name}") for name, (f, _) in made.items()])
    totals = rows.groupBy(*keys, "_c").agg(*[f(f"_v_{name}").alias(f"_t_{name}") for name, (f, _) in made.items()])
    outer = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    past = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_c"])], *[f(f"_t_{name}").over(outer).alias(f"_p_{name}") for name, (f, _) in made.items()]
    )
    both = inside.join(past, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_c"])]))
    values = [
        (F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_p_{name}", F.lit(0)) if f is F.sum else F.greatest(f"_l_{name}", f"_p_{name}")).alias(name) for name, (f, _) in made.items()
    ]
    return both.select(*df.columns, *values)
