"""Cleaning of measurement cells: late typing, sentinels, ranges. Missing is always null, never NaN."""

from __future__ import annotations

import re
from typing import NamedTuple

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The format of numbers, the repeated-nine sentinel, the fill magnitude, the sentinel tolerance.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NINES = r"^[+-]?9+(\.9+)?(e[+-]?\d+)?$"
FILL_MAGNITUDE = 1e30
SENTINEL_TOLERANCE = 1e-6


def number(text: Column) -> Column:
    """The number that a cell holds, or null; only plain decimal and exponent forms count."""
    cell = F.trim(text)
    return F.when(cell.rlike(NUMBER), cell.try_cast("double"))


def repeated_nines(text: Column) -> Column:
    """Whether a cell is a sentinel of nines: at least three with a decimal point, four without."""
    cell = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), '"', "")
    mantissa = F.regexp_replace(cell, "e.*$", "")
    enough = F.when(mantissa.contains("."), 3).otherwise(4)
    return F.coalesce(cell.rlike(NINES) & (F.length(F.regexp_replace(mantissa, "[^9]", "")) >= enough), F.lit(False))


def in_list(x: Column, sentinels: list[float], tolerance: float = SENTINEL_TOLERANCE) -> Column:
    """Whether the magnitude of x is within the tolerance of one of the sentinels."""
    near = [F.abs(F.abs(x) - float(s)) <= tolerance for s in sentinels]
    return F.coalesce(reduce(or_, near), F.lit(False)) if near else F.lit(False)


def masked(x: Column, ok: Column, name: str) -> list[Column]:
    """The value where it is valid, else null, and a flag of missing values; the row stays."""
    value = F.when(ok & ~F.isnan(x), x)
    return [value.alias(name), value.isNull().cast("int").alias(f"{name}_missing_flag")]


def reason(text: Column) -> Column:
    """Why a cell has no value: blank, nines, fill, text; null if it has one."""
    x = number(text)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "blank").when(repeated_nines(text), "nines").when(x.isNull(), "text").when(F.abs(x) >= FILL_MAGNITUDE, "fill")
    )


def clean_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Each text column as a number or null, in place, and after all columns a missing flag for each."""
    others = [c for c in df.columns if c not in names]
    values = [F.when(reason(F.col(c)).isNull(), number(F.col(c))).alias(c) for c in names]
    flags = [reason(F.col(c)).isNotNull().cast("int").alias(f"{c}_missing_flag") for c in names]
    return df.select(*others, *values, *flags)


def missing_report(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, n_rows, blank, nines, fill, text, missing, percent: one pass over all columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), reason(F.col(c)).alias("why")) for c in names])).alias("v")
    counts = [F.count_if(F.col("why") == w).alias(w) for w in ("blank", "nines", "fill", "text")]
    grouped = df.select(cells).select("v.*").groupBy("feature").agg(F.count("*").alias("n_rows"), *counts, F.count("why").alias("missing"))
    return grouped.withColumn("percent", F.try_divide(100.0 * F.col("missing"), F.col("n_rows")))


class Likeness(NamedTuple):
    """A name is alike if it is one of ``names``, or begins and ends so and holds a part of each of ``parts``; an empty likeness is like nothing."""

    names: tuple[str, ...] = ()
    begins: str = ""
    ends: str = ""
    parts: tuple[tuple[str, ...], ...] = ()

    def fits(self, name: str) -> bool:
        if name in self.names:
            return True
        told = bool(self.begins or self.ends or self.parts)
        return told and name.startswith(self.begins) and name.endswith(self.ends) and all(any(p in name for p in some) for some in self.parts)


# What columns of solar-wind files are taken for when no alias names them.
PARTICLES = ("proton", "ion", "sw")
SOLAR_WIND = {
    "Btot": [Likeness(("b_nt", "magnitude_nt", "bmag_nt")), Likeness(begins="btot_"), Likeness(begins="b_", ends="_nt")],
    "Bx_gse": [Likeness(begins="bx_gse", ends="_nt")],
    "By_gse": [Likeness(begins="by_gse", ends="_nt")],
    "Bz_gse": [Likeness(begins="bz_gse", ends="_nt")],
    "Vp": [Likeness(("vp",)), Likeness(begins="vp_"), Likeness(parts=(("speed", "velocity"), PARTICLES))],
    "Np": [Likeness(("np",)), Likeness(begins="np_"), Likeness(begins="h_density_"), Likeness(parts=(("density",), PARTICLES))],
}


def standard_names(columns: list[str], aliases: dict[str, list[str]], drop: tuple[str, ...] = ("cnt", "quality", "flag"), like: dict[str, list[Likeness]] | None = None) -> dict[str, str]:
    """From each column that an alias list names (after lower case and runs of other characters as "_") to its standard name.

    An exact alias comes first, then the first column that is like one of ``like`` for the standard name (such as ``SOLAR_WIND``), or
    where it has none, whose name has an alias as a whole word (or words, between "_"). Columns with a ``drop`` part match
    exactly only. A standard name that is there already stays as it is, and no column gets two.
    """
    keys = {c: re.sub("[^a-z0-9]+", "_", c.lower()).strip("_") for c in columns}
    out: dict[str, str] = {}
    for name, known in aliases.items():
        if name in columns:
            continue
        open_ = {c: k for c, k in keys.items() if c not in out and c not in aliases}
        exact = [c for c, k in open_.items() if k in known]
        clean = {c: k for c, k in open_.items() if not any(part in k for part in drop)}
        rules = (like or {}).get(name)
        loose = [c for c, k in clean.items() if (any(rule.fits(k) for rule in rules) if rules else any(f"_{a}_" in f"_{k}_" for a in known))]
        if exact or loose:
            out[(exact or loose)[0]] = name
    return out


def prefixed(df: DataFrame, others: list[str], prefix: str, keys: list[str]) -> DataFrame:
    """Columns that ``others`` has too get a prefix, but the keys."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c in others and c not in keys})
