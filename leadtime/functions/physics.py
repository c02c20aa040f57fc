"""Geometry of the field, coupling functions, and transforms of features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def coupling(by: Column, bz: Column, speed: Column) -> dict[str, Column]:
    """Transverse field, clock angle, southward component, Newell and Borovsky functions; null where an input is."""
    bt = F.hypot(by, bz)
    clock = F.when(by.isNotNull() & bz.isNotNull(), F.pmod(F.atan2(by, bz), F.lit(2 * math.pi)))
    half = F.sin(clock / 2)
    ok = bt.isNotNull() & (speed > 0)
    return {
        "b_transverse": bt,
        "clock_angle": clock,
        "bz_south": F.when(bz.isNotNull(), F.greatest(-bz, F.lit(0.0))),
        "newell": F.when(ok, F.pow(speed, 4 / 3) * F.pow(bt, 2 / 3) * F.pow(F.abs(half), 8 / 3)),
        "borovsky": F.when(ok, speed * bt * half * half * 1e-3),
    }


def log_magnitude(x: Column) -> Column:
    """log1p; negative values count as missing."""
    return F.when(x >= 0, F.log1p(x))


def cyclic(angle: Column) -> dict[str, Column]:
    return {"sin": F.sin(angle), "cos": F.cos(angle)}


def calibrated(logit: Column, temperature: Column) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def decision(p: Column, cutoff: Column) -> Column:
    return (p >= cutoff).cast("int")


def feature_roles(names: list[str]) -> dict[str, list[str]]:
    """Features by family, from their names: changes, accumulations, window statistics; all others form the sequence."""
    out: dict[str, list[str]] = {"delta": [], "accumulation": [], "statistics": [], "sequence": []}
    for name in names:
        family = "delta" if "delta" in name else "accumulation" if name.startswith(("sum_", "above_")) else "statistics" if name.startswith(("mean_", "max_", "std_")) else "sequence"
        out[family].append(name)
    return out
