"""Guarded ratios, box statistics and significance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def nan_to_null(x: Column) -> Column:
    """NaN and infinities become null, as JSON needs."""
    return F.when(finite(x), x)


def nan_to_null_array(x: Column) -> Column:
    return F.transform(x, nan_to_null)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0, null or NaN."""
    return F.when(b.isNull() | F.isnan(b) | (b == 0) | a.isNull(), 0.0).otherwise(a / b)


def _proper(r: Column) -> Column:
    return (r > 0) & (r < 1)


def signal_residue(s: Column, r: Column) -> Column:
    """s^2 / (r (1 - r)), 0 if the window is empty or holds everything."""
    return F.when(_proper(r), s * s / (r * (1 - r))).otherwise(0.0)


def box_levels(s: Column, r: Column) -> Column:
    """Levels inside (l) and outside (h) of a box and its depth; null if degenerate."""
    low, high = s / r, -s / (1 - r)
    return F.when(_proper(r), F.struct(low.alias("l"), high.alias("h"), (high - low).alias("depth")))


def box_depth(s: Column, r: Column) -> Column:
    return F.when(_proper(r), -s / (1 - r) - s / r)


def dip_snr(s: Column, r: Column, n: Column) -> Column:
    """Signal to noise of a dip with unit errors, sqrt(n SR); 0 for brightenings."""
    return F.when(s < 0, F.sqrt(n * signal_residue(s, r))).otherwise(0.0)


def confidence(status: Column, sde: Column) -> Column:
    """A percentage for passed candidates, between 40 and 99; 0 for others."""
    return F.when(status == "PASSED", F.greatest(F.lit(40), F.least(F.lit(99), F.floor(sde / 15 * 100 + 0.5)))).otherwise(0).cast("int")


def checks(sigma: Column, ratio: Column, sde: Column) -> list[Column]:
    """The three lights of a candidate: odd/even, secondary, strength."""
    return [(sigma < 3.0).alias("odd_even_ok"), (ratio < 0.1).alias("secondary_ok"), (sde > 6.0).alias("sde_ok")]


def erfc_sql(x: str) -> str:
    """The complementary error function as an SQL expression of a column, for any engine.

    Below 2, one less the series of erf, whose terms are all positive; from 2 on, the continued fraction. About 13 digits.
    """
    a = f"abs({x})"
    series, fraction = "1", a
    for n in range(40, 0, -1):
        series = f"(1 + {a} * {a} * {2 / (2 * n + 1)!r}D * {series})"
        fraction = f"({a} + {n / 2}D / {fraction})"
    near = f"1 - {2 / math.sqrt(math.pi)!r}D * {a} * exp(-{a} * {a}) * {series}"
    far = f"exp(-{a} * {a}) * {1 / math.sqrt(math.pi)!r}D / {fraction}"
    up = f"CASE WHEN {a} < 2 THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} < 0 THEN 2 - ({up}) ELSE {up} END"


def false_alarm(sde: str, n: Column) -> Column:
    """Chance that the best of n independent periods reaches the SDE of a column: 1 - (1 - erfc(SDE / sqrt 2))^n, within [0, 1]; null for null.

    Written so that small chances keep their digits.
    """
    single = F.expr(f"transform(array({sde} / {math.sqrt(2)!r}D), x -> {erfc_sql('x')})[0]")
    return F.when(single >= 1, 1.0).otherwise(-F.expm1(n * F.log1p(-single)))
