"""Phases, epochs, and boxes in phase. Time is a number of days; a period is in days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phase(t: Column, period: Column) -> Column:
    """(t mod P) / P, in [0, 1); the divisor's sign counts, as in folding."""
    return F.pmod(t, period) / period


def epoch(t: Column, period: Column) -> Column:
    """Which cycle a time falls into."""
    return F.floor(t / period)


def epoch_parity(t: Column, period: Column) -> Column:
    """0 for even epochs, 1 for odd ones."""
    return F.pmod(epoch(t, period), F.lit(2)).cast("int")


def phase_bin(phi: Column, n_bins: int) -> Column:
    """The bin of a phase among ``n_bins`` equal ones; the last takes 1.0."""
    return F.greatest(F.lit(0), F.least(F.floor(phi * n_bins), F.lit(n_bins - 1))).cast("int")


def in_window(phi: Column, start: Column, width: Column, padding: float = 0.01) -> Column:
    """Whether a phase lies in a padded window that may wrap around."""
    a, b = start - padding, start + width + padding
    return F.when(b > 1, (phi >= a) | (phi < b - 1)).when(a < 0, (phi >= a + 1) | (phi < b)).otherwise((phi >= a) & (phi < b))


def in_circular_box(phi: Column, center: Column, duration: Column) -> Column:
    """Within half a duration of the centre, around the circle, borders included."""
    d = F.abs(phi - center)
    return F.least(d, 1 - d) <= duration / 2


def in_plain_box(phi: Column, center: Column, width: Column) -> Column:
    """Within half a width of the centre, not around the circle, borders excluded."""
    return F.abs(phi - center) < width / 2


def start_phase(mid_time: Column, duration: Column, period: Column) -> Column:
    """The phase at which a box with this middle begins."""
    return phase(mid_time - duration / 2, period)


def secondary_phase(start: Column) -> Column:
    """Half a cycle later."""
    return F.pmod(start + 0.5, F.lit(1.0))
