"""Vetting of candidates: depths of odd and even epochs, depth half a cycle later, and the status that follows.

All candidates of all targets are vetted in one pass over the points: each point meets its target's candidates, and
conditional sums by parity, combined before the shuffle, give every window's content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipper.functions.phase import epoch_parity, phase, phase_bin, secondary_phase
from dipper.functions.scores import finite
from dipper.operators.lightcurve import with_joined
from dipper.sources.store import kept

#: The status of a candidate that can't be tested at all.
UNUSABLE = "ERROR (Unusable Box)"


def _window_bins(start: Column, width: Column, n_bins: int) -> tuple[Column, Column]:
    return F.floor(start * n_bins).cast("int"), F.floor(width * n_bins).cast("int")


def _in_bins(b: Column, start: Column, width: Column, n_bins: int) -> Column:
    end = start + width
    return F.when(end <= n_bins, (b >= start) & (b < end)).otherwise((b >= start) | (b < end - n_bins))


def _depth(n_in: Column, sum_in: Column, n: Column, total: Column) -> Column:
    """|depth| of a box from counts and sums of flux, with uniform weights; null if degenerate."""
    proper = (n_in > 0) & (n_in < n)
    inside, outside = sum_in / F.when(n_in > 0, n_in), (total - sum_in) / F.when(n > n_in, n - n_in)
    return F.when(proper, F.abs(outside - inside))


def vet(lc: DataFrame, candidates: DataFrame, n_bins: int = 400, odd_even_limit: float = 3.0, secondary_limit: float = 0.1) -> DataFrame:
    """Candidates with depths, ``odd_even_diff_sigma``, ``secondary_ratio`` and ``status``.

    ``candidates``: (target, peak_rank, period, phase_start, phase_width, depth, is_harmonic, ...). A test that can't be
    made (an empty window, one parity only) doesn't reject, and gives 0. A test after a rejection isn't made: null.
    Points whose time or flux isn't finite are left out. A candidate whose box isn't one (a period that isn't above 0, a
    phase that isn't finite) has no tests and the status ``UNUSABLE``; the others go on.
    """
    usable = F.coalesce(finite(F.col("period")) & (F.col("period") > 0) & finite(F.col("phase_start")) & finite(F.col("phase_width")), F.lit(False))
    points = lc.where(finite(F.col("t")) & finite(F.col("flux"))).select(F.col("target").alias("of_target"), "t", "flux")
    rest = [c for c in candidates.columns if c not in ("target", "peak_rank")]
    candidates = kept(candidates)  # few rows, read twice
    boxes = candidates.select("target", "peak_rank", *(F.when(usable, F.col(c)).alias(f"usable_{c}") for c in ("period", "phase_start", "phase_width")))
    # an inner join: the few boxes can be broadcast, or a large target's points split, where a left one would bring a target to one task
    points = points.join(boxes, F.col("target").eqNullSafe(F.col("of_target")))
    period, at, long = F.col("usable_period"), F.col("usable_phase_start"), F.col("usable_phase_width")
    b = phase_bin(phase(F.col("t"), period), n_bins)
    start, width = _window_bins(at, long, n_bins)
    second, _ = _window_bins(secondary_phase(at), long, n_bins)
    points = points.select("target", "peak_rank", "flux", epoch_parity(F.col("t"), period).alias("odd"), _in_bins(b, start, width, n_bins).alias("primary"), _in_bins(b, second, width, n_bins).alias("secondary"))
    sums = []
    for name, where in (("odd", F.col("odd") == 1), ("even", F.col("odd") == 0)):
        sums += [F.count(F.when(where, 1)).alias(f"n_{name}"), F.sum(F.when(where, F.col("flux"))).alias(f"f_{name}"), F.count(F.when(where & F.col("primary"), 1)).alias(f"in_{name}"), F.coalesce(F.sum(F.when(where & F.col("primary"), F.col("flux"))), F.lit(0.0)).alias(f"g_{name}")]
    sums += [F.count("flux").alias("n_all"), F.sum("flux").alias("f_all"), F.count(F.when(F.col("secondary"), 1)).alias("in_second"), F.coalesce(F.sum(F.when(F.col("secondary"), F.col("flux"))), F.lit(0.0)).alias("g_second")]
    own = with_joined(candidates, points.groupBy("target", "peak_rank").agg(*sums), keys=("target", "peak_rank"))
    col = F.col
    rows = own.select("target", "peak_rank", *rest, _depth(col("in_odd"), col("g_odd"), col("n_odd"), col("f_odd")).alias("depth_odd"), _depth(col("in_even"), col("g_even"), col("n_even"), col("f_even")).alias("depth_even"), _depth(col("in_second"), col("g_second"), col("n_all"), col("f_all")).alias("secondary_depth"))
    mean = (col("depth_odd") + col("depth_even")) / 2
    sigma = F.coalesce(F.when(mean == 0, 0.0).otherwise(F.abs(col("depth_odd") - col("depth_even")) / F.when(mean != 0, mean) / 0.1), F.lit(0.0))
    ratio = F.coalesce(F.when(col("depth") != 0, col("secondary_depth") / F.when(col("depth") != 0, F.abs(col("depth")))), F.lit(0.0))
    rows = rows.withColumns({"odd_even_diff_sigma": F.when(usable & ~col("is_harmonic"), sigma), "secondary_ratio": F.when(usable & ~col("is_harmonic") & (sigma <= odd_even_limit), ratio)})
    # fixed values: the texts of the status
    status = F.when(~usable, UNUSABLE).when(col("is_harmonic"), "REJECTED (Harmonic Alias)").when(col("odd_even_diff_sigma") > odd_even_limit, "REJECTED (Odd/Even Mismatch)").when(col("secondary_ratio") > secondary_limit, "REJECTED (Secondary Eclipse)").otherwise("PASSED")
    return rows.withColumn("status", status)


def best_passed(vetted: DataFrame) -> DataFrame:
    """The first passed candidate of each target."""
    rest = [c for c in vetted.columns if c not in ("target", "peak_rank")]
    first = F.min(F.struct("peak_rank", *rest)).alias("b")
    return vetted.where("status = 'PASSED'").groupBy("target").agg(first).select("target", "b.peak_rank", *[F.col("b")[c].alias(c) for c in rest])
