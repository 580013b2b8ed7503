"""Box statistics by exhaustive trial: centres and durations in phase, two levels, residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipper.functions.phase import in_circular_box, in_plain_box
from dipper.operators import kernels, partial
from dipper.operators.lightcurve import with_joined, with_target_stats
from dipper.operators.selection import medians


def two_level_stats(n: Column, n_in: Column, total: Column, sum_in: Column, squares: Column) -> dict[str, Column]:
    """What the sums of a box say: means, depth, ssr, variance, snr, power, score = -ssr."""
    n_out = n - n_in
    mean_in, mean_out = sum_in / F.when(n_in > 0, n_in), (total - sum_in) / F.when(n_out > 0, n_out)
    variance = squares / n - (total / n) * (total / n)
    depth = mean_out - mean_in
    ssr = squares - n_in * mean_in * mean_in - n_out * mean_out * mean_out
    root = F.when(variance > 0, F.sqrt(F.when(variance > 0, variance)))
    return {"inside_mean": mean_in, "outside_mean": mean_out, "depth": depth, "ssr": ssr, "variance": variance, "snr": depth / root, "power": depth * depth * n_in / F.when(variance > 0, variance), "bls_score": -ssr}


def transit_statistics(folded: DataFrame, center: float, duration: float) -> DataFrame:
    """One row a target: the statistics of one box, if it holds and leaves out 5 points at least and is a dip."""
    inside = in_circular_box(F.col("phase"), F.lit(center), F.lit(duration))
    own = folded.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("n_inside"), F.sum("flux").alias("total"), F.sum(F.when(inside, F.col("flux"))).alias("sum_in"), F.sum(F.col("flux") * F.col("flux")).alias("squares"))
    rows = own.withColumns(two_level_stats(F.col("n"), F.col("n_inside"), F.col("total"), F.col("sum_in"), F.col("squares")))
    rows = rows.withColumn("n_outside", F.col("n") - F.col("n_inside")).where("n_inside >= 5 and n_outside >= 5 and depth > 0 and variance > 0")
    return rows.select("target", "depth", "snr", "power", "ssr", "bls_score", "inside_mean", "outside_mean", "n_inside", "n_outside")


def analyze_period(folded: DataFrame, keys: tuple[str, ...] = ("target",), centers: int = 300, durations: int = 15, lo: float = 0.01, hi: float = 0.05) -> DataFrame:
    """The box of least residuals among all centres and durations, for each key; ties to the first centre, then duration.

    Each point only meets the centres that a box around it can have, so trials of a point don't grow with the circle.
    """
    step = 1 / (centers - 1)
    reach = int(hi / 2 / step) + 1
    near = F.explode(F.sequence(F.floor(F.col("phase") / step).cast("int") - reach, F.floor(F.col("phase") / step).cast("int") + reach + 1)).alias("raw")
    # 0 and 1 are two centres at one place: places go round after centers - 1 steps
    turn = F.pmod(F.col("raw"), F.lit(centers - 1))
    trial = F.explode(F.when(turn == 0, F.array(F.lit(0), F.lit(centers - 1))).otherwise(F.array(turn))).alias("ci")
    points = folded.select(*keys, "phase", "flux", near).select(*keys, "phase", "flux", trial).select(*keys, "phase", "flux", "ci", F.explode(F.sequence(F.lit(0), F.lit(durations - 1))).alias("di"))
    center, duration = F.col("ci") * step, lo + F.col("di") * ((hi - lo) / (durations - 1))
    hit = points.where(in_circular_box(F.col("phase"), center, duration))
    boxes = hit.groupBy(*keys, "ci", "di").agg(F.count(F.lit(1)).alias("n_inside"), F.sum("flux").alias("sum_in"))
    whole = folded.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("total"), F.sum(F.col("flux") * F.col("flux")).alias("squares"))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"of_{k}"))
        match = same if match is None else match & same
    rows = boxes.join(whole, match).withColumns(two_level_stats(F.col("n"), F.col("n_inside"), F.col("total"), F.col("sum_in"), F.col("squares")))
    rows = rows.where("n_inside >= 5 and n - n_inside >= 5 and depth > 0 and variance > 0").withColumn("rounded", F.round("ssr", 4))
    best = rows.groupBy(*keys).agg(F.min(F.struct("rounded", "ci", "di", "snr", "power", "depth", "ssr", "n_inside")).alias("b"))
    return best.select(*keys, (F.col("b.ci") * step).alias("center"), (lo + F.col("b.di") * ((hi - lo) / (durations - 1))).alias("duration"), "b.snr", "b.power", "b.depth", "b.ssr", (-F.col("b.ssr")).alias("bls_score"), "b.n_inside")


FOUND = ("period", "frequency", "score", "depth", "duration", "center", "snr", "power", "transits")


def search_periods(lc: DataFrame, min_period: float, max_period: float, step: float | None = None, centers: int = 300, durations: int = 15, lo: float = 0.01, hi: float = 0.05, **options: int) -> DataFrame:
    """(target, period, frequency, score, ...): ``analyze_period`` of frequencies from 1 / max_period in steps, end excluded, with 3 transits at least.

    ``step``: by default each target's ``lo`` over its baseline, so that a narrowest box can't pass between two
    frequencies. A frequency's points are summed between neighbouring borders of all boxes, so boxes are sums of bins
    that hold just the points they'd hold. A point nearer than 1e-12 to a border counts as on it.
    """
    ci, di = (v.ravel() for v in np.meshgrid(np.arange(centers), np.arange(durations), indexing="ij"))
    center, duration = ci / (centers - 1), lo + di * ((hi - lo) / (durations - 1))
    left, right = (center - duration / 2 - 1e-12) % 1, (center + duration / 2 + 1e-12) % 1
    borders = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(borders, left) + 1, np.searchsorted(borders, right) + 1

    def trials(first: float, last: float) -> np.ndarray:
        if step is None and not last > first:
            return np.zeros(0)
        found = np.arange(1 / max_period, 1 / min_period, lo / (last - first) if step is None else step)
        return found[(last - first) * found >= 3]

    def sums(points: kernels.Ordered, own: np.ndarray, first: float) -> np.ndarray:
        m = len(borders) + 1
        out = np.zeros((len(own), 2, m + 1))
        out[:, 0, -1], out[:, 1, -1] = len(points.t), np.sum(points.x * points.x)
        for i, f in enumerate(own):
            of = lambda own, f=f: np.searchsorted(borders, own / (1 / f), "right")
            begins = points.begins(1 / f, np.concatenate([[0.0], borders]) * (1 / f), of)
            if begins is None:
                at = of(np.mod(points.t, 1 / f))
                out[i, 0, :-1], out[i, 1, :-1] = np.bincount(at, minlength=m), np.bincount(at, points.x, m)
            else:
                out[i, 0, :-1], out[i, 1, :-1] = points.counts(begins, m), points.totals("x", begins, m)
        return out

    def finish(total: np.ndarray, places: np.ndarray, own: np.ndarray, n: int, first: float, last: float) -> list[tuple]:
        found = []
        for f, (counts, fluxes) in zip(own, total.reshape(len(own), 2, -1), strict=True):
            (n_in, all_n), (s_in, all_s) = (_between(v[:-1], a, b) for v in (counts, fluxes))
            n_out = all_n - n_in
            ok = (n_in >= 5) & (n_out >= 5)
            with np.errstate(divide="ignore", invalid="ignore"):
                m_in, m_out = s_in / n_in, (all_s - s_in) / n_out
            variance = fluxes[-1] / all_n - (all_s / all_n) ** 2
            ok &= (m_out - m_in > 0) & (variance > 0)
            if not ok.any():
                continue
            # of flux less its mean, as are all sums: residues are the same
            ssr = np.where(ok, fluxes[-1] - n_in * m_in**2 - n_out * m_out**2, np.inf)
            i = int(np.argmin(np.round(ssr, 4)))
            depth = m_out[i] - m_in[i]
            power = depth * depth * n_in[i] / variance
            found.append((1 / f, f, power, depth, duration[i], center[i], depth / np.sqrt(variance), power, (last - first) * f))
        return found

    return partial.summed(lc, trials, sums, finish, FOUND, "target string, " + ", ".join(f"{c} double" for c in FOUND), prepare=lambda t, x, w, lo: (kernels.Ordered(t, x, w),), **options)


def _between(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of bins from ``a`` to before ``b``, around the circle; and the sum of all."""
    sums = np.concatenate([[0.0], np.cumsum(v)])
    return sums[b] - sums[a] + np.where(b < a, sums[-1], 0.0), float(sums[-1])


def box_score(folded: DataFrame, centers: int = 200, width: float = 0.05) -> DataFrame:
    """(target, score, center): the best depth over outside deviation of a plain box, over centres from 0 to the largest phase.

    A point only meets the centres that a box around it can have; what is outside comes from the target's totals.
    """
    about = F.avg("flux")
    rows = with_target_stats(folded, F.max("phase").alias("top"), about.alias("about"))
    x, step = F.col("flux") - F.col("about"), F.col("top") / (centers - 1)
    near = lambda way: F.floor((F.col("phase") + way * width / 2) / F.when(step > 0, step)).cast("int")
    at = F.sequence(F.greatest(F.lit(0), near(-1)), F.greatest(F.lit(0), F.least(F.lit(centers - 1), near(1) + 1)))
    trial = F.explode(F.when(step > 0, F.when(near(-1) <= centers - 1, at).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), F.lit(centers - 1))))
    points = rows.select("target", "phase", "top", x.alias("x"), trial.alias("ci"))
    hit = points.where(in_plain_box(F.col("phase"), F.col("ci") * F.col("top") / (centers - 1), F.lit(width)))
    own = hit.groupBy("target", "ci").agg(F.count(F.lit(1)).alias("n_in"), F.sum("x").alias("sum_in"), F.sum(F.col("x") * F.col("x")).alias("squares_in"))
    whole = rows.groupBy(F.col("target").alias("of_target")).agg(F.first("top").alias("top"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
    own = own.join(whole, F.col("target").eqNullSafe(F.col("of_target"))).where("n_in >= 5 and n > n_in")
    n_out = F.col("n") - F.col("n_in")
    mean_out = (F.col("total") - F.col("sum_in")) / n_out
    dev = F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("squares_in")) / n_out - mean_out * mean_out))
    own = own.withColumn("dev", dev).where("dev > 0").withColumn("score", F.round((mean_out - F.col("sum_in") / F.col("n_in")) / F.when(F.col("dev") > 0, F.col("dev")), 6))
    best = own.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("less"), "ci", "top")).alias("b"))
    return best.select("target", (-F.col("b.less")).alias("score"), (F.col("b.ci") * F.col("b.top") / (centers - 1)).alias("center"))


def transit_score(lc: DataFrame) -> DataFrame:
    """(target, score): how many deviations the minimum lies below the median; 0 for a constant."""
    own = with_joined(lc.groupBy("target").agg(F.min("flux").alias("low"), F.stddev_pop("flux").alias("dev")), medians(lc, ("target",), "flux", "m"))
    return own.select("target", F.when(F.col("dev") > 0, (F.col("m") - F.col("low")) / F.when(F.col("dev") > 0, F.col("dev"))).otherwise(0.0).alias("score"))


def count_statistic(prefix: DataFrame, start: int, end: int) -> DataFrame:
    """The count-based statistic of bins [start, end) from (target, k, flux_sum, count) prefix sums; dips with 5 points on both sides."""
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    own = prefix.groupBy("target").agg((at(end, "flux_sum") - at(start, "flux_sum")).alias("inside_flux"), (at(end, "count") - at(start, "count")).alias("inside_count"), F.max_by("flux_sum", "k").alias("total_flux"), F.max_by("count", "k").alias("total_count"))
    rows = own.withColumn("outside_count", F.col("total_count") - F.col("inside_count")).where("inside_count >= 5 and outside_count >= 5")
    rows = rows.withColumns({"inside_mean": F.col("inside_flux") / F.col("inside_count"), "outside_mean": (F.col("total_flux") - F.col("inside_flux")) / F.col("outside_count")}).withColumn("depth", F.col("outside_mean") - F.col("inside_mean")).where("depth > 0")
    r, s = F.col("inside_count") / F.col("total_count"), F.col("inside_count") * F.col("depth")
    return rows.select("target", "depth", "inside_mean", "outside_mean", "inside_count", "outside_count", (s * s / (r * (1 - r))).alias("sr"))
