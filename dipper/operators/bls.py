"""Box search over trial periods: as built-in functions for small grids, as a grouped kernel for full ones.

The SQL form takes each point to its phase bin for each period (an explode, summed on the map side), fills empty bins,
lays two cycles in a row, and sums boxes of all widths with sliding frames of one window operator: no range join, and
no join of prefix sums with themselves. The kernel form deals (target, chunk of periods) groups to NumPy.
Scores compare after rounding to 6 digits; ties go to the narrower, then the earlier box, then the shorter period.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipper.functions.phase import phase, phase_bin
from dipper.functions.scores import box_depth, dip_snr, signal_residue
from dipper.operators import kernels, partial
from dipper.operators.lightcurve import with_joined, with_weights

#: Ratios of periods that count as harmonics.
HARMONICS = (0.5, 2.0, 1 / 3, 3.0, 2 / 3, 1.5, 0.25, 4.0)


#: Durations in days that the live flow tries.
DURATIONS = tuple(np.linspace(0.05, 0.3, 30).tolist())


def period_grid(baseline: DataFrame, min_duration: float, max_duration: float, min_period: float | None = None, max_period: float | None = None, transits: int = 3, factor: float = 1.0) -> DataFrame:
    """(target, pid, period): for each (target, baseline) its grid, uniform in frequency, by ascending period."""
    if max_period is None and transits <= 1:
        raise ValueError("transits must be more than 1")
    shortest = F.lit(2.0 * max_duration if min_period is None else float(min_period))
    longest = F.col("baseline") / (transits - 1) if max_period is None else F.lit(float(max_period))
    rows = baseline.select("target", "baseline", shortest.alias("p_lo"), longest.alias("p_hi")).where("p_hi >= p_lo and baseline > 0")
    rows = rows.withColumn("step", F.lit(factor * min_duration) / (F.col("baseline") * F.col("baseline")))
    last = F.ceil((1 / F.col("p_lo") - 1 / F.col("p_hi")) / F.col("step")).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("i")).withColumn("period", 1 / (1 / F.col("p_hi") + F.col("step") * F.col("i")))
    kept = rows.where("period between p_lo and p_hi")
    by = Window.partitionBy("target").orderBy("period")
    return kept.select("target", (F.row_number().over(by) - 1).cast("long").alias("pid"), "period")


def explicit_period(pid: Column) -> Column:
    """The small grid of the queries: 1 / (0.1 + 0.01 pid)."""
    return 1 / (0.1 + 0.01 * pid)


def duration_grid(n_bins: int, min_fraction: Column, max_fraction: Column) -> tuple[Column, Column]:
    """Narrowest and widest box in bins."""
    lo = F.greatest(F.lit(1), F.floor(min_fraction * n_bins).cast("int"))
    return lo, F.least(F.greatest(lo + 1, F.ceil(max_fraction * n_bins).cast("int")), F.lit(n_bins // 2))


def histogram(weighted: DataFrame, n_periods: int, n_bins: int, period: Column | None = None) -> DataFrame:
    """(target, pid, bin, s, r): sums of w x and w in each phase bin of each of ``n_periods`` periods; dense."""
    points = weighted.select("target", "t", "x", "w", F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))).alias("pid"))
    p = explicit_period(F.col("pid")) if period is None else period
    sums = points.groupBy("target", "pid", phase_bin(phase(F.col("t"), p), n_bins).alias("bin")).agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("r"))
    pairs = sums.select("target", "pid").distinct()
    grid = pairs.select("target", "pid", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    sums = sums.withColumnsRenamed({"target": "of_target", "pid": "of_pid", "bin": "of_bin"})
    same = F.col("target").eqNullSafe(F.col("of_target")) & (F.col("pid") == F.col("of_pid")) & (F.col("bin") == F.col("of_bin"))
    return grid.join(sums, same, "left").select("target", "pid", "bin", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("r", F.lit(0.0)).alias("r"))


def prefix_sums(hist: DataFrame) -> DataFrame:
    """(target, pid, k, pf, pr): sums of the first k bins, from k = 0."""
    by = Window.partitionBy("target", "pid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.select("target", "pid", (F.col("bin") + 1).alias("k"), F.sum("s").over(by).alias("pf"), F.sum("r").over(by).alias("pr"))
    zero = hist.where("bin = 0").select("target", "pid", F.lit(0).alias("k"), F.lit(0.0).alias("pf"), F.lit(0.0).alias("pr"))
    return sums.unionByName(zero)


def bins_of_prefix(prefix: DataFrame) -> DataFrame:
    """(target, pid, bin, s, r) back from ``prefix_sums``."""
    by = Window.partitionBy("target", "pid").orderBy("k")
    rows = prefix.select("target", "pid", "k", (F.col("pf") - F.lag("pf").over(by)).alias("s"), (F.col("pr") - F.lag("pr").over(by)).alias("r"))
    return rows.where("k > 0").select("target", "pid", (F.col("k") - 1).alias("bin"), "s", "r")


def boxes(hist: DataFrame, n_bins: int, min_width: int, max_width: int) -> DataFrame:
    """(target, pid, start, width, s, r) of every circular box."""
    two = hist.select("target", "pid", "bin", "s", "r").unionByName(hist.where(F.col("bin") < max_width).select("target", "pid", (F.col("bin") + n_bins).alias("bin"), "s", "r"))
    by = Window.partitionBy("target", "pid").orderBy("bin")
    wide = F.array(*[F.struct(F.lit(w).alias("width"), F.sum("s").over(by.rowsBetween(0, w - 1)).alias("s"), F.sum("r").over(by.rowsBetween(0, w - 1)).alias("r")) for w in range(min_width, max_width + 1)])
    return two.select("target", "pid", "bin", wide.alias("box")).where(F.col("bin") < n_bins).select("target", "pid", F.col("bin").alias("start"), F.inline("box"))


def best_boxes(found: DataFrame, n_bins: int, dips: bool = False) -> DataFrame:
    """(target, pid, start, width, s, r, sr): the best box of each period; ``dips``: brightenings don't count."""
    ok = found.where("r > 1e-12D and r < 1 - 1e-12D" + " and s < 0" * dips).withColumn("sr", F.round(signal_residue(F.col("s"), F.col("r")), 6))
    first = F.min(F.struct((-F.col("sr")).alias("less"), "width", "start", "s", "r")).alias("b")
    return ok.groupBy("target", "pid").agg(first).select("target", "pid", "b.start", "b.width", "b.s", "b.r", (-F.col("b.less")).alias("sr"))


def periodogram(lc: DataFrame, n_periods: int = 64, n_bins: int = 100, min_width: int = 1, max_width: int = 8, dips: bool = False) -> DataFrame:
    """(target, pid, period, start, width, s, r, depth, sr) on the small grid."""
    best = best_boxes(boxes(histogram(with_weights(lc), n_periods, n_bins), n_bins, min_width, max_width), n_bins, dips)
    return best.select("target", "pid", explicit_period(F.col("pid")).alias("period"), "start", "width", "s", "r", box_depth(F.col("s"), F.col("r")).alias("depth"), "sr")


def best_period(power: DataFrame) -> DataFrame:
    """The best row of each target by ``sr``, ties to the least pid."""
    rest = [c for c in power.columns if c not in ("target", "pid", "sr")]
    best = F.min(F.struct((-F.col("sr")).alias("less"), "pid", *rest)).alias("b")
    return power.groupBy("target").agg(best).select("target", "b.pid", *[F.col("b")[c].alias(c) for c in rest], (-F.col("b.less")).alias("sr"))


def with_sde(power: DataFrame) -> DataFrame:
    """Adds ``sde``: how many population deviations a period's sr lies above the target's mean; 0 if all are alike."""
    by = Window.partitionBy("target")  # a target's periods; the same dealing as in ``peaks``
    rows = power.withColumns({"sr_mean": F.avg("sr").over(by), "sr_dev": F.stddev_pop("sr").over(by)})
    return rows.withColumn("sde", F.when(F.col("sr_dev") > 0, (F.col("sr") - F.col("sr_mean")) / F.when(F.col("sr_dev") > 0, F.col("sr_dev"))).otherwise(0.0)).drop("sr_mean", "sr_dev")


def peaks(power: DataFrame, threshold: float = 6.0) -> DataFrame:
    """Rows above the threshold and both neighbours by period, with ``peak_rank`` (from 1) within the target.

    End points only need to beat their one neighbour, and rank behind inner ones of the same sde. Targets with fewer
    than three periods have none.
    """
    by = Window.partitionBy("target").orderBy("period")
    rows = power.withColumns({"before": F.lag("sde").over(by), "after": F.lead("sde").over(by), "place": F.row_number().over(by), "n_periods": F.count(F.lit(1)).over(Window.partitionBy("target"))})
    higher = (F.col("before").isNull() | (F.col("sde") > F.col("before"))) & (F.col("after").isNull() | (F.col("sde") > F.col("after")))
    end = F.when(F.col("before").isNull(), 1).when(F.col("after").isNull(), 2).otherwise(0)
    rows = rows.where((F.col("n_periods") >= 3) & (F.col("sde") > threshold) & higher).withColumn("end_point", end)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("sde"), "end_point", "place"))
    return rows.withColumn("peak_rank", rank).drop("before", "after", "place", "n_periods", "end_point")


def flag_harmonics(candidates: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Adds ``is_harmonic``: in order of rank, a period near a simple ratio of an unflagged, stronger one is flagged.

    The order matters, so each target's ranked periods are folded once, in an array; it holds peaks only.
    """
    rest = [c for c in candidates.columns if c not in ("target", "peak_rank")]
    ranked = candidates.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("peak_rank", *rest))).alias("ranked"))
    near = lambda p, q: F.exists(F.array(*map(F.lit, HARMONICS)), lambda h: F.abs(p / q - h) < tolerance * h)
    empty = F.array().cast("array<struct<peak_rank:int,period:double>>")
    keep = F.aggregate("ranked", empty, lambda kept, c: F.when(F.exists(kept, lambda k: near(c["period"], k["period"])), kept).otherwise(F.array_append(kept, F.struct(c["peak_rank"].alias("peak_rank"), c["period"].alias("period")))))
    ranked = ranked.withColumn("kept_ranks", F.transform(keep, lambda k: k["peak_rank"]))
    flagged = F.transform("ranked", lambda c: F.struct(c["peak_rank"].alias("peak_rank"), *[c[x].alias(x) for x in rest], (~F.array_contains("kept_ranks", c["peak_rank"])).alias("is_harmonic")))
    return ranked.select("target", F.inline(flagged))


def snr_objective(power: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``power``: sqrt(n sr) of the best dip; ``counts``: (target, n)."""
    return with_joined(power, counts, "inner").withColumn("power", dip_snr(F.col("s"), F.col("r"), F.col("n")))


FIT_SCHEMA = "target string, pid long, period double, start int, width int, phase_start double, phase_width double, duration_days double, s double, r double, l double, h double, depth double, sr double"


def linear_periods(spark: SparkSession, lo: float, hi: float, n: int = 10_000) -> DataFrame:
    """(pid, period): n periods in equal steps, both ends included, as for ``search``."""
    return spark.range(n).select(F.col("id").alias("pid"), (lo + F.col("id") * ((hi - lo) / max(n - 1, 1))).alias("period"))


def _grid(first: float, last: float, min_duration: float, max_duration: float, min_period: float | None, max_fraction: float | None) -> np.ndarray:
    """A target's own periods, by its first and last time."""
    baseline = last - first
    return kernels.period_grid(baseline, min_duration, max_duration, min_period, None if max_fraction is None else baseline * max_fraction) if baseline > 0 else np.zeros(0)


def search(lc: DataFrame, periods: DataFrame | None = None, n_bins: int = 400, min_duration: float = 0.05, max_duration: float = 0.25, min_period: float | None = None, max_fraction: float | None = None, chunks: int | None = None, dips: bool = False, objective: str = "sr", block: int = partial.BLOCK, error: str | None = None, errors: bool = False) -> DataFrame:
    """FIT_SCHEMA rows: the best box of each period of full grids, by the kernel.

    Each light curve goes to ``chunks`` times its blocks of ``block`` points (once where blocks outnumber tasks); blocks share its points out, chunks its
    periods, and the phase histograms of blocks are added up (``partial.summed``).
    ``periods``: (pid, period) for all targets, a small table; else each target has its own grid, up to
    ``max_fraction`` of its baseline. ``objective``: ``sr``, or ``snr`` (sqrt(n sr) of dips). ``error``: the column of
    errors that points are weighted by. ``errors``: as in ``partial.summed``.
    """
    explicit = None if periods is None else [(r["pid"], r["period"]) for r in periods.select("pid", "period").orderBy("pid").collect()]
    only_dips = dips or objective == "snr"

    def trials(first: float, last: float) -> np.ndarray:
        if explicit is not None:
            return np.array([p for _, p in explicit])
        return _grid(first, last, min_duration, max_duration, min_period, max_fraction)

    def sums(points: kernels.Ordered, own: np.ndarray, first: float) -> np.ndarray:
        return np.array([points.histogram(p, n_bins) for p in own])

    def finish(total: np.ndarray, places: np.ndarray, own: np.ndarray, n: int, first: float, last: float) -> list[tuple]:
        pids = places if explicit is None else [explicit[i][0] for i in places]
        found = [kernels.fit(pid, p, s, r, min_duration, max_duration, only_dips) for pid, p, (s, r) in zip(pids, own, total.reshape(len(own), 2, n_bins), strict=True)]
        return [(*f[:-1], np.sqrt(n * f[-1]) if objective == "snr" else f[-1]) for f in found if f]

    return partial.summed(lc, trials, sums, finish, ("pid", *kernels.FIT_FIELDS), FIT_SCHEMA, chunks, block, error, errors, lambda t, x, w, lo: (kernels.Ordered(t, x, w),))


LIVE_FIELDS = ("pid", "period", "duration_days", "transit_time", "phase_start", "phase_width", "depth", "sr")
LIVE_SCHEMA = "target string, pid long, " + ", ".join(f"{c} double" for c in LIVE_FIELDS[1:])


def live_search(lc: DataFrame, durations: tuple[float, ...] = DURATIONS, min_period: float = 0.5, max_fraction: float = 1 / 3, periods: list[float] | None = None, oversample: int = 10, chunks: int | None = None, block: int = partial.BLOCK, errors: bool = False) -> DataFrame:
    """LIVE_SCHEMA rows: the best dip of each period among given durations, by signal to noise (in ``sr``), with its middle.

    Bins are the shortest duration over ``oversample`` wide and begin at the target's first time; a box is a whole number
    of bins, around the cycle. Points count alike: snr = depth / sqrt(1 / n inside + 1 / n outside). Ties go to the
    earlier duration, then bin. ``transit_time`` is the first middle after the first time; the start phase follows from it.
    ``periods``: for all targets; else each target's grid, uniform in frequency, up to a fraction of its baseline.
    ``errors``: as in ``partial.summed``.
    """
    width = min(durations) / oversample
    spans = np.array([max(1, round(d / width)) for d in durations])

    def trials(first: float, last: float) -> np.ndarray:
        if periods is not None:
            return np.array(periods, float)
        return kernels.period_grid(last - first, min(durations), max(durations), min_period, (last - first) * max_fraction) if last > first else np.zeros(0)

    def bins(p: float) -> int:
        return int(np.ceil(p / width))

    def sums(points: kernels.Ordered, own: np.ndarray, first: float) -> np.ndarray:
        out = []
        for p in own:
            m = bins(p)
            of = lambda own, m=m: np.minimum((own / width).astype(np.int64), m - 1)
            begins = points.begins(p, np.arange(m) * width, of)
            if begins is None:
                at = of(np.mod(points.t, p))
                out += [np.bincount(at, points.x, m), np.bincount(at, minlength=m).astype(float)]
            else:
                out += [points.totals("x", begins, m), points.counts(begins, m).astype(float)]
        return np.concatenate(out) if out else np.zeros(0)

    def finish(total: np.ndarray, places: np.ndarray, own: np.ndarray, n: int, first: float, last: float) -> list[tuple]:
        found, done = [], 0
        for pid, p in zip(places, own, strict=True):
            m = bins(p)
            x, count = total[done : done + m], total[done + m : done + 2 * m]
            done += 2 * m
            best = kernels.best_dip(x, count, spans)
            if best is None:
                continue
            i, k, depth, snr = best
            middle = first + (i + spans[k] / 2) * width
            found.append((pid, p, durations[k], first + np.mod(middle - first, p), np.mod(middle - durations[k] / 2, p) / p, durations[k] / p, depth, snr))
        return found

    return partial.summed(lc, trials, sums, finish, LIVE_FIELDS, LIVE_SCHEMA, chunks, block, errors=errors, prepare=lambda t, x, w, lo: (kernels.Ordered(t - lo, x, w),))


def search_per_target(lc: DataFrame, **options: float) -> DataFrame:
    """``search`` with the live flow's defaults: periods from 0.5 days to a third of the baseline, dips by snr."""
    return search(lc, **({"min_duration": 0.05, "max_duration": 0.3, "min_period": 0.5, "max_fraction": 1 / 3, "objective": "snr"} | options))


#: Values of shuffled curves that a task holds at once.
SHUFFLED = 4_000_000


def shuffled_best(lc: DataFrame, rounds: int, trials: Callable[[float, float], np.ndarray], spans: Callable[[float], range], order: Callable[[int, int], np.ndarray], n_bins: int, per_task: int = 50, chunks: int | None = None, error: str | None = None, dips: bool = False) -> DataFrame:
    """(target, round, best): the best score of each shuffle of a target's flux over its trial periods.

    Work is dealt in tiles of ``per_task`` rounds, or more where there are groups for all cores, and one of ``chunks`` shares of
    the periods; where (target, tile) groups outnumber tasks, there is one share. A tile holds its light curve whole, as a shuffle is over all points; its shuffles
    are taken so many at a time that they fit ``SHUFFLED`` values. ``trials(first, last)``: periods; ``spans(period)``:
    widths in bins; ``order(n, k)``: places of n points in round k.
    """
    groups = partial.copies_for(lc)
    tiles = max(1, min(-(-rounds // per_task), groups))
    chunks = max(1, -(-groups // tiles)) if chunks is None else chunks
    values = ("t", "flux") if error is None else ("t", "flux", "error")
    curves = partial.packed(lc.select("target", "t", "flux", *([] if error is None else [F.col(error).alias("error")])), ("target",), (), values)
    curves = curves.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    curves = curves.repartition(partial.SHARES * int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target", "tile", "chunk")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        points = partial.unpacked(part["points"], len(values))
        points = points[:, np.lexsort((points[1], points[0]))]
        t, flux = points[:2]
        errors = None if error is None else points[2]
        own = list(range(key[1], rounds, tiles))
        periods = trials(t[0], t[-1])[key[2] :: chunks]
        orders = [functools.partial(order, len(t), k) for k in own]
        best = kernels.shuffled_best(t, flux, orders, periods, [spans(p) for p in periods], n_bins, errors, dips, max(1, SHUFFLED // len(t)))
        return pd.DataFrame({"target": key[0], "round": own, "best": best})

    tiled = curves.groupBy("target", "tile", "chunk").applyInPandas(run, "target string, round int, best double")
    return tiled.groupBy("target", "round").agg(F.max("best").alias("best"))


def bootstrap_fap(lc: DataFrame, observed: DataFrame, rounds: int = 1000, seed: int = 1, n_periods: int = 64, n_bins: int = 100, min_width: int = 1, max_width: int = 8, per_task: int = 50, error: str | None = None) -> DataFrame:
    """(target, fap, rounds): the share of shuffles of the flux whose best sr reaches the observed one, on the small grid.

    ``observed``: (target, sr) of a search of the same grid. Shuffles are by a seed of their round, so a rerun gives the
    same. ``error``: a column of errors, which stay where they are while fluxes are shuffled.
    """
    periods = 1 / (0.1 + 0.01 * np.arange(n_periods))
    order = lambda n, k: np.random.default_rng([seed, k]).permutation(n)
    return exceedance(shuffled_best(lc, rounds, lambda first, last: periods, lambda p: range(min_width, max_width + 1), order, n_bins, per_task, error=error), observed)


def search_shuffles(lc: DataFrame, rounds: int = 1000, periods: list[float] | None = None, n_bins: int = 400, min_duration: float = 0.05, max_duration: float = 0.25, min_period: float | None = None, max_fraction: float | None = None, seed: int = 1, per_task: int = 50, chunks: int | None = None, error: str | None = None, dips: bool = False) -> DataFrame:
    """(target, round, best): the best sr of ``search`` on each of ``rounds`` shuffles of the flux, over that search's own periods and widths.

    Options are those of ``search``. The order of round k is ``kernels.hashed_order``, so a rerun, and SQL, give the same.
    """

    def trials(first: float, last: float) -> np.ndarray:
        return np.array(periods, float) if periods is not None else _grid(first, last, min_duration, max_duration, min_period, max_fraction)

    def spans(period: float) -> range:
        return kernels.widths(*kernels.duration_fractions(period, min_duration, max_duration), n_bins)

    return shuffled_best(lc, rounds, trials, spans, lambda n, k: kernels.hashed_order(n, k, seed), n_bins, per_task, chunks, error, dips)


def search_fap(lc: DataFrame, observed: DataFrame, rounds: int = 1000, **options: float) -> DataFrame:
    """(target, fap, rounds): the share of ``search_shuffles`` that reach the observed (target, sr) of a search with the same options."""
    return exceedance(search_shuffles(lc, rounds, **options), observed)


def exceedance(best: DataFrame, observed: DataFrame) -> DataFrame:
    """(target, fap, rounds): the share of the ``best`` of a target's rounds that reach its observed ``sr``."""
    rows = with_joined(best.select("target", "best"), observed.select("target", "sr"), "inner")
    return rows.groupBy("target").agg(F.avg((F.col("best") >= F.col("sr")).cast("double")).alias("fap"), F.count(F.lit(1)).alias("rounds"))


def compare_results(ours: DataFrame, theirs: DataFrame, keys: tuple[str, ...] = ("quantity",)) -> DataFrame:
    """(keys, ours, theirs, abs_diff, rel_diff) of two (keys, value) tables; infinite where their value isn't positive."""
    a, b = ours.withColumnRenamed("value", "ours"), theirs.withColumnRenamed("value", "theirs")
    d = F.abs(F.col("ours") - F.col("theirs"))
    return with_joined(a, b, "inner", keys).select(*keys, "ours", "theirs", d.alias("abs_diff"), F.when(F.col("theirs") > 0, d / F.when(F.col("theirs") > 0, F.col("theirs"))).otherwise(float("inf")).alias("rel_diff"))
