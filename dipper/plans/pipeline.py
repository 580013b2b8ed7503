"""The batch flow over all targets at once, as a list of stages: photometry, cleaning, search, vetting, report.

Tables go by name from stage to stage. A target that fails in a stage (no finite pixel, a light curve that can't be
cleaned or searched, a box that can't be tested) has a row in ``errors`` and one without a candidate in the report; the
others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipper.operators import bls, photometry, report, vetting
from dipper.operators.detrend import CLEAN_COLUMNS, detrend, detrend_around, fits
from dipper.operators.lightcurve import clip_upper, filter_nan, filter_quality, with_joined
from dipper.sources.store import kept, small

#: Tables by name; a stage takes those so far and gives those it adds.
Tables = dict[str, DataFrame]
Stage = tuple[str, Callable[[Tables], Tables]]


def photometry_stage(pixels: DataFrame, cadences: DataFrame, sigmas: tuple[float, ...] = photometry.SIGMAS) -> DataFrame:
    """(target, t, flux, quality) of the best aperture, over its median. ``cadences``: (target, cadence, t, quality)."""
    trials, _, flux = photometry.measure_apertures(pixels, sigmas)
    best = trials.where("is_best").select("target", "sigma")
    return filter_quality(with_joined(with_joined(flux, best, "inner", ("target", "sigma")), cadences, "inner", ("target", "cadence")).select("target", "t", "flux", "quality"))


def clean(lc: DataFrame, window: int = 151, sigma: float = 5.0, masked: bool = False, min_period: float = 0.5, periods: DataFrame | None = None, pairs: bool = False) -> DataFrame:
    """CLEAN_COLUMNS: detrended and clipped light curves; or one row with an error.

    ``masked``: leave the strongest box, of periods from ``min_period`` on, or of given (pid, period) ``periods``, out of
    the trend; it is searched as in ``bls.search``, by many tasks a target. ``pairs``: as in ``detrend_around``.
    """
    lc = filter_nan(lc)
    fit = fits(lc)
    flat = kept(detrend(lc, window, fit=fit))
    if masked:
        good = flat.where("error is null").select("target", "t", "flux")
        found = bls.search(good, periods, n_bins=200, min_duration=0.05, max_duration=0.3, min_period=min_period, max_fraction=1 / 3)
        # kept, as the steps that read the boxes would each search again
        boxes = small(bls.best_period(found).where("sr >= 1e-6D").select("target", "period", "phase_start", "phase_width"))
        failed = small(flat.where("error is not null"))
        flat = kept(detrend_around(with_joined(lc, failed.select("target"), "left_anti"), boxes, window, pairs=pairs, fit=fit).unionByName(failed))
    good = flat.where("error is null")
    return clip_upper(good, sigma, whole=fits(good)).select(*CLEAN_COLUMNS).unionByName(flat.where("error is not null").select(*CLEAN_COLUMNS))


def flatten_and_search(lc: DataFrame, window: int = 401, duration: float = 0.1, **options: float) -> DataFrame:
    """The short way from raw light curves to a periodogram: no NaN, no outliers on either side, a wide flattening of second order, one duration."""
    flat = detrend(clip_upper(filter_nan(lc), both=True), window, order=2, rounds=3, gap=0.5).where("error is null")
    return bls.live_search(kept(flat.select("target", "t", "flux")), (duration,), **options)


def search_stage(lc: DataFrame, threshold: float = 3.0, **options: float) -> tuple[DataFrame, DataFrame]:
    """(periodogram with sde, ranked candidates with harmonics flagged)."""
    power = bls.with_sde(bls.search_per_target(lc, **options))
    return power, bls.flag_harmonics(bls.peaks(power, threshold))


def measure(tables: Tables) -> Tables:
    """``raw`` light curves of the best apertures, from ``pixels`` and ``cadences``; ``targets``: all, with or without a light curve."""
    return {"raw": kept(photometry_stage(tables["pixels"], tables["cadences"])), "targets": tables["pixels"].select("target").distinct()}


def clean_up(tables: Tables) -> Tables:
    """``clean`` light curves, or errors, from ``raw`` ones."""
    return {"clean": kept(clean(filter_quality(tables["raw"])))}


def search(tables: Tables, **options: float) -> Tables:
    """``power`` and raw ``candidates`` of what is clean, and ``unsearched`` targets with their error, which have no rows in either."""
    found = kept(bls.with_sde(bls.search_per_target(tables["clean"].where("error is null").select("target", "t", "flux"), errors=True, **options)))
    failed = found.where("error is not null").groupBy("target").agg(F.min("error").alias("error"))
    power = with_joined(found, failed.select("target"), "left_anti").drop("error")
    return {"power": power, "candidates": bls.flag_harmonics(bls.peaks(power, 3.0)), "unsearched": failed}


def vet(tables: Tables) -> Tables:
    """``candidates`` with their tests, and the ``best`` of each target."""
    candidates = kept(report.with_confidence(vetting.vet(tables["clean"].where("error is null").select("target", "t", "flux"), tables["candidates"])))
    return {"candidates": candidates, "best": vetting.best_passed(candidates)}


def summarize(tables: Tables) -> Tables:
    """The batch ``report``, a row for each of ``targets``, where photometry gave them, else for each of ``raw``; and ``errors``: (target, stage, error)."""
    targets = tables["targets"] if "targets" in tables else tables["raw"].select("target").distinct()
    unmeasured = with_joined(targets, tables["raw"].select("target").distinct(), "left_anti").withColumn("error", F.lit("no light curve from its pixels"))
    failed = [("photometry", unmeasured)]
    failed += [("cleaning", tables["clean"].where("error is not null"))] if "clean" in tables else []
    failed += [("search", tables["unsearched"])] if "unsearched" in tables else []
    unusable = tables["candidates"].where(F.col("status") == vetting.UNUSABLE) if "candidates" in tables and "status" in tables["candidates"].columns else None
    failed += [("vetting", unusable.select("target", F.col("status").alias("error")))] if unusable is not None else []
    errors = reduce(DataFrame.unionByName, [rows.select("target", F.lit(stage).alias("stage"), "error") for stage, rows in failed]).distinct()
    return {"report": report.batch_report(targets, tables["best"]), "errors": errors}


STAGES: list[Stage] = [("cleaning", clean_up), ("search", search), ("vetting", vet), ("report", summarize)]
PIXEL_STAGES: list[Stage] = [("photometry", measure), *STAGES]


def compose(tables: Tables, stages: list[Stage], progress: Callable[[str, str], None] = lambda stage, status: None) -> Tables:
    """All tables, after each stage in turn. Stages may be any functions of that form, in any order that has what they need.

    ``progress`` is called with ``running`` and ``complete`` for each stage. If a stage fails, it is told ``error``, and what
    there is so far is returned.
    """
    tables = dict(tables)
    for name, stage in stages:
        progress(name, "running")
        try:
            tables |= stage(tables)
        except Exception as e:  # noqa: BLE001
            progress(name, f"error: {e}")
            break
        progress(name, "complete")
    return tables


def run(lc: DataFrame, progress: Callable[[str, str], None] = lambda stage, status: None, **options: float) -> Tables:
    """All results from raw light curves: clean, power, candidates (vetted), best, report, errors. A failing stage raises, a failing target doesn't."""

    def told(stage: str, status: str) -> None:
        progress(stage, status)
        if status.startswith("error"):
            raise RuntimeError(f"{stage}: {status}")

    stages: list[Stage] = [(name, (lambda tables: search(tables, **options)) if stage is search else stage) for name, stage in STAGES]
    return compose({"raw": lc}, stages, told)


def flagship(lc: DataFrame) -> DataFrame:
    """Each target's strongest box on the small grid, and whether it is a dip."""
    best = bls.best_period(bls.periodogram(lc))
    return best.withColumn("is_dip", F.col("s") < 0)
