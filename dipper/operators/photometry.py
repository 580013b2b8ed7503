"""Aperture photometry on pixels, as rows (target, cadence, row, col, px)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipper.functions.scores import ratio_or_zero
from dipper.operators.lightcurve import with_joined
from dipper.operators.selection import medians
from dipper.sources.store import kept

#: Deviations of the mean image that thresholds are tried at.
SIGMAS = (5.0, 6.0, 7.0, 8.0, 9.0)


def explode_frames(frames: DataFrame) -> DataFrame:
    """Pixels of (target, cadence, flux array<array<float>>)."""
    rows = frames.select("target", "cadence", F.posexplode("flux").alias("row", "line"))
    return rows.select("target", "cadence", "row", F.posexplode("line").alias("col", "px")).withColumn("px", F.col("px").cast("double"))


def mean_image(pixels: DataFrame) -> DataFrame:
    """(target, row, col, value): means over cadences, without NaN; NaN where there is nothing else."""
    value = F.coalesce(F.avg(F.when(~F.isnan("px"), F.col("px"))), F.lit(float("nan")))
    return pixels.groupBy("target", "row", "col").agg(value.alias("value"))


def brightest_pixel(image: DataFrame) -> DataFrame:
    """(target, row, col, value) of the largest value, the first in row-major order."""
    first = F.min(F.struct((-F.col("value")).alias("less"), "row", "col")).alias("b")
    return image.where("not isnan(value)").groupBy("target").agg(first).select("target", "b.row", "b.col", (-F.col("b.less")).alias("value"))


def global_background(image: DataFrame) -> DataFrame:
    """(target, background): the median of the image without NaN."""
    return medians(image, ("target",), "value", "background")


def local_background(image: DataFrame, center: DataFrame, inner: float = 3.0, outer: float = 5.0) -> DataFrame:
    """(target, background): the median within an annulus around each target's centre; NaN where no value lies there."""
    c = center.select(F.col("target").alias("of_target"), F.col("row").alias("cr"), F.col("col").alias("cc"))
    far = F.sqrt(F.pow(F.col("row") - F.col("cr"), 2) + F.pow(F.col("col") - F.col("cc"), 2))
    rows = image.join(c, F.col("target").eqNullSafe(F.col("of_target")))
    inside = medians(rows.where(far.between(inner, outer)), ("target",), "value", "background")
    return with_joined(center.select("target"), inside).withColumn("background", F.coalesce("background", F.lit(float("nan"))))


def _grow(image: np.ndarray, seed: tuple[int, int], threshold: float) -> list[tuple[int, int]]:
    """Pixels not below the threshold that eight-neighbour steps reach from the seed, brightest border first."""
    rows, cols = image.shape
    order, waiting, seen = [], [(-image[seed], *seed)], {seed}
    while waiting:
        _, r, c = heapq.heappop(waiting)
        if image[r, c] < threshold:
            continue
        order.append((r, c))
        for a in range(max(r - 1, 0), min(r + 2, rows)):
            for b in range(max(c - 1, 0), min(c + 2, cols)):
                if (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(waiting, (-image[a, b], a, b))
    return order


def grow_apertures(image: DataFrame, seeds: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(target, sigma, row, col, seq): the pixels of each aperture in order of growth, from 1.

    ``seeds``: (target, row, col); ``thresholds``: (target, sigma, threshold). A group is one image, and is flooded once: as
    the brightest border pixel comes first, a threshold's aperture is what the flood to the lowest one took before its first
    fainter pixel. NaN pixels grow at once; a NaN threshold takes all.
    """
    s = seeds.select("target", F.col("row").alias("seed_row"), F.col("col").alias("seed_col"))
    t = thresholds.groupBy("target").agg(F.collect_list(F.struct("sigma", "threshold")).alias("thresholds"))
    rows = with_joined(with_joined(image, s, "inner"), t, "inner")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        field = np.full((int(part["row"].max()) + 1, int(part["col"].max()) + 1), -np.inf)
        field[part["row"], part["col"]] = part["value"].fillna(np.inf)
        seed = (int(part["seed_row"].iloc[0]), int(part["seed_col"].iloc[0]))
        levels = [(x["sigma"], -np.inf if x["threshold"] is None or np.isnan(x["threshold"]) else x["threshold"]) for x in part["thresholds"].iloc[0]]
        order = _grow(field, seed, min(level for _, level in levels))
        faintest = np.minimum.accumulate([field[p] for p in order]) if order else np.zeros(0)
        out = [(key[0], sigma, r, c, i) for sigma, level in levels for i, (r, c) in enumerate(order[: int((faintest >= level).sum())], 1)]
        return pd.DataFrame(out, columns=["target", "sigma", "row", "col", "seq"])

    return rows.groupBy("target").applyInPandas(run, "target string, sigma double, row int, col int, seq int")


def first_pixels(growth: DataFrame, n: int) -> DataFrame:
    """The first n pixels of each growth order."""
    return growth.where(F.col("seq") <= n)


def aperture_flux(pixels: DataFrame, apertures: DataFrame, background: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """(target, sigma, cadence, flux): the sum over each aperture of what exceeds the background. Apertures are small.

    ``trials``: (target, sigma) of apertures that may hold no pixels; each of their cadences has a row, 0 where there are none.
    """
    masks = apertures.select("target", "sigma", "row", "col")
    rows = with_joined(with_joined(pixels, masks, "inner", ("target", "row", "col")), background, "inner")
    flux = rows.groupBy("target", "sigma", "cadence").agg(F.sum(F.col("px") - F.col("background")).alias("flux"))
    if trials is None:
        return flux
    every = with_joined(pixels.select("target", "cadence").distinct(), trials.select("target", "sigma"), "inner")
    return with_joined(every, flux, "left", ("target", "sigma", "cadence")).select("target", "sigma", "cadence", F.coalesce("flux", F.lit(0.0)).alias("flux"))


def measure_apertures(pixels: DataFrame, sigmas: tuple[float, ...] = SIGMAS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trials, growth, flux): (target, sigma, pixels, signal, noise, rms, snr, score, is_best), the pixels of all trials, and
    the (target, sigma, cadence, flux) of each, over its median; all ones where that is 0 or NaN.

    The threshold is the local background plus sigma deviations of the mean image; the score is the signal to noise of
    the normalised flux over the root of the aperture's size. The best is the largest score, then the least sigma.
    """
    image = kept(mean_image(pixels))
    seeds = kept(brightest_pixel(image))
    background = kept(local_background(image, seeds))
    spread = image.groupBy("target").agg(F.stddev_pop("value").alias("spread"))
    levels = with_joined(background, spread, "inner").select("target", F.explode(F.array(*map(F.lit, sigmas))).alias("sigma"), "background", "spread")
    thresholds = levels.select("target", "sigma", (F.col("background") + F.col("sigma") * F.col("spread")).alias("threshold"))
    growth = kept(grow_apertures(image, seeds, thresholds))
    flux = kept(aperture_flux(pixels, growth, background, levels))
    median = medians(flux, ("target", "sigma"), "flux", "m", poisoned=True)
    trial = ("target", "sigma")
    scaled = with_joined(flux, median, "inner", trial).select("target", "sigma", "cadence", F.when(F.isnan("m") | (F.col("m") == 0), 1.0).otherwise(F.col("flux") / F.col("m")).alias("flux"))
    middle = medians(scaled, ("target", "sigma"), "flux", "signal", poisoned=True)
    d = F.col("flux") - F.col("signal")  # constant fluxes deviate by exactly 0, which merged means of other numbers don't
    stats = with_joined(scaled, middle, "inner", trial).groupBy("target", "sigma").agg(F.first("signal").alias("signal"), F.stddev_pop(d).alias("noise"), F.sqrt(F.avg(d * d)).alias("rms"))
    size = growth.groupBy("target", "sigma").agg(F.count(F.lit(1)).alias("pixels"))
    trials = with_joined(stats, size, "left", trial).select("target", "sigma", F.coalesce("pixels", F.lit(0)).alias("pixels"), "signal", "noise", "rms", ratio_or_zero(F.col("signal"), F.col("noise")).alias("snr"))
    trials = trials.withColumn("score", F.round(ratio_or_zero(F.col("snr"), F.sqrt(F.col("pixels"))), 6))
    best = trials.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("sigma"))).alias("b")).select("target", F.col("b.sigma").alias("best_sigma"))
    return with_joined(trials, best, "inner").withColumn("is_best", F.col("sigma") == F.col("best_sigma")).drop("best_sigma"), growth, scaled


def optimize_apertures(pixels: DataFrame, sigmas: tuple[float, ...] = SIGMAS) -> tuple[DataFrame, DataFrame]:
    """The trials and growth of ``measure_apertures``."""
    return measure_apertures(pixels, sigmas)[:2]
