"""Light curves with known boxes, made by Spark from row numbers; the same seed gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, salt: int) -> Column:
    """A number in (0, 1)."""
    x = (F.col("id") * 69069 + (seed * 1009 + salt) * 7919 + 1) % (1 << 31)
    for _ in range(3):
        x = (x * 1103515245 + 12345) % (1 << 31)
        x = x.bitwiseXOR(F.shiftright(x, 15))
    return (x + 0.5) / float(1 << 31)


def transit_curves(spark: SparkSession, targets: int = 1, points: int = 2000, baseline: float = 30.0, seed: int = 42, **shape: float) -> DataFrame:
    """(target, t, flux, quality): ``points`` random times of each of some targets, with fluxes as of ``on_times``."""
    rows = spark.range(targets * points).select(F.col("id"), F.floor(F.col("id") / points).cast("string").alias("target"), (_uniform(seed, 0) * baseline).alias("t"))
    return on_times(rows, seed=seed, **shape)


def on_times(times: DataFrame, period: float = 5.0, duration: float = 0.15, depth: float = 0.01, noise: float = 0.002, phase: float = 0.0, odd_even: float = 1.0, secondary: float = 0.0, seed: int = 42) -> DataFrame:
    """(target, t, flux, quality): noise around 1, with a box each period, at the times of (id, target, t); ``id`` draws the noise.

    ``odd_even``: the depth of even epochs as a share of the odd ones'; ``secondary``: the depth of a box half a cycle later.
    """
    normal = F.sqrt(-2 * F.log(_uniform(seed, 1))) * F.cos(2 * F.pi() * _uniform(seed, 2))
    p = F.pmod(F.col("t") - phase, F.lit(period))
    share = F.when(F.pmod(F.floor(F.col("t") / period), F.lit(2)) == 0, odd_even).otherwise(1.0)
    box = F.when(p < duration, depth * share).when((p >= period / 2) & (p < period / 2 + duration), secondary).otherwise(0.0)
    return times.select("target", "t", (1 + noise * normal - box).alias("flux"), F.lit(0).alias("quality"))
