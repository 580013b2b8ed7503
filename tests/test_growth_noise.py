"""Constant fluxes have no noise, however their rows are shared out."""

from pyspark.sql import functions as F

from dipper.operators import photometry


def test_apertures_without_pixels_have_no_noise(spark):
    """Fluxes of an empty aperture are all 0, and 1 over their median; their merged means aren't, by a digit."""
    cells = spark.range(0, 5 * 400 * 64, 1, 8).selectExpr("cast(id % 5 as string) as target", "id div 320 as cadence", "cast((id div 5) % 64 div 8 as int) as row", "cast((id div 5) % 8 as int) as col")
    pixels = cells.withColumn("px", F.col("row") + 2.0 * F.col("col") + 5 * (F.col("row") == 1).cast("double") + (F.col("cadence") % 7) * 0.01)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        trials = photometry.measure_apertures(pixels, (50.0, 60.0))[0].collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in trials:
        assert (r["pixels"], r["signal"], r["noise"], r["snr"], r["score"]) == (0, 1.0, 0.0, 0.0, 0.0)
