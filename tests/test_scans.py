"""Scans over slices give what a window over the whole target gives, with one target over many tasks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dipper.operators import kernels, lightcurve, report, scan
from dipper.operators.detrend import detrend


@pytest.fixture(scope="module")
def one_target(spark):
    rng = np.random.default_rng(11)
    t = np.sort(np.concatenate([rng.uniform(a, a + 1.0, 600) for a in (0.0, 2.0, 3.1, 7.0)]))
    flux = 1 + 0.01 * np.sin(t) + rng.normal(0, 1e-3, len(t))
    rows = [("one", float(a), float(b), 0) for a, b in zip(t, flux, strict=True)]
    rows += [("two", 1.0, 2.0, 0), ("two", 1.0, 2.0, 0), ("two", 9.0, 1.0, 0), (None, 1.0, 1.0, 0), (None, 5.0, 1.0, 0)]
    return spark.createDataFrame(rows, lightcurve.LC_SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_a_target_is_shared_out(one_target):
    rows = scan.sliced(one_target)
    counts = [r["count"] for r in rows.where("target = 'one'").groupBy("slice").count().collect()]
    assert len(counts) >= 6 and max(counts) < 800


def test_segments(one_target):
    by = Window.partitionBy("target").orderBy("t", "flux")
    new = one_target.withColumn("new", F.when(F.col("t") - F.lag("t").over(by) > 0.5, 1).otherwise(0))
    want = new.withColumn("segment", F.sum("new").over(by).cast("long"))
    got = lightcurve.segments(one_target, 0.5)
    assert rows_of(got, "target", "t", "flux", "segment") == rows_of(want, "target", "t", "flux", "segment")
    assert got.agg(F.max("segment")).first()[0] == 2


def test_numbers_and_downsampling(one_target):
    by = Window.partitionBy("target").orderBy("t", "flux")
    want = one_target.withColumns({"i": F.row_number().over(by).cast("long") - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("target"))})
    assert rows_of(scan.numbered(scan.sliced(one_target)), "target", "t", "i", "n") == rows_of(want, "target", "t", "i", "n")
    assert report.downsample(one_target, 100).where("target = 'one'").count() == 100


def test_interpolation_bridges_slices(one_target):
    """Values are missing for longer than several slices, and at both ends."""
    known = one_target.withColumn("flux", F.when((F.col("t").between(0.2, 0.4)) | (F.col("t").between(2.9, 7.1)), F.col("flux")))
    got = {(r["t"]): r["filled"] for r in lightcurve.interpolate(known).where("target = 'one'").collect()}
    rows = known.where("target = 'one'").orderBy("t").collect()
    t, y = np.array([r["t"] for r in rows]), np.array([np.nan if r["flux"] is None else r["flux"] for r in rows])
    ok = np.isfinite(y)
    assert np.allclose([got[x] for x in t], np.interp(t, t[ok], y[ok]), rtol=1e-12)
    assert lightcurve.interpolate(known).where("target is null and filled = 1").count() == 2


def test_detrending_in_small_slices(spark):
    """A run of left-out points lies across slices; results are those of the kernel on whole segments."""
    rng = np.random.default_rng(3)
    t = np.concatenate([np.arange(1500) * 0.01, 30 + np.arange(700) * 0.01])
    flux = 1 + 0.02 * np.sin(t / 3) + rng.normal(0, 1e-4, len(t))
    flux[640:780] -= 0.004
    flux[rng.choice(len(t), 60, replace=False)] -= 0.01
    lc = spark.createDataFrame([("a", float(x), float(y), 0) for x, y in zip(t, flux, strict=True)], lightcurve.LC_SCHEMA)
    got = {r["t"]: r["trend"] for r in detrend(lc, 51, slice_points=120).collect()}
    assert len(got) == len(t)
    for part in (slice(0, 1500), slice(1500, 2200)):
        want = kernels.detrend_segment(flux[part], 51, 3, 2, 3.0)
        want = want[1] if isinstance(want, tuple) else want
        assert np.allclose([got[x] for x in t[part]], want, rtol=1e-9)
