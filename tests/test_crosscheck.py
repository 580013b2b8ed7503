"""The comparison search against brute force, and both searches on a synthetic dip."""

import numpy as np
import pytest

from dipper.operators import bls, crosscheck, lightcurve, partial


def brute(t, y, w, period, durations):
    phase, best = t % period, None
    for d in durations:
        for p in sorted(phase):
            inside = (phase - p) % period < d
            # a rounded sum of phases, as the sorted search compares
            inside = ((phase >= p) & (phase < p + d)) | (phase + period < p + d)
            if inside.all():
                continue
            depth = np.average(y[~inside], weights=w[~inside]) - np.average(y[inside], weights=w[inside])
            power = 0.5 * w[inside].sum() * depth**2
            if depth > 0 and (best is None or round(power, 9) > round(best[4], 9)):
                best = (period, d, (p + d / 2) % period, depth, power)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_moving_ends(seed):
    rng = np.random.default_rng(seed)
    t = np.round(rng.uniform(0, 20, 150), 1 if seed % 2 else 9)
    y, w = rng.normal(0, 1, 150), rng.uniform(0.5, 2, 150)
    for period in (0.7, 3.3, 25.0):
        got, want = crosscheck.best_box(t, y, w, period, (0.1, 0.5, 1.0)), brute(t, y, w, period, (0.1, 0.5, 1.0))
        assert (got is None) == (want is None) and (got is None or np.allclose(got, want))


def test_constants_and_too_few_points_have_no_box():
    assert crosscheck.best_box(np.arange(5.0), np.ones(5), np.ones(5), 2.0, (0.5,)) is None
    assert crosscheck.best_box(np.zeros(1), np.ones(1), np.ones(1), 2.0, (0.5,)) is None
    assert len(crosscheck.auto_periods(0.0, (0.1,))) == len(crosscheck.auto_periods(0.3, (0.1,))) == 0
    grid = crosscheck.auto_periods(30.0, (0.1,))
    assert grid[0] == 0.2 and np.all(np.diff(grid) > 0) and abs(grid[-1] - 10) < 0.02


def test_both_searches_find_a_dip(spark):
    """Two thousand points, a dip of 1 % every 5 days for 0.15 days."""
    rng = np.random.default_rng(42)
    t = np.sort(rng.uniform(0, 30, 2000))
    flux = 1 + rng.normal(0, 0.002, 2000) - 0.01 * (np.abs((t - 1.2 + 2.5) % 5 - 2.5) < 0.075)
    lc = spark.createDataFrame([(g, float(a), float(b), 0) for g in ("x", None) for a, b in zip(t, flux, strict=True)], lightcurve.LC_SCHEMA)
    periods = np.linspace(2, 10, 1500)
    ours = bls.best_period(bls.search(lc.where("target = 'x'"), bls.linear_periods(spark, 2.0, 10.0, 1500), 300, 0.05, 0.3)).first()
    found = {r["target"]: r for r in crosscheck.best_of(crosscheck.search(lc, periods, (0.1, 0.15, 0.2))).collect()}
    assert set(found) == {"x", None}
    theirs = found["x"]
    assert abs(ours["period"] - theirs["period"]) < 0.05 and abs(theirs["period"] - 5) < 0.1
    assert theirs["duration_days"] == 0.15 and abs(theirs["depth"] - 0.01) < 1e-3 and abs(theirs["transit_time"] - 1.2) < 0.05


def test_points_are_copied_as_tasks_need(spark):
    lc = spark.range(1000).selectExpr("cast(id % 100 as string) as target", "id / 10D as t", "1D as flux", "0 as quality")
    assert partial.chunks_for(lc) == 1 and partial.chunks_for(lc.where("target = '1'")) == 64
    assert partial.chunks_for(lc.where("target = '1'"), 1) == 7 and partial.chunks_for(lc.where("false")) == 64
