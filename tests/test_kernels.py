"""Kernels against invariants, planted signals, and the SQL form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipper.functions.scores import box_levels, false_alarm, signal_residue
from dipper.operators import bls, boxes, kernels
from dipper.operators import lightcurve as lcs


def planted(n=2000, period=5.0, duration=0.15, depth=0.01, noise=0.002, seed=42):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 30, n))
    flux = 1 + rng.normal(0, noise, n)
    flux[np.mod(t, period) < duration] -= depth
    return t, flux


def frame(spark, curves):
    rows = [(k, float(a), float(b), 0) for k, (t, f) in curves.items() for a, b in zip(t, f)]
    return spark.createDataFrame(rows, lcs.LC_SCHEMA)


def test_weights_sum_to_one_and_center():
    rng = np.random.default_rng(42)
    for errors in (None, rng.uniform(0.005, 0.02, 1000)):
        x, w = kernels.weights(rng.normal(1, 0.01, 1000), errors)
        assert abs(w.sum() - 1) < 1e-12 and abs((w * x).sum()) < 1e-12


def test_histogram_and_window_invariants():
    t, flux = planted()
    x, w = kernels.weights(flux)
    s, r = kernels.histogram(t, x, w, 3.0, 400)
    assert abs(s.sum()) < 1e-10 and abs(r.sum() - 1) < 1e-10
    # SR doesn't change under a shift of flux, and grows with the square of its scale
    a, b = (kernels.best_window(*kernels.histogram(t, *kernels.weights(f), 5.0, 300), range(3, 45), False) for f in (flux + 7, 3 * flux))
    c = kernels.best_window(*kernels.histogram(t, x, w, 5.0, 300), range(3, 45), False)
    assert a[:2] == b[:2] == c[:2]
    assert math.isclose(a[4], c[4], rel_tol=1e-8) and math.isclose(b[4], 9 * c[4], rel_tol=1e-8)


def test_recovers_period():
    t, flux = planted()
    fits = kernels.search(t, flux, kernels.period_grid(t.max() - t.min(), 0.05, 0.3, 2.0, 10.0), 300, 0.05, 0.3)
    sr = np.array([f[-1] for f in fits])
    best = fits[int(np.argmax(sr))]
    assert abs(best[1] - 5) < 0.1 and (sr.max() - sr.mean()) / sr.std() > 6


def test_grid_edges():
    with pytest.raises(ValueError):
        kernels.period_grid(30, 0.05, 0.3, transits=1)
    assert len(kernels.period_grid(30, 0.05, 0.3, 10, 2)) == 0
    g = kernels.period_grid(30, 0.05, 0.3, 2, 10)
    assert (np.diff(g) > 0).all() and g.min() >= 2 and g.max() <= 10


def test_savgol_keeps_cubics_and_matches_closed_form():
    x = np.arange(40.0)
    y = 2 - x + 0.3 * x**2 - 0.01 * x**3
    assert np.allclose(kernels.savgol(y, 11, 3), y)
    z = np.random.default_rng(1).normal(size=200)
    c = lcs.savgol_coefficients(151)
    assert math.isclose(kernels.savgol(z, 151, 3)[75], float(np.dot(c, z[:151])), abs_tol=1e-12)


@pytest.mark.parametrize("n", [5, 6, 7, 150, 151, 152, 400])
def test_detrend_segment_lengths(n):
    t = np.arange(n) * 0.02
    flat, trend = kernels.detrend(t, 100 + 5 * t + np.random.default_rng(n).normal(0, 0.01, n))
    assert len(flat) == n and np.allclose(flat, 1, atol=2e-3) and np.isfinite(trend).all()


def test_detrend_short_segment_raises_and_gaps_split():
    with pytest.raises(ValueError):
        kernels.detrend(np.arange(4.0) * 0.1, np.ones(4))
    t = np.concatenate([np.arange(200) * 0.02, 10 + np.arange(200) * 0.02])
    flux = np.where(t < 5, 50 + t, 500 - t) + np.random.default_rng(1).normal(0, 0.01, len(t))
    assert np.allclose(kernels.detrend(t, flux)[0], 1, atol=2e-3)


def test_clip_drops_spikes_and_keeps_dips():
    flux = np.random.default_rng(3).normal(1, 0.01, 500)
    flux[[10, 20, 30]] = 5
    flux[40] = -3
    keep = kernels.clip_upper(flux)
    assert not keep[[10, 20, 30]].any() and keep[40]


def test_masked_detrend_keeps_depth():
    t, flux = planted(4000, 4.0, 0.3, 0.05, 0.001)
    flux = flux * (1 + 0.05 * np.sin(t / 3))
    box = np.mod(t, 4.0) < 0.3
    flat, _ = kernels.detrend_masked(t, flux, 151, min_period=2.0)
    assert 0.04 < np.median(flat[~box]) - np.median(flat[box]) < 0.06


def test_kernel_and_sql_agree(spark):
    lc = frame(spark, {"a": planted(500), "b": planted(400, 3.0, 0.4, 0.05, 0.01, 7)})
    sql = {(r["target"], r["pid"]): r for r in bls.periodogram(lc, 16, 50, 1, 8).collect()}
    for name, (t, flux) in {"a": planted(500), "b": planted(400, 3.0, 0.4, 0.05, 0.01, 7)}.items():
        for pid in range(16):
            found = kernels.best_window(*kernels.histogram(t, *kernels.weights(flux), 1 / (0.1 + 0.01 * pid), 50), range(1, 9), False)
            assert math.isclose(sql[name, pid]["sr"], found[4], abs_tol=1.1e-6)


def test_grouped_search_is_the_kernel(spark):
    t, flux = planted(600)
    rows = bls.search(frame(spark, {"a": (t, flux)}), n_bins=100, min_duration=0.2, max_duration=0.5, min_period=3.0, max_fraction=0.25, chunks=4).collect()
    grid = kernels.period_grid(t.max() - t.min(), 0.2, 0.5, 3.0, (t.max() - t.min()) * 0.25)
    direct = kernels.search(t, flux, grid, 100, 0.2, 0.5)
    assert sorted(r["pid"] for r in rows) == [f[0] for f in direct]
    best = max(rows, key=lambda r: r["sr"])
    assert math.isclose(best["sr"], max(f[-1] for f in direct), rel_tol=1e-12)


def test_bootstrap_counts_a_thousand_shuffles(spark):
    t, flux = planted(120)
    lc = frame(spark, {"a": (t, flux)})
    best = []
    for k in range(1000):
        x, w = kernels.weights(np.random.default_rng([1, k]).permutation(flux))
        best.append(max(kernels.best_window(*kernels.histogram(t, x, w, 1 / (0.1 + 0.01 * p), 20), range(1, 3), False)[4] for p in range(4)))
    level = float(np.mean(np.sort(best)[-4:-2]))
    row = bls.bootstrap_fap(lc, spark.createDataFrame([("a", level)], "target string, sr double"), n_periods=4, n_bins=20, max_width=2).first()
    assert row["rounds"] == 1000 and row["fap"] == np.mean(np.array(best) >= level) < 0.05


def test_masked_cleaning_searches_by_blocks(spark, monkeypatch):
    from dipper.plans import pipeline

    def hidden(*args, **options):
        raise ValueError("the search is hidden in a group")

    t, flux = planted(1500, 4.0, 0.3, 0.05, 0.001)
    flux = flux * (1 + 0.05 * np.sin(t / 3))
    flat, trend = kernels.detrend_masked(t, flux, 51, min_period=3.0)
    monkeypatch.setattr(kernels, "detrend_masked", hidden)
    rows = pipeline.clean(frame(spark, {"a": (t, flux)}), window=51, masked=True, min_period=3.0).orderBy("t").collect()
    keep = kernels.clip_upper(flat)
    assert [r["error"] for r in rows] == [None] * keep.sum()
    assert np.allclose([r["flux"] for r in rows], flat[keep]) and np.allclose([r["trend"] for r in rows], trend[keep])


def test_search_adds_blocks_up(spark):
    lc = frame(spark, {"a": planted(900), "b": planted(150, seed=1)})
    options = {"n_bins": 100, "min_duration": 0.2, "max_duration": 0.5, "min_period": 2.0, "max_fraction": 0.3, "objective": "snr"}
    whole = {(r["target"], r["pid"]): r for r in bls.search(lc, **options).collect()}
    blocks = {(r["target"], r["pid"]): r for r in bls.search(lc, block=200, **options).collect()}
    assert blocks.keys() == whole.keys() and len({k[0] for k in whole}) == 2
    assert all(math.isclose(blocks[k]["sr"], whole[k]["sr"], rel_tol=1e-9) for k in whole)


@pytest.mark.parametrize("block", [10_000, 200])
def test_box_search_is_the_period_analysis_on_a_fine_grid(spark, block):
    t, flux = planted(900, 3.7, 0.1, 0.05, 0.005)
    lc = frame(spark, {"a": (t, flux)})
    few = boxes.search_periods(lc, 3.0, 4.0, 0.02, block=block).collect()
    assert len(few) == 5
    for r in few:
        one = boxes.analyze_period(lcs.fold(lc, r["period"])).first()
        assert all(math.isclose(r[c], one[c], rel_tol=1e-6) for c in ("center", "duration", "depth", "snr", "power"))
    rows = boxes.search_periods(lc, 2.0, 8.0, block=block).collect()
    by = sorted(r["frequency"] for r in rows)
    assert max(np.diff(by)) * (t.max() - t.min()) < 0.0101
    assert abs(max(rows, key=lambda r: r["score"])["period"] - 3.7) < 0.02


def test_residue_levels_and_false_alarm(spark):
    df = spark.createDataFrame([(-0.05, 0.1), (0.1, 0.0), (0.1, 1.0)], "s double, r double")
    a, b, c = df.select(signal_residue(F.col("s"), F.col("r")).alias("sr")).collect()
    assert math.isclose(a["sr"], 0.0025 / 0.09) and b["sr"] == c["sr"] == 0
    level = df.limit(1).select(box_levels(F.col("s"), F.col("r")).alias("x")).first()["x"]
    assert math.isclose(level["l"], -0.5) and math.isclose(level["h"], 0.05 / 0.9) and level["depth"] > 0
    fap = spark.createDataFrame([(10.0, 1000.0), (1.0, 1000.0)], "sde double, n double").select(false_alarm("sde", F.col("n")).alias("f")).collect()
    assert fap[0]["f"] < 0.01 and fap[1]["f"] > 0.5
    rows = [(x / 7 - 3, n) for x in range(100) for n in (1.0, 1000.0)] + [(30.0, 1e6), (None, 5.0)]
    got = spark.createDataFrame(rows, "sde double, n double").select(false_alarm("sde", F.col("n")).alias("f")).collect()
    for (sde, n), r in zip(rows, got):
        if sde is None:
            assert r["f"] is None
        else:
            p = math.erfc(sde / math.sqrt(2))
            want = 1.0 if p >= 1 else -math.expm1(n * math.log1p(-p))
            assert math.isclose(r["f"], want, rel_tol=1e-12)


def test_sde_peaks_and_harmonics(spark):
    n = 1000
    periods, sde = np.linspace(1, 10, n), np.zeros(n)
    sde[443:446], sde[166:169] = (5, 10, 5), (3, 7, 3)
    rows = spark.createDataFrame([("a", i, float(p), float(s)) for i, (p, s) in enumerate(zip(periods, sde))], "target string, pid long, period double, sde double")
    found = bls.flag_harmonics(bls.peaks(rows, 6.0)).orderBy("peak_rank").collect()
    assert abs(found[0]["period"] - 5) < 0.1 and not found[0]["is_harmonic"] and found[1]["is_harmonic"]
    flat = spark.createDataFrame([("a", i, 1.0 + i, 0.5) for i in range(5)], "target string, pid long, period double, sr double")
    assert {r["sde"] for r in bls.with_sde(flat).collect()} == {0.0}
    # ends beat one neighbour only, and rank behind inner peaks of the same height
    ends = spark.createDataFrame([("a", i, 1.0 + 0.37 * i, s) for i, s in enumerate([9.0, 1.0, 9.0, 1.0, 9.0])], "target string, pid long, period double, sde double")
    assert [r["pid"] for r in bls.peaks(ends, 6.0).orderBy("peak_rank").collect()] == [2, 0, 4]
    assert bls.peaks(ends.where("pid < 2"), 0.0).count() == 0


@pytest.mark.parametrize("points", [700, 160, 10_000])
def test_detrending_in_slices_is_the_kernel(spark, points):
    from dipper.operators.detrend import detrend

    curves = {}
    for k, (n, gap) in enumerate(((1500, 300), (400, 7), (153, None), (152, None), (60, 31))):
        rng = np.random.default_rng(k)
        t = np.arange(n) * 0.01
        if gap:
            t[gap:] += 1.0
        flux = 100 + 3 * np.sin(t) + rng.normal(0, 0.1, n)
        flux[rng.random(n) < 0.05] -= 3
        curves[str(k)] = (t, flux)
    curves["short"] = (np.array([0.0, 0.1, 0.2, 5.0, 5.1]), np.ones(5))
    rows = detrend(frame(spark, curves), slice_points=points).collect()
    for name, (t, flux) in curves.items():
        own = sorted([r for r in rows if r["target"] == name], key=lambda r: r["t"] or 0)
        try:
            flat, trend = kernels.detrend(t, flux)
        except ValueError as e:
            assert [r["error"] for r in own] == [str(e)]
            continue
        assert np.allclose([r["t"] for r in own], t) and np.allclose([r["trend"] for r in own], trend, rtol=1e-9) and np.allclose([r["flux"] for r in own], flat, rtol=1e-9)


def test_live_search_finds_the_middle(spark):
    t, flux = planted(3000, 4.0, 0.15, 0.02, 0.001)
    lc = frame(spark, {"a": (t, flux)})
    for block in (10_000, 700):
        rows = bls.live_search(lc, min_period=3.9, periods=[3.7, 4.0, 4.3], block=block).collect()
        best = max(rows, key=lambda r: r["sr"])
        assert best["period"] == 4.0 and abs(best["depth"] - 0.02) < 0.001 and abs(best["duration_days"] - 0.15) < 0.01
        assert abs(best["transit_time"] % 4.0 - 0.075) < 0.01 and abs(best["phase_start"] * 4 + best["duration_days"] / 2 - 0.075) % 4 < 0.01
    assert bls.linear_periods(spark, 2.0, 10.0).agg(F.count("pid"), F.min("period"), F.max("period")).first()[:] == (10_000, 2.0, 10.0)


def test_errors_weigh_points(spark):
    t, flux = planted(300, noise=0.002)
    errors = np.where(np.arange(300) % 7 == 0, 5.0, 0.01)
    flux[::7] += 3
    lc = spark.createDataFrame([("a", float(a), float(b), float(c)) for a, b, c in zip(t, flux, errors)], "target string, t double, flux double, error double")
    grid = [1 / (0.1 + 0.01 * p) for p in range(8)]
    periods = spark.createDataFrame(list(enumerate(grid)), "pid long, period double")
    rows = {r["pid"]: r["sr"] for r in bls.search(lc, periods, 50, error="error", block=100).collect()}
    direct = {f[0]: f[-1] for f in kernels.search(t, flux, np.array(grid), 50, 0.05, 0.25, errors)}
    assert rows.keys() == direct.keys() and all(math.isclose(rows[k], direct[k], rel_tol=1e-9) for k in rows)
    fap = bls.bootstrap_fap(lc, spark.createDataFrame([("a", 0.0)], "target string, sr double"), rounds=3, n_periods=2, n_bins=20, error="error").first()
    assert fap["fap"] == 1.0
