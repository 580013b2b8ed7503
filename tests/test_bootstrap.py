"""Shuffles of whole light curves, over a search's own periods and widths."""

import numpy as np
import pytest

from dipper.operators import bls, kernels


@pytest.fixture
def curve():
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 20, 300))
    return t, 1 + 0.01 * rng.standard_normal(300) - 0.05 * (np.mod(t, 4.0) < 0.3)


def frame(spark, curves, error=None):
    rows = [(name, float(a), float(b), 1.0 if error is None else float(e)) for name, (t, flux) in curves.items() for a, b, e in zip(t, flux, np.ones(len(t)) if error is None else error, strict=True)]
    return spark.createDataFrame(rows, "target string, t double, flux double, error double")


def by_hand(t, flux, k, periods, n_bins, errors=None, dips=False):
    found = kernels.search(t, flux[kernels.hashed_order(len(t), k)], periods, n_bins, 0.1, 0.4, errors, dips)
    return max((f[-1] for f in found), default=0.0)


def test_orders_are_permutations_that_differ():
    orders = [kernels.hashed_order(1000, k) for k in range(50)]
    assert all(sorted(o) == list(range(1000)) for o in orders)
    places = np.array([np.argsort(o) for o in orders])
    assert np.abs(np.corrcoef(places) - np.eye(50)).max() < 0.2 and abs(np.corrcoef(places[0], np.arange(1000))[0, 1]) < 0.2


@pytest.mark.parametrize("dips", [False, True])
def test_one_product_gives_each_shuffle_its_search(curve, dips):
    t, flux = curve
    periods = np.array([1.3, 2.0, 4.0, 7.7])
    spans = [kernels.widths(*kernels.duration_fractions(p, 0.1, 0.4), 60) for p in periods]
    errors = np.where(np.arange(300) % 3 == 0, 0.1, 1.0)
    for e in (None, errors):
        best = kernels.shuffled_best(t, flux, [kernels.hashed_order(300, k) for k in range(7)], periods, spans, 60, e, dips)
        assert np.allclose(best, [by_hand(t, flux, k, periods, 60, e, dips) for k in range(7)], rtol=1e-9)


@pytest.mark.parametrize("chunks, shuffled", [(None, 4_000_000), (3, 700)])
def test_tiles_cover_all_rounds_and_the_whole_grid(spark, curve, monkeypatch, chunks, shuffled):
    monkeypatch.setattr(bls, "SHUFFLED", shuffled)
    t, flux = curve
    lc = frame(spark, {"a": (t, flux), None: (t[:200], flux[:200])})
    options = {"n_bins": 50, "min_duration": 0.1, "max_duration": 0.4, "min_period": 1.0, "max_fraction": 0.25}
    rows = {(r["target"], r["round"]): r["best"] for r in bls.search_shuffles(lc, 5, per_task=2, chunks=chunks, **options).collect()}
    assert len(rows) == 10
    for name, n in (("a", 300), (None, 200)):
        span = t[n - 1] - t[0]
        grid = kernels.period_grid(span, 0.1, 0.4, 1.0, span * 0.25)
        assert np.allclose([rows[name, k] for k in range(5)], [by_hand(t[:n], flux[:n], k, grid, 50) for k in range(5)], rtol=1e-9)


def test_a_planted_dip_is_beyond_chance_and_noise_isn_t(spark, curve):
    t, flux = curve
    noise = 1 + 0.01 * np.random.default_rng(8).standard_normal(300)
    lc = frame(spark, {"dip": (t, flux), None: (t, noise)})
    options = {"n_bins": 50, "min_duration": 0.1, "max_duration": 0.4, "min_period": 1.0, "max_fraction": 0.25}
    observed = bls.search(lc, **options).groupBy("target").agg({"sr": "max"}).withColumnRenamed("max(sr)", "sr")
    fap = {r["target"]: r for r in bls.search_fap(lc, observed, 100, **options).collect()}
    assert fap["dip"]["fap"] == 0 and fap["dip"]["rounds"] == 100 and 0.02 < fap[None]["fap"] <= 1


def test_empty_table_and_single_points(spark):
    empty = frame(spark, {})
    assert bls.search_shuffles(empty, 3, n_bins=20).count() == 0
    one = frame(spark, {"a": (np.array([1.0]), np.array([2.0]))})
    assert [r["best"] for r in bls.search_shuffles(one, 3, n_bins=20).collect()] == [0.0] * 3
