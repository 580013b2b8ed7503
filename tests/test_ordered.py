"""Sums of phase bins from running sums, packed points, and how often points are copied."""

import numpy as np
import pytest

from dipper.operators import bls, kernels, partial


@pytest.mark.parametrize("step", [0.1, 1 / 7, 1e-3, 0.3])
def test_bins_hold_just_their_points(step):
    """Times on coarse grids, many at the very beginning of a bin."""
    rng = np.random.default_rng(1)
    t = np.sort(rng.integers(0, 400, 8000) * step + rng.choice([0, 3, 100]))
    x = rng.normal(0, 1, 8000)
    curve, seen = kernels.Ordered(t, x, np.full(8000, 1 / 8000)), 0
    for period in (0.3, 0.7, 1.0, 1 / 3, 2.5, 3.1):
        for n in (7, 10, 20):
            if (begins := curve.phase_begins(period, n)) is not None:
                seen += 1
                bins = kernels.phase_bins(t, period, n)
                assert np.array_equal(curve.counts(begins, n), np.bincount(bins, minlength=n))
                assert np.allclose(curve.totals("x", begins, n), np.bincount(bins, x, n))
    assert seen


def test_a_period_of_many_points_takes_its_edges():
    t = np.sort(np.random.default_rng(2).uniform(0, 30, 200_000))
    curve = kernels.Ordered(t, np.ones(len(t)), np.ones(len(t)))
    assert len(curve.phase_begins(5.0, 400)) <= 7 * 400 + 1
    assert kernels.Ordered(t[:100], t[:100], t[:100]).phase_begins(5.0, 400) is None
    assert kernels.Ordered(t - 1, t, t).phase_begins(5.0, 400) is None


def test_copies_follow_cores_and_not_shuffle_partitions(spark):
    lc = spark.range(100).selectExpr("'a' as target", "id / 10D as t", "1D as flux")
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1000)
        assert partial.copies_for(lc) == partial.GROUPS * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pieces_of_null_and_other_targets_come_back(spark, monkeypatch):
    monkeypatch.setattr(partial, "PIECE", 7)
    rows = spark.createDataFrame([(g, float(i), float(i * i)) for i in range(40) for g in ("a", None, "b")], "target string, t double, y double")
    got: dict = {}
    for r in partial.packed(rows, ("target",), (), ("t", "y")).collect():
        got.setdefault(r["target"], []).append(np.frombuffer(r["points"]).reshape(2, -1))
    assert set(got) == {"a", None, "b"}
    for parts in got.values():
        t, y = np.concatenate(parts, axis=1)
        assert sorted(t) == list(range(40)) and np.array_equal(y, t * t)


def test_dense_curves_give_the_same_search(spark, monkeypatch):
    """4,000 points at 20 bins: sums from edges, against points one by one, in one block and in several."""
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 30, 4000))
    lc = spark.createDataFrame([("a", float(a), float(b), 0) for a, b in zip(t, rng.normal(1, 0.1, 4000), strict=True)], "target string, t double, flux double, quality int")
    periods = bls.linear_periods(spark, 2.0, 9.0, 12)
    want = kernels.search(t, np.array([r["flux"] for r in lc.orderBy("t").collect()]), np.linspace(2.0, 9.0, 12), 20, 0.2, 0.9)
    for block in (10_000, 1500):
        got = sorted(tuple(r)[1:] for r in bls.search(lc, periods, 20, 0.2, 0.9, block=block).collect())
        assert len(got) == len(want) and all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_vetting_joins_points_without_keeping_a_target_together(spark):
    """The points' join is an inner one, which Spark can broadcast or split; one without boxes' points still has its row."""
    from dipper.operators import vetting

    lc = spark.createDataFrame([(g, i / 10, 1.0 - 0.1 * (i % 50 < 3)) for g in ("a", None) for i in range(2000)], "target string, t double, flux double")
    row = (1, 5.0, 0.0, 0.06, 0.1, False, 9.0)
    cands = spark.createDataFrame([(g, *row) for g in ("a", None, "without points")], "target string, peak_rank int, period double, phase_start double, phase_width double, depth double, is_harmonic boolean, sde double")
    vetted = vetting.vet(lc, cands)
    joins = [line for line in vetted._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in f" {line}" and "#" in line]
    assert any("Inner" in j for j in joins) and sum("LeftOuter" in j for j in joins) == 1
    got = {r["target"]: (r["status"], r["odd_even_diff_sigma"], r["depth_odd"]) for r in vetted.collect()}
    assert set(got) == {"a", None, "without points"}
    assert got["without points"] == ("PASSED", 0.0, None) and got["a"] == got[None] and abs(got["a"][2] - 0.1) < 0.02


def test_shuffles_by_running_sums_are_those_point_by_point():
    rng = np.random.default_rng(4)
    t, flux = np.sort(rng.uniform(0, 30, 5000)), rng.normal(1, 0.1, 5000)
    periods, spans = np.array([2.5, 4.0, 9.0]), [range(1, 4)] * 3
    orders = [kernels.hashed_order(5000, k) for k in range(5)]
    assert kernels.Ordered(t, flux, flux).phase_begins(4.0, 20) is not None
    best = kernels.shuffled_best(t, flux, orders, periods, spans, 20, most=2)
    for got, order in zip(best, orders, strict=True):
        x, w = kernels.weights(flux[order])
        want = max(kernels.best_window(*kernels.histogram(t, x, w, p, 20), s, False)[-1] for p, s in zip(periods, spans, strict=True))
        assert np.isclose(got, want)
