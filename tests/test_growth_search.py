"""Searches of long curves: the same boxes with few points sorted, and few copies of points."""

import numpy as np
import pytest

from dipper.operators import crosscheck, lightcurve


@pytest.mark.parametrize(("n", "kind"), [(6000, "plain"), (6000, "ties"), (5000, "weights"), (5000, "flat")])
def test_bounded_boxes_are_all_boxes(n, kind):
    rng = np.random.default_rng(n)
    t, y, w = np.sort(rng.uniform(0, 30, n)), rng.exponential(50, n), np.ones(n)
    t, y = (np.round(t, 2), np.round(y, -1)) if kind == "ties" else (t, y * (kind != "flat"))
    w = rng.uniform(0.5, 2, n) if kind == "weights" else w
    order = np.lexsort((y, t))
    t, y, w = t[order] - t[order[0]], y[order], w[order]
    curve = crosscheck.Curve(t, y, w, many=100)
    for period in (0.23, 0.9, 2.0, 5.0, 9.7, 40.0):
        for durations in ((0.1,), (0.3, 0.1)):
            got, want = curve.best_box(period, durations), crosscheck.best_box(t, y, w, period, durations)
            assert (got is None) == (want is None) and (got is None or np.allclose(got, want, rtol=1e-9))


def test_long_curves_are_not_sorted_for_each_period(monkeypatch):
    """All boxes are bounded by sums of bins; the function that sorts all points isn't called."""
    rng = np.random.default_rng(1)
    curve = crosscheck.Curve(np.sort(rng.uniform(0, 30, 20_000)), rng.normal(0, 1, 20_000), np.ones(20_000))
    monkeypatch.setattr(crosscheck, "best_box", None)
    assert all(curve.best_box(p, (0.1,)) for p in (0.5, 3.0, 9.0))


def test_copies_grow_with_cores_only(spark, monkeypatch):
    """Each core has two groups at most, whatever the number of shuffle partitions."""
    copies = []
    monkeypatch.setattr(crosscheck, "packed", lambda *a: copies.append(crosscheck.copies_for(a[0])) or a[0].selectExpr("target", "cast('' as binary) as points"))
    lc = spark.createDataFrame([("a", 0.0, 1.0, 0)], lightcurve.LC_SCHEMA)
    crosscheck.search(lc, [2.0])
    assert copies == [2 * spark.sparkContext.defaultParallelism]


def test_periods_do_not_read_all_points(monkeypatch):
    """A period adds up bounds of its cycles; before, it took every point to its bin, or the beginnings of bins of all cycles."""
    rng = np.random.default_rng(4)
    t, y = np.sort(rng.uniform(0, 30, 20_000)), rng.exponential(50, 20_000)
    y[rng.random(20_000) < 0.3] = 0.0
    t -= t[0]
    curve, sorted_ = crosscheck.Curve(t, y, np.ones(len(t))), []
    monkeypatch.setattr(crosscheck.kernels, "phase_bins", None)
    monkeypatch.setattr(crosscheck.kernels.Ordered, "begins", None)
    argsort = np.argsort
    monkeypatch.setattr(crosscheck.np, "argsort", lambda v, **k: sorted_.append(len(v)) or argsort(v, **k))
    for period in (0.2, 0.31, 0.9, 4.1, 9.7):
        got = curve.best_box(period, (0.1,))
        assert np.allclose(got, crosscheck.best_box(t, y, np.ones(len(t)), period, (0.1,)), rtol=1e-9)
    assert max(sorted_) < len(t) / 2


@pytest.mark.parametrize("parts", [50, 10**9])
@pytest.mark.parametrize("kind", ["gaps", "ties", "long", "weights"])
def test_cells_and_their_parts_give_all_boxes(kind, parts, monkeypatch):
    """Gaps, tied times, boxes around the end of the cycle and of a whole cycle; with cells cut into parts, and without."""
    monkeypatch.setattr(crosscheck, "SORTED", parts)
    rng = np.random.default_rng(9)
    t = rng.uniform(0, 300 if kind == "long" else 20, 3000)
    t = t[t % 1 < 0.4] if kind == "gaps" else np.round(t, 2) if kind == "ties" else t
    y, w = rng.standard_t(3, len(t)) * 50, rng.uniform(0.5, 2, len(t)) if kind == "weights" else np.ones(len(t))
    order = np.lexsort((y, t))
    t, y, w = t[order] - t[order[0]], y[order], w[order]
    curve = crosscheck.Curve(t, y, w, many=100)
    for period in (0.13, 0.5, 1.0, 2.0, 3.7, 19.0):
        for durations in ((0.05,), (0.3, 0.02), (1.0, 0.1)):
            got, want = curve.best_box(period, durations), crosscheck.best_box(t, y, w, period, durations)
            assert (got is None) == (want is None) and (got is None or np.allclose(got, want, rtol=1e-8))
