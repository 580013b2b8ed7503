"""A target that fails in a step has its error; the others go on as if alone. A null target is one of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipper.operators import bls, crosscheck, photometry, vetting
from dipper.operators import lightcurve as lcs
from dipper.plans import pipeline
from tests.test_flows import curve


@pytest.fixture(scope="module")
def points():
    t, f = curve(n=1200, depth=0.03, width=0.2)
    good = [(name, float(a), float(b), 0) for name in ("good", None) for a, b in zip(t, f, strict=True)]
    return good, [("endless", float("inf"), 1.0, 0)] + [("endless", float(i), 1.0, 0) for i in range(400)]


SEARCHES = {
    "search": lambda lc, **o: bls.search(lc, n_bins=100, min_duration=0.2, min_period=3.0, max_fraction=0.2, **o),
    "blocks": lambda lc, **o: bls.search(lc, n_bins=100, min_duration=0.2, min_period=3.0, max_fraction=0.2, block=300, **o),
    "live": lambda lc, **o: bls.live_search(lc, (0.2, 0.3), min_period=2.5, max_fraction=0.2, **o),
    "other": lambda lc, **o: crosscheck.search(lc, None, (0.2,), **o),
}


@pytest.mark.parametrize("name", list(SEARCHES))
def test_searches(spark, points, name):
    good, bad = points
    search = SEARCHES[name]
    # sums depend on how points lie in partitions, in their last digits
    rows = lambda df: sorted((tuple(float(f"{x:.6g}") if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    alone = rows(search(spark.createDataFrame(good, lcs.LC_SCHEMA)))
    both = spark.createDataFrame(good + bad, lcs.LC_SCHEMA)
    out = search(both, errors=True)
    assert out.columns[-1] == "error"
    failed = out.where("error is not null").collect()
    assert {r["target"] for r in failed} == {"endless"} and all(r["pid"] is None and r["period"] is None for r in failed)
    assert rows(out.where("error is null").drop("error")) == alone
    assert {r[0] for r in alone} == {"good", None}
    with pytest.raises(Exception, match="Error"):
        search(both).collect()


def test_errors_after_sums(spark, points):
    """Blocks are summed, and the last step fails."""
    good, _ = points
    from dipper.operators import partial

    def finish(total, places, own, n, lo, hi):
        if n == 1200:
            raise ZeroDivisionError("no")
        return [(float(i), float(n)) for i in places]

    lc = spark.createDataFrame(good + [("short", float(i), 1.0, 0) for i in range(500)], lcs.LC_SCHEMA)
    out = partial.summed(lc, lambda lo, hi: np.arange(3.0), lambda t, x, w, own, lo: np.zeros(len(own)), finish, ("i", "n"), "target string, i double, n double", 2, 400, errors=True).collect()
    assert sorted((r["i"], r["n"]) for r in out if r["target"] == "short") == [(0.0, 500.0), (1.0, 500.0), (2.0, 500.0)]
    assert {r["error"] for r in out if r["target"] != "short"} == {"ZeroDivisionError: no"}


def test_vetting_of_boxes_that_are_none(spark, points):
    good, bad = points
    nan, inf = float("nan"), float("inf")
    boxes = [(4.0, 0.25, 0.05), (0.0, 0.25, 0.05), (-1.0, 0.25, 0.05), (None, 0.25, 0.05), (nan, 0.25, 0.05), (inf, 0.25, 0.05), (4.0, None, 0.05), (4.0, nan, 0.05), (4.0, 0.25, inf)]
    c = spark.createDataFrame([(x, i, *b, 0.03, False) for x in ("good", None, "endless", "nowhere") for i, b in enumerate(boxes)], "target string, peak_rank int, period double, phase_start double, phase_width double, depth double, is_harmonic boolean")
    got = {(r["target"], r["peak_rank"]): r for r in vetting.vet(spark.createDataFrame(good + bad, lcs.LC_SCHEMA), c).collect()}
    assert len(got) == 36
    for (target, rank), r in got.items():
        assert r["status"] == ("PASSED" if rank == 0 else vetting.UNUSABLE), (target, rank)
        assert (r["odd_even_diff_sigma"] is None) == (rank > 0)
    assert got["good", 0]["depth_odd"] == got[None, 0]["depth_odd"] > 0.02


def test_flow_with_a_target_that_fails_in_the_search(spark, points):
    good, bad = points
    tables = {"raw": spark.createDataFrame(good + bad + [("short", 0.1 * i, 1.0, 0) for i in range(3)], lcs.LC_SCHEMA)}

    def clean(tables):  # what a cleaning might let through
        error = F.when(F.col("target") == "short", "too short")
        return {"clean": tables["raw"].select("target", "t", "flux", error.alias("error"))}

    stages = [("cleaning", clean), ("search", lambda t: pipeline.search(t, n_bins=100, min_period=2.5)), *pipeline.STAGES[2:]]
    seen = []
    out = pipeline.compose(tables, stages, lambda *x: seen.append(x))
    assert seen[-1] == ("report", "complete")
    report = {r["tic_id"]: r["status"] for r in out["report"].collect()}
    assert report == {"good": "VETTED CANDIDATE", None: "VETTED CANDIDATE", "endless": "NO CANDIDATE / FALSE POSITIVE", "short": "NO CANDIDATE / FALSE POSITIVE"}
    errors = {(r["target"], r["stage"]): r["error"] for r in out["errors"].collect()}
    assert set(errors) == {("endless", "search"), ("short", "cleaning")} and errors["short", "cleaning"] == "too short"
    assert {r["target"] for r in out["power"].select("target").distinct().collect()} == {"good", None}


def test_pixels_of_a_null_target_and_of_none_that_is_finite(spark):
    r, c = np.mgrid[0:11, 0:11]
    star = 100 * np.exp(-((r - 5) ** 2 + (c - 5) ** 2) / 4) + 1
    rows = [(k, n, int(i), int(j), float("nan") if k == "dark" else float(star[i, j] * (1 + 0.01 * n))) for k in ("a", None, "dark") for n in range(6) for i in range(11) for j in range(11)]
    px = spark.createDataFrame(rows, "target string, cadence long, row int, col int, px double")
    cadences = spark.createDataFrame([(k, n, float(n), 0) for k in ("a", None, "dark") for n in range(6)], "target string, cadence long, t double, quality int")
    trials, growth = photometry.optimize_apertures(px, (0.5, 1.0))
    own = {k: sorted((x["sigma"], x["pixels"], x["score"], x["is_best"]) for x in trials.collect() if x["target"] == k) for k in ("a", None)}
    assert own["a"] == own[None] and len(own["a"]) == 2 and sum(x[3] for x in own["a"]) == 1
    assert growth.where("target is null").count() == growth.where("target = 'a'").count() > 0
    out = pipeline.compose({"pixels": px, "cadences": cadences}, [("photometry", lambda t: {"raw": pipeline.photometry_stage(t["pixels"], t["cadences"], (0.5, 1.0)), "targets": t["pixels"].select("target").distinct()}), *pipeline.STAGES])
    assert sorted((r["target"] or "", r["t"]) for r in out["raw"].collect()) == sorted((k, float(n)) for k in ("", "a") for n in range(6))
    assert {r["tic_id"] for r in out["report"].collect()} == {"a", None, "dark"}
    assert ("dark", "photometry") in {(r["target"], r["stage"]) for r in out["errors"].collect()}


def test_null_targets_in_joined_tables(spark):
    power = spark.createDataFrame([("a", -0.1, 0.2), (None, -0.1, 0.2)], "target string, s double, r double")
    counts = spark.createDataFrame([("a", 10), (None, 10)], "target string, n long")
    assert bls.snr_objective(power, counts).count() == 2
    values = spark.createDataFrame([("a", "period", 1.0), (None, "period", 2.0)], "target string, quantity string, value double")
    assert bls.compare_results(values, values, ("target", "quantity")).where("abs_diff = 0").count() == 2
