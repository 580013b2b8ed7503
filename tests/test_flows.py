"""Vetting scenarios, photometry, FITS files, streaming, sinks."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipper.operators import photometry, report, vetting
from dipper.operators import lightcurve as lcs
from dipper.plans import pipeline
from dipper.sources import fits


def curve(even_scale=1.0, secondary=0.0, n=5000, period=4.0, width=0.1, depth=0.02, seed=5):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 30, n))
    flux = 1 + rng.normal(0, 0.001, n)
    box = (np.mod(t, period) >= 1) & (np.mod(t, period) < 1 + width)
    flux[box] -= depth * np.where(np.floor(t[box] / period) % 2 == 0, even_scale, 1)
    flux[(np.mod(t, period) >= 3) & (np.mod(t, period) < 3 + width)] -= secondary
    return t, flux


CASES = {"planet": ({}, "PASSED"), "binary": ({"even_scale": 0.5}, "REJECTED (Odd/Even Mismatch)"), "eclipse": ({"secondary": 0.01}, "REJECTED (Secondary Eclipse)"), "alias": ({}, "REJECTED (Harmonic Alias)"), "narrow": ({}, "PASSED")}


def test_vetting(spark):
    rows, cands = [], []
    for name, (how, _) in CASES.items():
        t, f = curve(**how)
        rows += [(name, float(a), float(b), 0) for a, b in zip(t, f)]
        # a box narrower than a bin can't be tested, and passes
        cands.append((name, 1, 4.0, 0.25, 0.001 if name == "narrow" else 0.025, 0.02, 9.0, 0.1, name == "alias"))
    lc = spark.createDataFrame(rows, lcs.LC_SCHEMA)
    c = spark.createDataFrame(cands, "target string, peak_rank int, period double, phase_start double, phase_width double, depth double, sde double, duration_days double, is_harmonic boolean")
    vetted = vetting.vet(lc, c)
    got = {r["target"]: r for r in vetted.collect()}
    assert {k: got[k]["status"] for k in CASES} == {k: v for k, (_, v) in CASES.items()}
    assert got["alias"]["odd_even_diff_sigma"] is None and got["narrow"]["secondary_ratio"] == 0
    best = vetting.best_passed(vetted)
    out = {r["tic_id"]: r for r in report.batch_report(lc.select("target").distinct(), best).collect()}
    assert out["planet"]["status"] == "VETTED CANDIDATE" and out["planet"]["depth_ppm"] == pytest.approx(20000)
    assert out["binary"]["period"] == 0


def test_whole_flow_finds_the_planet(spark):
    t, f = curve(n=3000, depth=0.03, width=0.2)
    lc = spark.createDataFrame([("a", float(x), float(y), 0) for x, y in zip(t, f)] + [("short", 0.1 * i, 1.0, 0) for i in range(3)], lcs.LC_SCHEMA)
    seen = []
    out = pipeline.run(lc, lambda *x: seen.append(x), chunks=4, n_bins=100, min_period=2.5)
    best = out["best"].collect()
    assert len(best) == 1 and abs(best[0]["period"] - 4) < 0.05
    assert out["clean"].where("error is not null").select("target").collect()[0][0] == "short"
    assert out["report"].count() == 2 and seen[-1] == ("report", "complete")


def test_stages_in_any_list(spark):
    t, f = curve(n=2000, depth=0.03, width=0.2)
    lc = spark.createDataFrame([("a", float(x), float(y), 0) for x, y in zip(t, f)], lcs.LC_SCHEMA)
    seen = []
    stages = [*pipeline.STAGES[:1], ("count", lambda tables: {"counts": tables["clean"].groupBy("target").count()}), ("broken", lambda tables: {"x": tables["missing"]}), *pipeline.STAGES[1:]]
    out = pipeline.compose({"raw": lc}, stages, lambda *x: seen.append(x))
    assert set(out) == {"raw", "clean", "counts"} and out["counts"].first()["count"] > 1900
    assert [s for _, s in seen[:4]] == ["running", "complete"] * 2 and seen[-1][0] == "broken" and seen[-1][1].startswith("error")


def test_from_pixels_to_the_planet(spark):
    t, f = curve(n=1500, depth=0.04, width=0.25)
    t = np.linspace(0, 30, 1500)
    f = 1 - 0.04 * ((np.mod(t, 4.0) >= 1) & (np.mod(t, 4.0) < 1.25))
    r, c = np.mgrid[0:9, 0:9]
    star = 1000 * np.exp(-((r - 4) ** 2 + (c - 4) ** 2) / 2) + 10
    noise = np.random.default_rng(2).normal(0, 0.5, (1500, 9, 9))
    frames = spark.createDataFrame([("7", k, (star * f[k] + noise[k]).tolist()) for k in range(1500)], "target string, cadence long, flux array<array<float>>")
    cadences = spark.createDataFrame([("7", k, float(t[k]), int(k % 50 == 0)) for k in range(1500)], "target string, cadence long, t double, quality int")
    stages = [(n, (lambda tables: pipeline.search(tables, n_bins=100, min_period=2.5, chunks=4)) if n == "search" else s) for n, s in pipeline.PIXEL_STAGES]
    out = pipeline.compose({"pixels": photometry.explode_frames(frames), "cadences": cadences}, stages)
    assert out["raw"].count() == 1470 and abs(out["raw"].agg(F.median("flux")).first()[0] - 1) < 0.01
    best = out["best"].first()
    assert abs(best["period"] - 4) < 0.05 and out["report"].first()["status"] == "VETTED CANDIDATE"


def test_short_way(spark):
    t = np.linspace(0, 30, 3000)
    f = 100 + np.sin(t) - 2 * (np.mod(t, 4.0) < 0.1) + np.random.default_rng(1).normal(0, 0.1, 3000)
    f[50] = f[90] = 400
    lc = spark.createDataFrame([("a", float(x), float(y), 0) for x, y in zip(t, f)] + [("a", 3.0, float("nan"), 0)], lcs.LC_SCHEMA)
    rows = pipeline.flatten_and_search(lc, periods=[3.3, 4.0, 4.6]).collect()
    assert max(rows, key=lambda r: r["sr"])["period"] == 4.0


def test_aperture_leaves_detached_pixel_out(spark):
    r, c = np.mgrid[0:11, 0:11]
    star = 100 * np.exp(-((r - 5) ** 2 + (c - 5) ** 2) / 4) + 1
    star[0, 10] = 90
    rows = [("a", k, int(i), int(j), float(star[i, j] * (1 + 0.01 * (k % 3)))) for k in range(20) for i in range(11) for j in range(11)]
    px = spark.createDataFrame(rows, "target string, cadence long, row int, col int, px double")
    trials, growth = photometry.optimize_apertures(px, (0.5, 1.0, 2.0))
    t = trials.collect()
    assert sum(x["is_best"] for x in t) == 1 and all(x["pixels"] > 0 for x in t)
    g = growth.where("sigma = 1.0").collect()
    assert (0, 10) not in {(x["row"], x["col"]) for x in g} and [x for x in g if x["seq"] == 1][0][2:4] == (5, 5)
    assert photometry.first_pixels(growth, 3).where("sigma = 1.0").count() == 3
    frames = spark.createDataFrame([("a", 1, [[1.0, 2.0], [3.0, float("nan")]])], "target string, cadence long, flux array<array<float>>")
    image = photometry.mean_image(photometry.explode_frames(frames))
    assert photometry.brightest_pixel(image).first()["value"] == 3.0 and photometry.global_background(image).first()["background"] == 2.0


def fits_bytes():
    t = np.array([1.0, 2.0, np.nan, 4.0])
    return fits.write_table([("CADENCENO", "J", np.arange(4)), ("TIME", "D", t), ("SAP_FLUX", "E", np.array([9, 9, 9, 9])), ("PDCSAP_FLUX", "E", np.array([1.5, np.inf, 3, 4.5])), ("QUALITY", "I", np.array([0, 1, 2, 3])), ("FLAG", "B", np.array([1, 2, 3, 4])), ("BIG", "K", np.arange(4))], {"OBJECT": "TIC 12/34'5", "TELESCOP": "X"})


def test_fits(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(fits_bytes())
    (tmp_path / "b.fits.gz").write_bytes(gzip.compress(fits_bytes()))
    (tmp_path / "c.FIT").write_bytes(fits_bytes())
    (tmp_path / "d.fts").write_bytes(fits_bytes())
    (tmp_path / "e.txt").write_bytes(fits_bytes())
    rows = fits.read_fits(spark, str(tmp_path)).orderBy("path", "t").collect()
    assert [(r["t"], r["flux"], r["quality"], r["target"]) for r in rows[:2]] == [(1.0, 1.5, 0, "12/34'5"), (4.0, 4.5, 3, "12/34'5")]
    assert len(rows) == 8
    fits.register(spark)
    got = spark.read.format("fits").load(str(tmp_path)).collect()
    assert [(r["t"], r["flux"]) for r in sorted(got)] == [(1.0, 1.5), (4.0, 4.5)] * 4
    other = spark.read.format("fits").option("flux", "sap_flux").option("keepNan", "true").load(str(tmp_path / "a.fits")).collect()
    assert [r["flux"] for r in other] == [9.0] * 4
    assert spark.read.format("fits").option("hdu", "0").load(str(tmp_path)).count() == 0
    head = spark.read.format("fits").option("mode", "headers").load(str(tmp_path / "a.fits")).orderBy("hdu").collect()
    assert fits.read_headers(spark, str(tmp_path / "a.fits")).orderBy("hdu").select("hdu", "cards").collect() == [r[1:] for r in head]
    assert head[0]["cards"]["OBJECT"] == "TIC 12/34'5" and head[1]["cards"]["TFIELDS"] == "7"
    kept = fits.light_curve(fits_bytes(), "x.fits", keep_nan=True)
    assert len(kept) == 4
    assert len(fits.light_curve(fits.write_table([("A", "D", np.ones(2))], {}), "x.fits")) == 0


def test_streaming(spark, tmp_path):
    from dipper.streaming import landing

    lc = spark.createDataFrame([("a", float(i), float(i), i % 2) for i in range(10)], lcs.LC_SCHEMA)
    lc.write.parquet(str(tmp_path / "in"))
    q = landing.process(landing.read_landed_rows(spark, str(tmp_path / "in")), lcs.filter_quality, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert fits.accepted("X.FITS.gz") and not fits.accepted("x.csv")
    ts = spark.createDataFrame([("a", 1.0, "2024-01-01 00:10:00"), ("a", 3.0, "2024-01-01 00:20:00"), ("a", 5.0, "2024-01-03 00:00:00")], "target string, flux double, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert landing.hourly_flux(ts).count() == 2 and landing.observing_sessions(ts).count() == 2


def test_sinks_and_nan(spark, tmp_path):
    rows = spark.createDataFrame([("a", "PASSED", 1.23456789, 10.04, 2.5, 7.0, "N/A", 0.5, 0.01)], report.BATCH_SCHEMA)
    report.write_batch_csv(rows, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["TIC_ID,Status,Period_days,Depth_ppm,Duration_hrs,SDE,FAP,OddEvenSigma,SecondaryRatio", "a,PASSED,1.23457,10.0,2.50,7.00,N/A,0.50,0.010"]
    lc = spark.createDataFrame([("a", 1.0, float("nan"), 0), ("a", 2.0, float("inf"), 0), ("a", 3.0, 5.0, 0)], lcs.LC_SCHEMA)
    power = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "target string, period double, sde double, sr double")
    cands = spark.createDataFrame([("a", 1, 1.0, 2.0, 0.1, False, "PASSED")], "target string, peak_rank int, period double, sde double, depth double, is_harmonic boolean, status string")
    doc = json.loads(report.result_documents(lc, power, cands).first()["document"])
    assert doc["light_curve"]["flux"] == [None, None, 5.0] and doc["detection"] is True
    assert report.chart_domain(lc).first()["lo"] == 5.0
    report.write_candidates_csv(cands, str(tmp_path / "c"))
    # all NaN or zero medians give ones
    assert {r["flux"] for r in lcs.normalize_median(lc).collect()} == {1.0}
    assert lcs.filter_nan(lc).count() == 2


def test_synthetic_recovery(spark):
    from dipper.operators import bls
    from dipper.sources.synthetic import transit_curves

    lc = transit_curves(spark, targets=2)
    assert lc.collect() == transit_curves(spark, targets=2).collect()
    power = bls.with_sde(bls.search(lc, min_duration=0.1, max_duration=0.3, min_period=3.0, max_fraction=0.3, n_bins=300, chunks=4))
    for r in bls.best_period(power).collect():
        assert abs(r["period"] - 5) < 0.1 and r["sde"] > 6 and r["depth"] > 0


def test_pixel_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    cube = rng.normal(10, 1, (5, 3, 4))
    cube[0, 0, 0] = np.nan
    data = fits.write_table([("TIME", "D", np.arange(5.0)), ("FLUX", "E", cube), ("QUALITY", "J", np.arange(5))], {"TICID": 77})
    (tmp_path / "a.fits").write_bytes(data)
    rows = fits.read_frames(spark, str(tmp_path)).orderBy("cadence").collect()
    assert [r["target"] for r in rows] == ["77"] * 5 and [r["quality"] for r in rows] == list(range(5))
    assert np.allclose(np.array([r["flux"] for r in rows]), cube.astype(np.float32), equal_nan=True)
    px = photometry.explode_frames(fits.read_frames(spark, str(tmp_path)))
    assert px.count() == 60 and photometry.mean_image(px).where("isnan(value)").count() == 0
    cadences = fits.read_frames(spark, str(tmp_path)).select("target", "cadence", "t", "quality")
    # no pixel lies in the annulus of so small an image: the background is unknown, and the flux all ones
    trials = photometry.optimize_apertures(px)[0].orderBy("sigma").collect()
    assert [(r["sigma"], r["pixels"], r["signal"], r["noise"], r["score"], r["is_best"]) for r in trials] == [(x, 12, 1.0, 0.0, 0.0, x == 5.0) for x in photometry.SIGMAS]
    assert [(r["t"], r["flux"]) for r in pipeline.photometry_stage(px, cadences).collect()] == [(0.0, 1.0)]


def test_apertures_with_bad_cadences_and_without_pixels(spark):
    r, c = np.mgrid[0:11, 0:11]
    star = 100 * np.exp(-((r - 5) ** 2 + (c - 5) ** 2) / 4) + 1
    rows = [(k, n, int(i), int(j), float("nan") if k == "bad" and n == 2 else float(star[i, j] * (1 + 0.01 * n))) for k in ("bad", "good") for n in range(5) for i in range(11) for j in range(11)]
    px = spark.createDataFrame(rows, "target string, cadence long, row int, col int, px double")
    trials = {(x["target"], x["sigma"]): x for x in photometry.optimize_apertures(px, (1.0, 50.0))[0].collect()}
    # one bad cadence makes the median NaN and the flux all ones, as does an aperture without pixels, whose sums are 0
    for key in (("bad", 1.0), ("bad", 50.0), ("good", 50.0)):
        assert (trials[key]["signal"], trials[key]["noise"], trials[key]["rms"], trials[key]["snr"]) == (1.0, 0.0, 0.0, 0.0)
    assert trials["good", 50.0]["pixels"] == 0 and trials["good", 1.0]["pixels"] > 0 and trials["good", 1.0]["snr"] > 1
    cadences = spark.createDataFrame([(k, n, float(n), int(n == 1)) for k in ("bad", "good") for n in range(5)], "target string, cadence long, t double, quality int")
    out = {(x["target"], x["t"]): x["flux"] for x in pipeline.photometry_stage(px, cadences, (1.0, 50.0)).collect()}
    assert len(out) == 8 and out["bad", 0.0] == 1.0 and abs(out["good", 2.0] - 1) < 1e-12 and out["good", 4.0] > 1.01
