"""One flood gives every threshold's aperture; targets without a finite pixel stay in the report."""

import numpy as np
import pytest

from dipper.operators import photometry


def alone(field, seed, threshold):
    return photometry._grow(field, seed, threshold)


@pytest.mark.parametrize("seed", range(6))
def test_one_flood_is_a_flood_for_each_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    field = np.round(rng.normal(size=(9, 7)).cumsum(axis=seed % 2), 1)  # with ties
    r, c = np.unravel_index(np.argmax(field), field.shape)
    levels = [(1.0, float(field.max()) + 1), (2.0, 1.0), (3.0, 0.0), (4.0, -0.5), (5.0, float("nan"))]
    image = spark.createDataFrame([(t, i, j, float(field[i, j])) for t in ("a", None) for i in range(9) for j in range(7)], "target string, row int, col int, value double")
    seeds = spark.createDataFrame([(t, int(r), int(c)) for t in ("a", None)], "target string, row int, col int")
    thresholds = spark.createDataFrame([(t, s, x) for t in ("a", None) for s, x in levels], "target string, sigma double, threshold double")
    got = {}
    for row in photometry.grow_apertures(image, seeds, thresholds).orderBy("seq").collect():
        got.setdefault((row["target"], row["sigma"]), []).append((row["row"], row["col"]))
    for t in ("a", None):
        for s, x in levels:
            assert got.get((t, s), []) == alone(field, (r, c), x)


def test_dark_target_is_reported(spark, monkeypatch):
    from dipper.plans import pipeline

    px = [(t, k, i, j, float("nan") if t == "dark" else 1.0 + 5.0 * (i == 5 and j == 5) + 0.01 * ((i * 7 + j * 3 + k) % 5)) for t in ("dark", "bright") for k in range(6) for i in range(11) for j in range(11)]
    pixels = spark.createDataFrame(px, "target string, cadence long, row int, col int, px double")
    cadences = spark.createDataFrame([(t, k, k * 0.02, 0) for t in ("dark", "bright") for k in range(6)], "target string, cadence long, t double, quality int")
    tables = pipeline.measure({"pixels": pixels, "cadences": cadences})
    best = spark.createDataFrame([], "target string, period double, depth double, duration_days double, sde double, odd_even_diff_sigma double, secondary_ratio double")
    rows = {r["tic_id"]: r["status"] for r in pipeline.summarize(tables | {"best": best})["report"].collect()}
    assert rows.keys() == {"dark", "bright"} and rows["dark"].startswith("NO CANDIDATE")
    assert {r["target"] for r in tables["raw"].select("target").distinct().collect()} == {"bright"}
