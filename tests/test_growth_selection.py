"""Medians of large groups take few passes."""

import numpy as np

from dipper.operators import lightcurve, selection


def test_brackets_need_no_rounds(spark, monkeypatch):
    """Values that fit a bracket's buffer are found without radix rounds; before, five or six of them read all values."""
    rounds = []
    monkeypatch.setattr(selection, "DIGIT", type("D", (int,), {"__format__": lambda self, spec: rounds.append(1) or "12"})(12))
    rng = np.random.default_rng(3)
    xs = {g: rng.exponential(50, 20_001) for g in ("a", "b")}
    rows = spark.createDataFrame([(g, float(x)) for g, v in xs.items() for x in v], "g string, x double")
    got = {r["g"]: r["median"] for r in selection.medians(rows, ("g",), "x", poisoned=True, few=1000, fit=False).collect()}
    assert got == {g: float(np.median(v)) for g, v in xs.items()} and not rounds


def test_clipping_stops_where_nothing_is_taken(spark, monkeypatch):
    calls, of = [], lightcurve.medians
    monkeypatch.setattr(lightcurve, "medians", lambda *a, **k: calls.append(1) or of(*a, **k))
    lc = spark.range(100).selectExpr("'a' as target", "cast(id as double) as t", "cast(id % 10 as double) as flux")
    assert lightcurve.clip_upper(lc, 5.0).count() == 100 and len(calls) == 1
