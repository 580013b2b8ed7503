"""Radix selection against sorting, with buffers so small that all rounds are needed."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from dipper.operators.selection import medians, ordered_bits, selected


def values():
    rng = np.random.default_rng(2)
    bits = rng.integers(-(1 << 63), 1 << 63, 400)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, -(2.0**-1022), math.nextafter(2.0**-1022, 0), 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), 1.0, 2.0, math.nextafter(2, 0), math.nextafter(2, 3)]
    odd += [2.0**k for k in range(-1074, 1024, 13)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024, 37)]
    return [x for (x,) in (struct.unpack("<d", struct.pack("<q", int(b))) for b in bits)] + odd


def order(x):
    return (math.isnan(x), x)


def test_bits_sort_as_doubles(spark):
    xs = sorted(values(), key=order)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", "x", ordered_bits(F.col("x")).alias("bits")).orderBy("i").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        same = a["x"] == b["x"] or (math.isnan(a["x"]) and math.isnan(b["x"]))
        assert a["bits"] == b["bits"] if same else a["bits"] < b["bits"], (a, b)


def test_selection(spark):
    rng = np.random.default_rng(4)
    groups = {"wild": values(), "near": list(1 + rng.normal(0, 1e-9, 3001)), "ties": [1.5] * 2000 + [2.5] * 2000, "whole": [float(x) for x in rng.integers(-5, 6, 999)], "one": [3.0], "two": [1.0, 2.0], None: [4.0, 8.0, 6.0, float("nan")]}
    rows = [(g, i % 2, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("none", 0, None), ("two", 0, None)]
    df = spark.createDataFrame(rows, "g string, part int, x double").repartition(5)
    got = {r["g"]: r for r in selected(df, ("g",), "x", {"low": "(n - 1) div 2", "third": "n div 3", "first": "0L", "last": "n - 1"}, few=7).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs, key=order)
        n = len(xs)
        for name, k in (("low", (n - 1) // 2), ("third", n // 3), ("first", 0), ("last", n - 1)):
            assert got[g][name] == xs[k] or (math.isnan(xs[k]) and math.isnan(got[g][name])), (g, name)
        assert got[g]["n"] == n
    both = {(r["g"], r["part"]): r["median"] for r in medians(df, ("g", "part"), "x", few=50).collect()}
    for g in ("near", "ties", "whole"):
        for part in (0, 1):
            assert math.isclose(both[g, part], np.median(groups[g][part::2]), rel_tol=1e-15)
    poisoned = {r["g"]: r["median"] for r in medians(df, ("g",), "x", poisoned=True, few=50).collect()}
    assert math.isnan(poisoned["wild"]) and math.isnan(poisoned[None]) and poisoned["two"] == 1.5


def test_empty(spark):
    assert selected(spark.createDataFrame([], "g string, x double"), ("g",), "x", {"low": "0L"}).collect() == []
