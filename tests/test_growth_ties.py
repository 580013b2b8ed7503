"""Rows of one time in a target: the query gives the rows that its SQL's joins by time give."""

from pathlib import Path

import duckdb
import pytest

from dipper import queries as q
from dipper.operators import lightcurve, scan
from dipper.sources import store

#: (target, seconds, value, known) in the order of the file; one tied time has one known row, or two, before, behind or around unknown ones.
EVENTS = [
    ("pair", 10, 1.0, 1), ("pair", 20, 2.0, 0), ("pair", 30, 3.0, 1), ("pair", 30, 5.0, 1), ("pair", 40, 9.0, 0), ("pair", 50, 7.0, 1),
    ("mixed", 10, 1.0, 0), ("mixed", 20, 2.0, 1), ("mixed", 20, 4.0, 0), ("mixed", 30, 3.0, 0), ("mixed", 40, 5.0, 0), ("mixed", 40, 6.0, 1), ("mixed", 50, 8.0, 0),
    ("unknown", 10, 1.0, 1), ("unknown", 20, 2.0, 0), ("unknown", 20, 3.0, 0), ("unknown", 30, 4.0, 1), ("none", 10, 1.0, 0), ("none", 10, 1.0, 0),
    ("amid", 10, 1.0, 1), ("amid", 20, 2.0, 1), ("amid", 20, 3.0, 0), ("amid", 20, 5.0, 1), ("amid", 30, 4.0, 0), ("amid", 40, 6.0, 1),
    ("copies", 10, 1.0, 1), ("copies", 10, 1.0, 1), ("copies", 20, 2.0, 0), ("copies", 20, 2.0, 0), ("copies", 30, 3.0, 1), ("copies", 30, 3.0, 1),
    ("untimed", 10, 1.0, 1), ("untimed", 20, 2.0, 0), ("untimed", 30, 3.0, 1), ("untimed", 30, 4.0, 0), ("untimed", None, 5.0, 0), ("untimed", None, 6.0, 1),
]


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """The folder of the table of EVENTS, and DuckDB with it."""
    folder, con = tmp_path_factory.mktemp("ties"), duckdb.connect()
    con.execute("set threads = 1")
    con.execute("create table e (target varchar, s bigint, value double, k integer)")
    con.executemany("insert into e values (?, ?, ?, ?)", EVENTS)
    con.execute(f"copy (select target as event_type, make_timestamp(1704067200000000 + s * 1000000) as ts, value, '{{\"k\": ' || k || '}}' as props from e) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


def test_interpolated_ties_as_sql(spark, events, same_rows):
    folder, con = events
    got = q.QUERIES["lc_interp_gap"](spark, folder)
    same_rows(got, con.sql(q.ORACLE_SQL["lc_interp_gap"]))
    counts = {r["target"]: r["count"] for r in got.groupBy("target").count().collect()}
    assert counts["pair"] == 1 + 2 + 4 + 4 + 2 + 1 and counts["unknown"] == 4


def test_ties_across_slices(spark, events, same_rows, monkeypatch):
    """Slices of a few rows, so that tied times lie on both sides of an edge; and ties that are joined by shuffles."""
    folder, con = events
    monkeypatch.setattr(store, "SMALL", 0)
    monkeypatch.setattr(lightcurve, "sliced", lambda rows, keys, order: scan.sliced(rows, keys, order, 2))
    same_rows(q.QUERIES["lc_interp_gap"](spark, folder), con.sql(q.ORACLE_SQL["lc_interp_gap"]))


def test_without_ties_a_row_for_each(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, None), ("a", 4.0, 9.0), (None, 1.0, None), (None, 2.0, 5.0)], "target string, t double, flux double")
    both = [sorted(map(tuple, f(rows).select("target", "t", "flux", "filled").collect()), key=repr) for f in (lightcurve.interpolate, lightcurve.interpolate_pairs)]
    assert both[0] == both[1] and ("a", 1.0, None, 3.0) in both[0]


def of_ticks(table, tick, folder, shrink=1):
    """DuckDB with the events of a table, their times divided and cut to ticks of some seconds, in a folder."""
    con, us = duckdb.connect(), f"(epoch_us(ts) - 1704067200000000) // {shrink} // {tick}000000 * {tick}000000"
    con.execute(f"copy (select * replace (make_timestamp(1704067200000000 + {us}) as ts) from '{table}/events.parquet') to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return con


def test_bridged_ties_as_sql(spark, sf_dir, tmp_path, same_rows):
    """The events in a quarter of their time: curves without gaps."""
    con = of_ticks(sf_dir, 613, tmp_path, 4)
    got = q.QUERIES["lc_detrend_around"](spark, str(tmp_path))
    same_rows(got, con.sql(q.ORACLE_SQL["lc_detrend_around"]))
    assert got.where("error is null").groupBy("target", "t", "flux").count().where("count > 1").count() > 0


def test_masked_ties_as_sql(spark, sf_dir, tmp_path, same_rows):
    """On sf0.01: with the 1,000 events of sf0.001 squeezed and cut to ticks two targets differ from SQL, with or without pairs, which is open."""
    con = of_ticks(Path(sf_dir).parent / "sf0.01", 300, tmp_path)
    same_rows(q.QUERIES["lc_masked_list"](spark, str(tmp_path)), con.sql(q.ORACLE_SQL["lc_masked_list"]))
