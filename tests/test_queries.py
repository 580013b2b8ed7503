"""Each query gives the rows of its SQL; those without SQL run and keep their schema."""

import pytest

from dipper import queries as q


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(q.QUERIES[name](spark, sf_dir), duck.sql(q.ORACLE_SQL[name]))


#: Queries without SQL whose operators are tested on curves of their own: too slow here, or of curves too sparse here.
ELSEWHERE = {"bls_full_grid", "transit_report", "live_search", "flatten_and_search"}


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL) - ELSEWHERE))
def test_runs(name, spark, sf_dir):
    assert q.QUERIES[name](spark, sf_dir).count() > 0


def test_flows_see_whole_light_curves(spark, sf_dir, monkeypatch):
    seen = {}

    def keep(name, result):
        def run(lc, **options):
            seen[name] = (lc, options)
            return result(lc)

        monkeypatch.setattr(q.pipeline, name, run)

    keep("clean", lambda lc: lc.selectExpr("target", "t", "flux", "flux as trend", "null as error"))
    keep("run", lambda lc: {"report": spark.createDataFrame([], q.report.BATCH_SCHEMA)})
    q.QUERIES["lc_masked_detrend"](spark, sf_dir)
    q.QUERIES["transit_report"](spark, sf_dir)
    whole = q.light_curves(spark, sf_dir)
    for name, options in (("clean", {"masked": True}), ("run", {})):
        assert seen[name][1] == options
        assert seen[name][0].exceptAll(whole).count() == whole.exceptAll(seen[name][0]).count() == 0


def test_full_grid(spark, sf_dir):
    from dipper.operators import kernels

    found = q.QUERIES["bls_full_grid"](spark, sf_dir).groupBy("target").agg({"period": "min", "pid": "max", "duration_days": "min", "start": "max"}).collect()
    spans = {r["target"]: r["baseline"] for r in q.lcs.baselines(q.light_curves(spark, sf_dir)).collect()}
    assert {r["target"] for r in found} == set(spans)
    for r in found:
        grid = kernels.period_grid(spans[r["target"]], 0.05, 0.3, 0.5, spans[r["target"]] / 3)
        assert r["max(pid)"] == len(grid) - 1 > 30_000 and r["min(period)"] < 0.501
        assert r["min(duration_days)"] < 0.06 and r["max(start)"] >= 390


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
