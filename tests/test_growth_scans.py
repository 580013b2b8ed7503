"""Summaries of slices go to the rows, not the rows to the summaries."""

from dipper.operators import scan


def test_rows_stay_where_they_are(spark):
    rows = scan.sliced(spark.range(1000).selectExpr("'a' as target", "cast(id as double) as t", "1D as flux"))
    joined = scan.attach(rows, rows.groupBy(*scan.ADDED).count())
    assert "strategy=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 1000 and joined.agg({"count": "sum"}).first()[0] == sum(r["count"] ** 2 for r in rows.groupBy(*scan.ADDED).count().collect())
