"""What a task has finished comes in one row, not in one for each few periods."""

from pyspark.sql import functions as F

from dipper.operators import bls, partial


def test_finished_parts_are_one_row(spark, monkeypatch):
    frame = type(spark.range(0))
    rows, of = [], frame.groupBy

    def group(self, *keys):
        if isinstance(keys[-1], str) and keys[-1] == "part":
            rows.append(self.count())
        return of(self, *keys)

    monkeypatch.setattr(frame, "groupBy", group)
    lc = spark.range(400).select(F.lit("a").alias("target"), (F.col("id") / 20).alias("t"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("flux"))
    periods = spark.range(200).select(F.col("id").alias("pid"), (2 + F.col("id") / 100).alias("period"))
    found = [sorted(map(repr, bls.search(lc, periods, 50, chunks=3, block=block).select("target", "pid", "start", "width", F.round("sr", 3)).collect())) for block in (partial.BLOCK, 150)]
    assert rows[0] == 3 and rows[1] > 9 and found[0] == found[1] and len(found[0]) == 200
