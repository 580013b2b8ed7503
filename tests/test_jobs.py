"""Jobs followed as a stream end in the rows of the batch aggregates, in batches, in any order, and when run again."""

import random

import pytest

from dipper.operators import report
from dipper.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def events():
    rng = random.Random(4)
    out = [(f"j{rng.randrange(9)}", i, rng.choice(["upload", "search", "vetting"]), rng.choice(["running"] * 30 + ["complete", "error"])) for i in range(300)]
    out += [("quiet", 1000, "upload", "running"), (None, 1001, "search", "complete"), (None, 1002, None, None), ("quiet", 1003, None, "running")]
    return out


def test_stream_in_batches_is_the_batch_aggregate(spark, events, tmp_path):
    order = events[:]
    random.Random(1).shuffle(order)
    landed, log, state = (str(tmp_path / n) for n in ("landed", "log", "state"))
    stream = lambda: spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(landed)
    whole = spark.createDataFrame(events, jobs.EVENTS)
    for part in (order[:100], order[100:180], order[180:] + order[:50]):
        spark.createDataFrame(part, jobs.EVENTS).coalesce(1).write.mode("append").parquet(landed)
        jobs.follow(stream(), log, state).awaitTermination()
    told = jobs.read_log(spark, log)
    assert told.select("batch").distinct().count() >= 3
    assert rows(jobs.states(told)) == rows(report.job_states(whole))
    assert rows(jobs.stages(told)) == rows(report.latest_status(whole))
    assert {r["job_id"]: r["state"] for r in jobs.states(told).collect()}["quiet"] == "pending"


def test_empty_stream(spark, tmp_path):
    landed, log, state = (str(tmp_path / n) for n in ("landed", "log", "state"))
    spark.createDataFrame([], jobs.EVENTS).write.parquet(landed)
    (tmp_path / "log").mkdir()
    jobs.follow(spark.readStream.schema(jobs.EVENTS).parquet(landed), log, state).awaitTermination()
    assert jobs.states(jobs.read_log(spark, log)).count() == 0
