"""The format ``fits``: what reaches the reader, row ranges, and writes with a commit."""

import glob
import io
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dipper.sources import fits
from dipper.streaming import landing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    fits.register(spark)
    path = str(tmp_path_factory.mktemp("fits"))
    rows = spark.range(4000).selectExpr("cast(id % 3 as string) as target", "id / 100D as t", "cast(id % 97 as double) as flux", "cast(id % 4 as int) as quality")
    rows.repartition(2, "target").write.format("fits").mode("append").save(path)
    return path


def read(spark, path, schema=fits.LC_SCHEMA, **options):
    return spark.read.format("fits").options(**options).schema(schema).load(path)


def test_filters_and_columns_reach_the_reader(spark, folder):
    df = read(spark, folder, "t double, quality int").where("quality = 1 and t > 20").select("t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan fits[t#" in plan and "Filter (" not in plan
    assert df.count() == sum(1 for i in range(4000) if i % 4 == 1 and i / 100 > 20)
    for where in ("target = '2'", "target in ('0', '1') and quality in (2, 3)", "flux >= 50 and flux < 60.5", "not quality = 0", "target is not null", "target like '1%'", "quality <=> 3", "quality = null"):
        assert read(spark, folder).where(where).count() == fits.read_fits(spark, folder).where(where).count(), where


def test_stream_takes_each_file_once(spark, tmp_path):
    """Over restarts, files of older dates, several files an entry, and a query that stops between log and batch."""
    fits.register(spark)
    folder, log, out, state = (str(tmp_path / n) for n in ("in", "log", "out", "state"))
    os.makedirs(folder)

    def land(name, n):
        data = fits.write_table([("TIME", "D", np.arange(float(n))), ("FLUX", "D", np.full(n, 1.0)), ("QUALITY", "J", np.arange(n))], {"OBJECT": name})
        with open(f"{folder}/{name}.fits", "wb") as f:
            f.write(data)

    def run():
        rows = spark.readStream.format("fits").option("log", log).option("maxFiles", 2).schema("target string, t double").load(folder)
        landing.process(rows, lambda x: x, out, state).awaitTermination()
        return sorted((r["target"], r["n"]) for r in spark.read.parquet(out).groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect())

    for name in "abcde":
        land(name, 5)
    assert run() == [(x, 5) for x in "abcde"] and len(os.listdir(log)) == 3
    land("0", 3)
    os.utime(f"{folder}/0.fits", (1, 1))
    assert run() == [("0", 3)] + [(x, 5) for x in "abcde"]
    land("f", 4)  # listed in the log, but its batch was never told of
    reader = fits._Stream(fits._Reader({"path": folder, "log": log, "maxfiles": "2"}, ["target", "t"]))
    assert reader.latestOffset() == reader.latestOffset() == {"entries": 5}
    land("g", 1)
    assert run()[-2:] == [("f", 4), ("g", 1)] and run() == run()
    assert reader.partitions({"entries": 2}, {"entries": 2}) == []
    with pytest.raises(ValueError, match="log"):
        fits._Stream(fits._Reader({"path": folder}, ["t"]))


def test_nan_compare_as_in_spark(spark, tmp_path):
    fits.register(spark)
    data = fits.write_table([("TIME", "D", np.array([1.0, 2.0, np.nan])), ("FLUX", "D", np.array([np.nan, 5.0, 1.0]))], {})
    (tmp_path / "a.fits").write_bytes(data)
    both = read(spark, str(tmp_path / "a.fits"), keepNan="true")
    assert both.where("flux > 3").count() == 2 and both.where("quality = 0 and t >= 2").count() == 2


def test_row_ranges_give_the_same_rows(spark, folder):
    key = lambda df: sorted(map(tuple, df.select("target", "t", "flux", "quality").collect()))
    split = read(spark, folder, splitBytes=5000)
    assert split.rdd.getNumPartitions() >= 15 and read(spark, folder).rdd.getNumPartitions() == 1
    assert key(split) == key(read(spark, folder)) == key(fits.read_fits(spark, folder))
    one = sorted(glob.glob(f"{folder}/*"))[0]
    assert key(read(spark, f"file://{one}", splitBytes=999)) == key(fits.read_fits(spark, one))


def test_only_ranges_are_read(folder):
    """The headers and the rows asked for, of a file with much behind them."""
    path = sorted(glob.glob(f"{folder}/*"))[0]

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    with open(path, "rb") as f:
        data = f.read()
    file = pa.PythonFile(Counting(data + b"\0" * 50_000_000), "r")
    assert fits.find_table(file)[3]["time"] == "TIME" and Counting.taken < 20_000


def test_commit_and_abort(spark, folder, tmp_path):
    path = str(tmp_path / "out")
    rows = read(spark, folder).drop("path")

    def broken(batches):
        for b in batches:
            yield b
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        rows.repartition(3).unionByName(rows.limit(5).coalesce(1).mapInArrow(broken, rows.schema)).select("target", "t", "flux", "quality").write.format("fits").mode("append").save(path)
    assert not [p for p in os.listdir(path) if not p.startswith("_")] and read(spark, path).count() == 0
    rows.withColumn("target", F.when(F.col("target") != "1", F.col("target"))).select("target", "t", "flux", "quality").write.format("fits").option("points", 500).mode("append").save(path)
    assert read(spark, path).count() == 4000 and len(os.listdir(path)) > 8
    rows.limit(10).select("target", "t", "flux", "quality").write.format("fits").option("ending", ".fits.gz").mode("overwrite").save(path)
    assert read(spark, path).count() == 10


def test_unknown_columns_and_paths_raise(spark, folder):
    with pytest.raises(Exception, match="no column"):
        read(spark, folder, "t double, colour string").count()
    with pytest.raises(Exception, match="nowhere"):
        read(spark, "/tmp/nowhere-fits").count()
