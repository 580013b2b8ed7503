import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Compares a DataFrame with rows of DuckDB by column name, doubles to 9 digits."""
    import math

    def norm(v):
        return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v

    def check(df, relation):
        columns = sorted(df.columns)
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        ours = sorted([tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()], key=repr)
        theirs = sorted([tuple(norm(r[i]) for i in at) for r in relation.fetchall()], key=repr)
        assert ours == theirs

    return check
