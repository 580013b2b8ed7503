"""Light curves and frames from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def days_since_origin(column: str) -> str:
    """SQL for days between ORIGIN and a timestamp without time zone."""
    return f"(unix_micros(cast({column} as timestamp)) - unix_micros(cast(timestamp_ntz'{ORIGIN}' as timestamp))) / 8.64e10D"


def _events(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    quality = F.get_json_object("props", "$.k").cast("long").bitwiseAND(F.lit(3).cast("long")).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col(target).cast("string").alias("target"), F.expr(days_since_origin("ts")).alias("t"), F.col("value").alias("flux"), quality.alias("quality"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, target, t) of all events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").cast("string").alias("target"), F.expr(days_since_origin("ts")).alias("t"))


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, t, flux, quality): one target for each event type."""
    return _events(spark, sf_dir, "event_type")


def user_light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a target for each user: many targets with gaps."""
    return _events(spark, sf_dir, "user_id")


def pixels(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """(target, cadence, row, col, px): each embedding is a frame."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("target"), F.col("vec_id").alias("cadence"), F.posexplode("embedding").alias("pos", "value"))
    return rows.select("target", "cadence", F.floor(F.col("pos") / side).cast("int").alias("row"), (F.col("pos") % side).cast("int").alias("col"), F.col("value").cast("double").alias("px"))
