"""Structured Streaming: a landing folder feeds the batch flow; late points find their segment; progress is upserted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dipper.sources import fits

def read_landing(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of (path, target, t, flux, quality) rows from the FITS files that land in a folder; others are passed over."""
    return fits.stream_fits(spark, folder, files_per_batch)


def read_landed_rows(spark: SparkSession, folder: str, schema: str = "target string, t double, flux double, quality int", files_per_batch: int = 64) -> DataFrame:
    """The same of rows that land as Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process(stream: DataFrame, flow: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch flow on each micro-batch; a batch that is repeated replaces its own output."""

    def one(rows: DataFrame, batch: int) -> None:
        flow(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_flux(stream: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Mean flux by target and hour of event time, with a watermark for late rows. Needs a timestamp column ``ts``."""
    return stream.withWatermark("ts", delay).groupBy("target", F.window("ts", "1 hour")).agg(F.avg("flux").alias("mean_flux"), F.count(F.lit(1)).alias("n"))


def observing_sessions(stream: DataFrame, gap: str = "12 hours", delay: str = "6 hours") -> DataFrame:
    """Gapless runs by target as session windows. Unlike ``segments``, a gap of exactly 12 hours splits."""
    return stream.withWatermark("ts", delay).groupBy("target", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
