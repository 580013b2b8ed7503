"""What is shown and written: batch summary, result documents, downsampling, chart domains, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipper.functions.scores import confidence, finite, nan_to_null
from dipper.operators.lightcurve import with_joined
from dipper.operators.scan import ADDED, numbered, sliced

#: Columns and texts of the summary, here and below.
BATCH_SCHEMA = "tic_id string, status string, period double, depth_ppm double, duration_hrs double, sde double, fap string, odd_even_sigma double, secondary_ratio double"


def top_candidates(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest candidates of each target."""
    return candidates.where(F.col("peak_rank") <= k)


def batch_report(targets: DataFrame, best: DataFrame) -> DataFrame:
    """A BATCH_SCHEMA row for each target: its best passed candidate, or zeros."""
    b = best.select(F.col("target").alias("of_target"), F.lit(True).alias("found"), "period", "depth", "duration_days", "sde", "odd_even_diff_sigma", "secondary_ratio")
    rows = targets.select("target").join(b, F.col("target").eqNullSafe(F.col("of_target")), "left")
    found = F.col("found").isNotNull()  # the target itself may be null
    number = lambda c: F.when(found, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return rows.select(
        F.col("target").alias("tic_id"), F.when(found, "VETTED CANDIDATE").otherwise("NO CANDIDATE / FALSE POSITIVE").alias("status"),
        number(F.col("period")).alias("period"), number(F.abs("depth") * 1e6).alias("depth_ppm"), number(F.col("duration_days") * 24).alias("duration_hrs"),
        number(F.col("sde")).alias("sde"), F.lit("N/A").alias("fap"), number(F.col("odd_even_diff_sigma")).alias("odd_even_sigma"), number(F.col("secondary_ratio")).alias("secondary_ratio"),
    )


def batch_csv_lines(report: DataFrame) -> DataFrame:
    """The report with the digits that the summary file has; write with ``header``."""
    form = lambda c, d, n: F.format_string(f"%.{d}f", c).alias(n)
    return report.select(F.col("tic_id").alias("TIC_ID"), F.col("status").alias("Status"), form("period", 5, "Period_days"), form("depth_ppm", 1, "Depth_ppm"), form("duration_hrs", 2, "Duration_hrs"), form("sde", 2, "SDE"), F.col("fap").alias("FAP"), form("odd_even_sigma", 2, "OddEvenSigma"), form("secondary_ratio", 3, "SecondaryRatio"))


def write_batch_csv(report: DataFrame, path: str) -> None:
    """The summary file; one row a target, so one part is enough."""
    batch_csv_lines(report).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_candidates_csv(candidates: DataFrame, path: str) -> None:
    """All values quoted, missing ones empty."""
    candidates.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def result_documents(lc: DataFrame, power: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, document): one JSON text a target; NaN and infinities are null.

    A text holds the target's whole light curve, as its readers need, so it must fit a row (2 GB, tens of millions of points).
    """
    curve = lc.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("t", "flux"))).alias("c")).select("target", F.struct(F.transform("c", lambda x: nan_to_null(x["t"])).alias("time"), F.transform("c", lambda x: nan_to_null(x["flux"])).alias("flux")).alias("light_curve"))
    graph = power.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("period", "sde", "sr"))).alias("p")).select("target", F.struct(F.col("p.period").alias("periods"), F.transform("p.sde", nan_to_null).alias("sde"), F.transform("p.sr", nan_to_null).alias("sr")).alias("periodogram"))
    found = candidates.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("peak_rank", "period", "sde", "depth", "is_harmonic", "status"))).alias("candidates"))
    rows = with_joined(with_joined(curve, graph), found)
    passed = F.filter("candidates", lambda c: c["status"] == "PASSED")
    best = F.when(F.size(passed) > 0, F.get(passed, F.lit(0)))
    document = F.to_json(F.struct("target", "light_curve", "periodogram", "candidates", best.alias("best_candidate"), best.isNotNull().alias("detection")), {"ignoreNullFields": "false"})
    return rows.select("target", document.alias("document"))


def write_json(documents: DataFrame, path: str) -> None:
    """A folder of JSON texts, one a target, below the target's name; many targets a task."""
    documents.repartition("target").write.mode("overwrite").partitionBy("target").text(path)


def with_confidence(vetted: DataFrame) -> DataFrame:
    return vetted.withColumn("confidence", confidence(F.col("status"), F.col("sde")))


def downsample(lc: DataFrame, most: int = 3000) -> DataFrame:
    """Every k-th point by time, k = max(1, floor(n / most)) of the target."""
    rows = numbered(sliced(lc))
    return rows.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0).drop("i", "n", *ADDED)


def chart_domain(lc: DataFrame, pad: float = 0.1) -> DataFrame:
    """(target, lo, hi): the range of the finite fluxes, padded by a share of its length."""
    own = lc.where(finite(F.col("flux"))).groupBy("target").agg(F.min("flux").alias("a"), F.max("flux").alias("b"))
    room = (F.col("b") - F.col("a")) * pad
    return own.select("target", (F.col("a") - room).alias("lo"), (F.col("b") + room).alias("hi"))


def latest_status(progress: DataFrame) -> DataFrame:
    """(job_id, stage, status, first_seq): the last status of each stage; ``first_seq`` gives the stages' order."""
    last = F.max(F.struct("seq", "status")).alias("last")
    return progress.groupBy("job_id", "stage").agg(last, F.min("seq").alias("first_seq")).select("job_id", "stage", "last.status", "first_seq")


def job_states(progress: DataFrame) -> DataFrame:
    """(job_id, state): error if any event is one, completed if one is, running if there is any but the upload."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return progress.groupBy("job_id").agg(F.when(has("error"), "error").when(has("complete"), "completed").when(F.bool_or(F.col("stage") != "upload"), "running").otherwise("pending").alias("state"))
