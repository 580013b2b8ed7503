"""Jobs followed as a keyed stream: each job's state, and the last status of each of its stages, as events arrive.

Events are (job_id, seq, stage, status). A job is ``error`` if any event is one, ``completed`` if any is complete, ``running``
if any stage but the upload was seen, else ``pending``; a stage has the status of its largest ``seq``. Both hold for events in
any order and for repeated ones, so a batch that runs again changes nothing. The state of a job is one row and one for each of
its stages, whatever the number of events. Null jobs and stages are ones of their own; events without ``seq`` come first.
Events are combined where they are read, so a job with a third of all events sends a row a stage from each of their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: States by how far they outweigh others.
STATES = ("pending", "running", "completed", "error")

EVENTS = "job_id string, seq long, stage string, status string"
COMBINED = "job_id string, stage string, status string, last_seq long, first_seq long, level int"
CHANGES = "job_id string, stage string, status string, last_seq long, first_seq long, state string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Stands before all events that have a number.
NO_SEQ = -(1 << 62)


class _Jobs(StatefulProcessor):
    """Gives a CHANGES row for each stage that a batch's events touch, with the job's state after them."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "level int", self.keep_ms)
        self.stages = handle.getMapState("stages", "stage string, known boolean", "status string, last_seq long, first_seq long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        level, touched = (self.job.get()[0] if self.job.exists() else 0), {}
        for part in rows:
            level = max(level, int(part["level"].max()))
            for name, status, last, first in zip(part["stage"], part["status"], part["last_seq"], part["first_seq"], strict=True):
                at = ("", False) if pd.isna(name) else (name, True)
                now = (None if pd.isna(status) else status, int(last), int(first))
                old = touched.get(at) or (tuple(self.stages.getValue(at)) if self.stages.containsKey(at) else now)
                newer = now if (now[1], now[0] or "") >= (old[1], old[0] or "") else old
                touched[at] = (newer[0], newer[1], min(now[2], old[2]))
        self.job.update((level,))
        for at, value in touched.items():
            self.stages.updateValue(at, value)
        out = [(key[0], name if known else None, *touched[name, known], STATES[level]) for name, known in touched]
        yield pd.DataFrame(out, columns=["job_id", "stage", "status", "last_seq", "first_seq", "state"])

    def close(self) -> None:
        pass


def combined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """COMBINED rows of EVENTS: of each piece, one row a job and stage, as the last and the first event and the weightiest state."""
    of = ["job_id", "stage"]
    for part in parts:
        status, stage = part["status"], part["stage"]
        level = np.select([status == "error", status == "complete", stage.notna() & (stage != "upload")], [3, 2, 1], 0)
        part = part.assign(seq=[NO_SEQ if pd.isna(x) else int(x) for x in part["seq"]], text=status.fillna(""), level=level).sort_values(["seq", "text"])
        ends = part.groupby(of, dropna=False, sort=False)
        part = part.assign(first_seq=ends["seq"].transform("min"), level=ends["level"].transform("max"))
        yield part.drop_duplicates(of, keep="last").rename(columns={"seq": "last_seq"})[["job_id", "stage", "status", "last_seq", "first_seq", "level"]]


def follow(events: DataFrame, log: str, checkpoint: str, keep_ms: int | None = None) -> StreamingQuery:
    """Runs a stream of EVENTS to the log of changes; what is there is taken, then it ends.

    A micro-batch writes its own folder of the log, so a repeated one replaces itself. ``keep_ms``: state not changed for
    that long is forgotten; a job that goes on later starts anew.
    """
    spark = events.sparkSession

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{log}/batch={batch}")

    changes = events.select("job_id", "seq", "stage", "status").mapInPandas(combined, COMBINED).groupBy("job_id").transformWithStateInPandas(_Jobs(keep_ms), CHANGES, "Update", "ProcessingTime" if keep_ms else "None")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def read_log(spark: object, log: str) -> DataFrame:
    """CHANGES and ``batch``, all of them: who joins late reads here what has been told so far."""
    return spark.read.schema(f"{CHANGES}, batch long").option("basePath", log).parquet(log)


def states(log: DataFrame) -> DataFrame:
    """(job_id, state) as of the last batch."""
    return log.groupBy("job_id").agg(F.max_by("state", "batch").alias("state"))


def stages(log: DataFrame) -> DataFrame:
    """(job_id, stage, status, first_seq) as of the last batch, as ``report.latest_status``."""
    now = log.groupBy("job_id", "stage").agg(F.max_by(F.struct("status", "first_seq"), "batch").alias("now")).select("job_id", "stage", "now.*")
    return now.withColumn("first_seq", F.when(F.col("first_seq") != NO_SEQ, F.col("first_seq")))
