"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``).

    Where the setting is missing, as in tests, a temporary folder is set; only a local master may do that.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if (there := sc.getCheckpointDir()) is not None:
        return there
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="dipper-checkpoint-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, where several steps need them or must see the same ones."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that may go to all tasks.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``kept``, and where its rows are few, sent to all tasks by joins, so the larger side stays where it is."""
    df = kept(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, made."""
    from pyarrow import fs

    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    return root


def remove(root: str) -> None:
    """Deletes a folder that ``new_folder`` made, when its rows are no longer needed."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    store.delete_dir(path)


def write_file(root: str, name: str, data: bytes) -> None:
    """Writes one file from a task; a repeated task writes the same file again."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
