"""Token ids in ORC files: written in ascending order of documents, read stripe by stripe, pruned by metadata.

Documents are range-partitioned by (id, hash of the text, place), so neither an id of many rows nor copies of one row
fill a partition. A partition encodes its documents in order and writes one ORC file of stripes: ids are integer lists,
which ORC run-length encodes; row indexes with minima and maxima stand every ``index_rows`` documents, and a Bloom
filter on the document's id beside each. So ``read_tokens`` with a range of ids skips files, stripes and row groups, and
with single ids those whose filters deny them. Stripes are read in parallel, whatever file they lie in.

A file holds where each document starts among the file's ids; sums over files, taken from their ``n_tokens`` columns
alone, give where it starts among all. Sums run within groups of 1,024 files and then over groups, so no task sees all.

Null texts count as empty (the end id alone). Very long texts are one row each; ORC's writer buffers by list elements,
so they don't multiply its memory. Repeated rows are written each. Null ids come first, ids may be of any type with an
order; rows of one id go by the hash of their texts. An empty table gives files without rows, and no rows. Other
columns than the id and the text are not read, so their names can't clash. The writer's tasks write under Spark's commit
protocol: a lost or repeated task leaves no second file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipper.llm.bpe import codec_of, share
from dipper.llm.common import blocks, cut, parallelism, text_column
from dipper.sources.store import new_folder, remove

#: Bytes of text in one file, about.
FILE_BYTES = 64 << 20
#: Files whose sums one task adds up.
GROUP_FILES = 1024


def write_tokens(df: DataFrame, path: str, root: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, stripe_bytes: int = 64 << 20, index_rows: int = 1000, false_positives: float = 0.01) -> None:
    """Encodes all documents with a tokenizer file and writes them below ``root``, in ascending order of the id.

    Columns of the files: ``id``, ``file`` (its number), ``place`` (of the row in its file), ``start`` (ids before it in its
    file), ``n_tokens`` (with the end id), ``ids``.
    """
    spark = df.sparkSession
    shared = share(df, path)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(parallelism(spark), -(-total // FILE_BYTES))
    order = ("id", "tie", "spread")
    dealt = rows.withColumns({"tie": F.xxhash64("text"), "spread": F.monotonically_increasing_id()}).repartitionByRange(files, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        place = start = 0
        for b in blocks(batches, "text"):
            off, ids = codec.encode(text_column(b, "text"))
            n = np.diff(off) + 1
            ends = np.cumsum(n)
            flat = np.empty(int(ends[-1]), np.int32)
            last = np.zeros(len(flat), bool)
            last[ends - 1] = True
            flat[last], flat[~last] = end_id, ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            columns = [pa.array(np.full(len(n), TaskContext.get().partitionId()), pa.int64()), pa.array(place + np.arange(len(n)), pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "file", "place", "start", "n_tokens", "ids"])
            place, start = place + len(n), start + int(ends[-1])

    kind = df.schema[id_col].dataType.simpleString()
    made = dealt.select("id", "text").mapInArrow(encode, _schema(kind))
    options = {"orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": false_positives}
    made.write.options(**options).orc(f"{root}/tokens")


def _schema(kind: str) -> str:
    return f"id {kind}, file long, place long, start long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, root: str, kind: str = "bigint", ids: Sequence[Any] | None = None, least: Any = None, most: Any = None) -> DataFrame:
    """The rows below ``root``; ``ids``, ``least`` and ``most`` are pushed to the files' statistics, indexes and Bloom filters."""
    rows = spark.read.schema(_schema(kind)).orc(f"{root}/tokens")
    if ids is not None:
        rows = rows.where(F.col("id").isin(list(ids)))
    if least is not None:
        rows = rows.where(F.col("id") >= F.lit(least))
    if most is not None:
        rows = rows.where(F.col("id") <= F.lit(most))
    return rows


def file_starts(tokens: DataFrame) -> DataFrame:
    """(file, file_start): the ids in all files before each. Reads two columns of the files."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = tokens.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("file") / GROUP_FILES))
    groups = sums.groupBy("group").agg(F.sum("n").alias("of_group")).withColumn("group_start", F.coalesce(F.sum("of_group").over(before(Window.orderBy("group"))), F.lit(0)))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("group").orderBy("file"))), F.lit(0))
    return sums.withColumn("within", within).join(groups, "group").select("file", (F.col("group_start") + F.col("within")).alias("file_start"))


def summarize_tokens(tokens: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per document of ``tokens``: ``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    ``starts``: of ``file_starts`` over all files. The sum is of the ids as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            off = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(off), pa.int64()), pa.array(sums, pa.int64())], names=["id", "file", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["id"].dataType.simpleString()
    found = tokens.select("id", "file", "start", "ids").mapInArrow(run, f"id {kind}, file long, start long, n_tokens long, ids_crc32 long")
    return found.join(starts, "file").select("id", (F.col("file_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as token ids in ORC files, and what the files hold of each; the files go when that is kept."""
    import public_tokenizers

    root = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), root)
    tokens = read_tokens(spark, root)
    found = cut(summarize_tokens(tokens, file_starts(tokens)).withColumnRenamed("id", "doc_id"))
    remove(root)
    return found


QUERIES = {"op11_token_files": op11_token_files}
