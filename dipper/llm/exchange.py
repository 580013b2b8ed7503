"""Finding what repeats across documents, without joining it back to documents.

Documents are dealt into hash buckets of a few MB. A bucket sends each of its distinct keys once, whatever number of its
documents hold it, so that even a key that a third of all documents share makes one entry a bucket. Keys travel to hash
shards in packed arrays; a shard sees all entries of its keys and answers each array, in its order. Buckets derive the
same keys again and read the answers. The dealt documents are one shuffle, used by all steps of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dipper.llm.common import parallelism

#: Bytes of text in one bucket.
BUCKET_BYTES = 4 << 20
#: Bytes of text in one partition of buckets, at most about.
PARTITION_BYTES = 64 << 20


class Dealt(NamedTuple):
    """Rows dealt out by their column ``bucket``, over how many partitions, and the bytes that they hold in all."""

    rows: DataFrame
    partitions: int
    total: int


def deal_buckets(rows: DataFrame, key: Column, total: int) -> Dealt:
    """Deals rows to hash buckets of a few MB by a key; the number of partitions grows with the bytes."""
    spark = rows.sparkSession
    buckets = max(4 * parallelism(spark), -(-total // BUCKET_BYTES))
    partitions = max(parallelism(spark), -(-total // PARTITION_BYTES))
    rows = rows.select(F.pmod(key, F.lit(buckets)).alias("bucket"), "*").repartition(partitions, "bucket")
    return Dealt(rows, partitions, total)


def deal(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> Dealt:
    """Documents as (bucket, id, text), dealt out by bucket. Null texts become empty.

    ``carry``: other columns to take along, in a struct ``rest``.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # by both, so that neither an id of many texts nor a text of many ids fills a bucket; steps must deal alike, so not by place
    return deal_buckets(rows, F.xxhash64("id", "text"), total)


def shard_slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Where ascending 64-bit keys fall into equal ranges, as (shard, slice); only those that hold keys."""
    if not len(keys):
        return
    of = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(of[a]), slice(a, b)


def answer(dealt: Dealt, keys_of: Callable[[pa.Table], Iterator[tuple[int, bytes]]], judge: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Sends packed keys of each bucket to their shards: (at_bucket, at_shard, said).

    ``keys_of``: (shard, packed entries) of a bucket; ``judge``: what to say to each array that a shard got.
    """

    def send(table: pa.Table) -> pa.Table:
        found = list(keys_of(table))
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        return pa.table({"shard": pa.array([s for s, _ in found], pa.int64()), "from_bucket": pa.array([bucket] * len(found), pa.int64()), "packed": pa.array([x for _, x in found], pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        said = judge(table.column("packed").to_pylist())
        keep = [i for i, x in enumerate(said) if x]
        return pa.table({"at_bucket": table.column("from_bucket").take(pa.array(keep, pa.int64())), "at_shard": table.column("shard").take(pa.array(keep, pa.int64())), "said": pa.array([said[i] for i in keep], pa.binary())})

    sent = dealt.rows.groupBy("bucket").applyInArrow(send, "shard long, from_bucket long, packed binary")
    return sent.groupBy("shard").applyInArrow(reply, "at_bucket long, at_shard long, said binary")


def with_answers(dealt: Dealt, answers: DataFrame, apply: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """Each bucket's documents with what the shards said to it."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        return apply(docs, said)

    return dealt.rows.groupBy("bucket").cogroup(answers.repartition(dealt.partitions, "at_bucket").groupBy("at_bucket")).applyInArrow(run, schema)


def repeated(arrays: list[bytes], dtype: np.dtype, key: str, flag: str) -> list[bytes]:
    """A bitmap for each array of entries: which keys occur in another array too, or are flagged in any."""
    entries = np.concatenate([np.frombuffer(a, dtype) for a in arrays])
    _, inverse = np.unique(entries[key], return_inverse=True)
    total = np.bincount(inverse, weights=1 + entries[flag])
    hit = total[inverse] >= 2
    ends = np.cumsum([len(a) // dtype.itemsize for a in arrays])
    return [np.packbits(x).tobytes() for x in np.split(hit, ends[:-1])]


def read_bitmaps(said: pa.Table, lengths: list[tuple[int, int]], column: str = "said") -> np.ndarray:
    """The bits of a bucket's answers, in the order of its keys; ``lengths``: (shard, number of keys sent)."""
    by_shard = dict(zip(said.column("at_shard").to_pylist(), said.column(column).to_pylist(), strict=True)) if said.num_rows else {}
    parts = [np.unpackbits(np.frombuffer(by_shard[s], np.uint8), count=n).astype(bool) if s in by_shard else np.zeros(n, bool) for s, n in lengths]
    return np.concatenate(parts) if parts else np.zeros(0, bool)
