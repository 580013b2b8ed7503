"""Helpers that the operators share: blocks of text, ragged arrays, cut lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from dipper.sources.store import shared_dir

#: Bytes of text that one task handles at a time.
BLOCK_BYTES = 12 << 20
#: Bytes of text in one hash bucket of documents.
BUCKET_BYTES = 8 << 20


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder: later failures need not recompute them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column as large strings; null becomes the empty string."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(n.to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def ragged_take(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``index`` of a ragged array, as (offsets, values)."""
    start, length = offsets[:-1][index], np.diff(offsets)[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    at = np.arange(out[-1], dtype=np.int64) - np.repeat(out[:-1] - start, length)
    return out, values[at]


_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit words; another seed, another order."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((_ODD * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_codes(text: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (offsets per text, code per word, distinct words)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, off = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not keep.all():
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return off, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k neighbours in ``h``; entry i is for h[i : i + k]."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        v = mix(h, seed)
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        down = np.full(n - k + 1, _INV, np.uint64)
        down[0] = 1
        down = np.cumprod(down, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up, dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * down, seed + 7)
