"""Packing documents into training sequences by shortest-pack-first over the length histogram.

A document's ids (and an end id) are cut into pieces of ``max_len``; what is left over is a piece of its own. The
histogram of these rests, at most ``max_len`` numbers whatever the data, is packed on the driver: lengths are placed
longest first, each into the shortest open packs that hold it, updating the counts of packing patterns. Patterns that
would leave more than ``slack`` tokens of padding are taken apart again; their pieces are laid end to end, longest
first, and cut at the borders of sequences, so that they leave none. A sequence whose length is a power of two isn't
padded. Patterns are joined back to documents by the rank of a piece among those of its length. Ranks are counts of
buckets added up, so no length, however common, passes through one task. Pieces are dealt to buckets by where they were
made, not by their document, so a repeated or null id fills no bucket.

Null texts count as empty (one piece with the end id); very long texts are as many pieces as they need; repeated rows are packed each; a null id stays null, and ids are
passed on as they are, of whatever type. Other columns than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipper.llm.bpe import codec_of, share
from dipper.llm.common import blocks, cut, parallelism, text_column

#: Pieces that a task of the last step holds.
BUCKET_PIECES = 20_000


def plan_patterns(hist: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first over a histogram of lengths: (lengths of a pack, number of such packs)."""
    open_packs: list[dict[tuple[int, ...], int]] = [{} for _ in range(max_len + 1)]  # by room left
    room = 0  # no open pack has more
    for length in sorted(hist, reverse=True):
        left = hist[length]
        new: list[tuple[int, tuple[int, ...], int]] = []
        at = max_len
        while left:
            while at >= length and not open_packs[at]:
                at -= 1
            if at < length:
                per = max_len // length  # new packs hold as many as fit, the last fewer
                packs, rest = divmod(left, per)
                new += [(max_len - per * length, (length,) * per, packs)] if packs else []
                new += [(max_len - rest * length, (length,) * rest, 1)] if rest else []
                break
            pattern, count = next(iter(open_packs[at].items()))
            fit = min(at // length, -(-left // count))
            use = min(count, left // fit)
            del open_packs[at][pattern]
            if count > use:
                open_packs[at][pattern] = count - use
            new.append((at - fit * length, pattern + (length,) * fit, use))
            left -= fit * use
        for r, pattern, count in new:
            open_packs[r][pattern] = open_packs[r].get(pattern, 0) + count
        room = max(room, at)
    return [(p, c) for packs in open_packs for p, c in packs.items()]


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


class Plan:
    """Where each rank of each length goes; its size depends on ``max_len`` alone."""

    def __init__(self, hist: dict[int, int], max_len: int, slack: int):
        self.max_len = max_len
        rests = {k: v for k, v in hist.items() if k < max_len}
        self.full = hist.get(max_len, 0)
        sequence = self.full
        slots: dict[int, list[tuple[int, int, int]]] = {k: [] for k in rests}  # first rank, first sequence, offset
        used = dict.fromkeys(rests, 0)
        tape = dict.fromkeys(rests, 0)
        for pattern, count in plan_patterns(rests, max_len):
            total = sum(pattern)
            if max_len - total > slack and not power_of_two(total):
                for x in pattern:
                    tape[x] += count
                continue
            offset = 0
            for x in pattern:
                slots[x].append((used[x], sequence, offset))
                used[x] += count
                offset += x
            sequence += count
        self.slots = {k: np.array(v, np.int64).reshape(-1, 3) for k, v in slots.items()}
        self.used = used
        self.tape_start, at = {}, 0
        for x in sorted(tape, reverse=True):
            self.tape_start[x] = at
            at += x * tape[x]
        self.tape_sequence = sequence
        # Borders of the last, part-filled sequence: its powers of two, each a sequence.
        self.tail = at // max_len * max_len
        sizes = [1 << b for b in range(max_len.bit_length(), -1, -1) if (at - self.tail) >> b & 1]
        self.tail_borders = np.concatenate([[self.tail], self.tail + np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Parts of a piece: (start in the piece, length, sequence, offset)."""
        if length == self.max_len:
            return [(0, length, rank, 0)]
        if rank < self.used[length]:
            slots = self.slots[length]
            i = int(np.searchsorted(slots[:, 0], rank, side="right")) - 1
            # equal first ranks don't occur: each slot holds at least one piece
            return [(0, length, int(slots[i, 1] + rank - slots[i, 0]), int(slots[i, 2]))]
        at = self.tape_start[length] + (rank - self.used[length]) * length
        parts, done = [], 0
        while done < length:
            p = at + done
            if p < self.tail:
                sequence, offset, end = self.tape_sequence + p // self.max_len, p % self.max_len, (p // self.max_len + 1) * self.max_len
            else:
                i = int(np.searchsorted(self.tail_borders, p, side="right")) - 1
                sequence, offset, end = self.tape_sequence + self.tail // self.max_len + i, p - int(self.tail_borders[i]), int(self.tail_borders[i + 1])
            n = min(length - done, end - p)
            parts.append((done, n, sequence, offset))
            done += n
        return parts


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 0, slack: int = 8, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Columns: the id column, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence) and, if asked for, ``ids``.
    """
    spark = df.sparkSession
    shared = share(df, path)
    largest = max([end_id, *shared.table.value["tokens"].values(), *shared.table.value["special"].values()])
    ids_kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        made = TaskContext.get().partitionId() << 33
        for b in blocks(batches, "text"):
            off, flat = codec.encode(text_column(b, "text"))
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i in range(b.num_rows):
                own = np.append(flat[off[i] : off[i + 1]], end_id).astype("<u4")
                for start in range(0, len(own), max_len):
                    part = own[start : start + max_len]
                    keep = with_ids or len(part) < max_len  # only a rest may be cut again
                    for column, v in zip(rows, (i, start, len(part), zlib.crc32(part.tobytes()), len(own), part.astype(ids_kind).tobytes() if keep else None), strict=True):
                        column.append(v)
            numbers = pa.array(np.arange(made, made + len(rows[0])), pa.int64())
            made += len(rows[0])
            yield pa.RecordBatch.from_arrays([numbers, b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["piece", "id", "start", "length", "ids_crc32", "doc_tokens", "raw"])

    kind = df.schema[id_col].dataType.simpleString()
    made = cut(df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(pieces, f"piece long, id {kind}, start long, length long, ids_crc32 long, doc_tokens long, raw binary"))
    hist = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    plan = Plan(hist, max_len, slack)
    n_buckets = max(parallelism(spark), -(-sum(hist.values()) // BUCKET_PIECES))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(n_buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("bucket").alias("in_bucket"), F.col("length").alias("of_length"), "base")

    def place(rows: pa.Table, base: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("length", "ascending"), ("piece", "ascending")]))
        lengths = rows.column("length").to_numpy()
        bases = dict(zip(base.column("of_length").to_pylist(), base.column("base").to_pylist(), strict=True))
        first = np.flatnonzero(np.diff(lengths, prepend=-1))
        rank = np.arange(len(lengths)) - np.repeat(first, np.diff(np.append(first, len(lengths))))
        out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")}
        for i, (start, length, crc, raw, k) in enumerate(zip(rows.column("start").to_pylist(), lengths.tolist(), rows.column("ids_crc32").to_pylist(), rows.column("raw").to_pylist(), rank.tolist(), strict=True)):
            parts = plan.place(length, k + bases[length])
            ids = np.frombuffer(raw, ids_kind).astype("<u4") if with_ids or len(parts) > 1 else None
            for a, n, sequence, offset in parts:
                part = None if ids is None else ids[a : a + n]
                for c, v in zip(out.values(), (i, start + a, n, crc if len(parts) == 1 else zlib.crc32(part.tobytes()), sequence, offset, part if with_ids else None), strict=True):
                    c.append(v)
        at = pa.array(out.pop("row"), pa.int64())
        ids = pa.array(out.pop("ids"), pa.list_(pa.int64()))
        return pa.table({"id": rows.column("id").take(at), "doc_tokens": rows.column("doc_tokens").take(at)} | {k: pa.array(v, pa.int64()) for k, v in out.items()} | {"ids": ids})

    schema = f"id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<long>"
    dealt = max(parallelism(spark), n_buckets // 16)
    placed = made.repartition(dealt, "bucket").groupBy("bucket").cogroup(bases.repartition(dealt, "in_bucket").groupBy("in_bucket")).applyInArrow(lambda rows, base: place(rows, base), schema)
    names = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*names, *(["ids"] if with_ids else []))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


QUERIES = {"op8_pack_documents": op8_pack_documents}
