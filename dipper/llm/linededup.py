"""Line dedup: lines whose key is found in many documents lose all their occurrences.

1. Buckets of documents send each distinct line hash once, with its number of documents, to hash shards. A shard keeps the
   hashes found more than once, builds a minimal perfect hash over them, and publishes its arrays: the levels of the hash,
   and by slot a fingerprint of 32 bits and the number of documents. It also publishes the hashes of the common lines in
   full, for a second look at hits. Lines of one document alone, most of them, are in no array.
2. Documents probe the published arrays: a bucket's distinct hashes meet the arrays of their shard, a probe whose slot holds
   another fingerprint is turned away, and a hit on a common line is confirmed by the full hash. Bits go back to the
   bucket, which drops its lines. No line is joined. See ``exchange`` for how hot lines stay small.

A null or empty text is one empty line; empty keys are never dropped. Rows are documents each, also repeated ones. Very
long texts and lines are read whole. Columns other than the id, the text and those to carry are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dipper.llm.common import mix
from dipper.llm.exchange import deal, read_bitmaps, shard_slices, with_answers

#: Line hashes in one shard, about.
SHARD_LINES = 250_000
_KEY = np.dtype([("hi", "<u8"), ("lo", "<u8")])
_ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("docs", "<u4")])
_BLANK = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys: levels of bits that one key alone has set."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = 0
        while len(hi):
            size = 2 * len(hi)
            at = self._at(hi, lo, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = before + np.cumsum(alone) - alone
            self.levels.append((alone, ranks))
            before += int(alone.sum())
            left = ~alone[at]
            hi, lo = hi[left], lo[left]

    @classmethod
    def of_levels(cls, bits: list[np.ndarray]) -> PerfectHash:
        """The hash whose levels have these bits."""
        out = cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        before = 0
        for alone in bits:
            out.levels.append((alone, before + np.cumsum(alone) - alone))
            before += int(alone.sum())
        return out

    @staticmethod
    def _at(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return ((mix(hi, 2 * level) ^ mix(lo, 2 * level + 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that aren't there, any slot for others."""
        out = np.full(len(hi), -1, np.int64)
        rest = np.arange(len(hi))
        for level, (alone, ranks) in enumerate(self.levels):
            at = self._at(hi[rest], lo[rest], level, len(alone))
            here = alone[at]
            out[rest[here]] = ranks[at[here]]
            rest = rest[~here]
        return out


class LineIndex:
    """The published arrays of one shard, built from the entries that buckets sent."""

    def __init__(self, entries: np.ndarray, min_docs: int):
        keys, inverse = np.unique(in_full(entries), return_inverse=True)
        docs = np.bincount(inverse, weights=entries["docs"], minlength=len(keys)).astype(np.int64)
        shared = docs >= min(2, min_docs)  # a line of one document alone says nothing, unless one is enough
        keys, docs = keys[shared], docs[shared]
        hi, lo = keys["hi"].copy(), keys["lo"].copy()
        self.hash = PerfectHash(hi, lo)
        slot = self.hash(hi, lo)
        self.fingerprints, self.counts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
        self.fingerprints[slot], self.counts[slot] = fingerprint(lo), np.minimum(docs, 0xFFFFFFFF)
        # in full, in the order of their slots; ``rank`` says where a slot's is
        common = np.sort(slot[docs >= min_docs])
        at = np.empty(len(keys), np.int64)
        at[slot] = np.arange(len(keys))
        self.common, self.full = common, keys[at[common]]

    def packed(self) -> bytes:
        levels = [(np.packbits(alone).tobytes(), len(alone)) for alone, _ in self.hash.levels]
        return pickle.dumps((levels, self.fingerprints.tobytes(), self.counts.tobytes(), self.common.tobytes(), self.full.tobytes()))

    @classmethod
    def unpacked(cls, raw: bytes) -> LineIndex:
        levels, fingerprints, counts, common, full = pickle.loads(raw)
        index = cls.__new__(cls)
        index.hash = PerfectHash.of_levels([np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for bits, n in levels])
        index.fingerprints, index.counts = np.frombuffer(fingerprints, "<u4"), np.frombuffer(counts, "<u4")
        index.common, index.full = np.frombuffer(common, np.int64), np.frombuffer(full, _KEY)
        return index

    def documents(self, keys: np.ndarray) -> np.ndarray:
        """By the arrays alone, in how many documents each line is found; 0 where the fingerprint differs, as for lines of one."""
        slot = self.hash(keys["hi"], keys["lo"])
        if not len(self.counts):
            return np.zeros(len(keys), np.int64)
        return np.where((slot >= 0) & (self.fingerprints[slot] == fingerprint(keys["lo"])), self.counts[slot], 0)

    def are_common(self, keys: np.ndarray, min_docs: int) -> np.ndarray:
        """Which lines are found in ``min_docs`` documents or more: hits of the arrays that are the common line itself."""
        hit = np.flatnonzero(self.documents(keys) >= min_docs)
        out = np.zeros(len(keys), bool)
        slot = self.hash(keys["hi"][hit], keys["lo"][hit])
        full = self.full[np.searchsorted(self.common, slot)] if len(hit) else self.full[:0]
        out[hit] = (full["hi"] == keys["hi"][hit]) & (full["lo"] == keys["lo"][hit])
        return out


def in_full(entries: np.ndarray) -> np.ndarray:
    """The hashes of entries, without their counts."""
    keys = np.empty(len(entries), _KEY)
    keys["hi"], keys["lo"] = entries["hi"], entries["lo"]
    return keys


def fingerprint(lo: np.ndarray) -> np.ndarray:
    return (lo >> np.uint64(32)).astype("<u4")


def line_keys(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and a 16-byte hash of each line's key (none for an empty key)."""
    from xxhash import xxh3_128_digest

    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [xxh3_128_digest(k) if (k := x.strip(_BLANK).lower()) else b"" for x in lines]


def drop_common_lines(df: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: the id, ``n_lines`` (before), ``n_dropped``, the text without the lines dropped, and columns to ``carry``."""
    dealt = deal(df, id_col, text_col, carry)
    lines = df.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))), F.lit(0))).first()[0]
    shards = max(32, -(-lines // SHARD_LINES))

    def entries_of(table: pa.Table) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The distinct line hashes of a bucket with their documents, by shard; and where each shard's are."""
        docs: dict[bytes, int] = {}
        for text in table.column("text").to_pylist():
            for k in set(line_keys(text)[1]):
                docs[k] = docs.get(k, 0) + 1
        docs.pop(b"", None)
        entries = np.zeros(len(docs), _ENTRY)
        pair = np.frombuffer(b"".join(docs), "<u8").reshape(-1, 2)
        entries["hi"], entries["lo"], entries["docs"] = pair[:, 0], pair[:, 1], np.fromiter(docs.values(), np.int64, len(docs))
        entries = entries[np.lexsort((entries["lo"], entries["hi"]))]
        return entries, list(shard_slices(entries["hi"], shards))

    def send(table: pa.Table) -> pa.Table:
        entries, cuts = entries_of(table)
        return pa.table({"shard": pa.array([s for s, _ in cuts], pa.int64()), "packed": pa.array([entries[c].tobytes() for _, c in cuts], pa.binary())})

    def build(table: pa.Table) -> pa.Table:
        index = LineIndex(np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("packed").to_pylist()]), min_docs)
        return pa.table({"of_shard": table.column("shard")[:1], "arrays": pa.array([index.packed()], pa.binary())})

    def probe(table: pa.Table) -> pa.Table:
        entries, cuts = entries_of(table)
        at = table.column("bucket")[0].as_py() if table.num_rows else 0
        packed = [in_full(entries[c]).tobytes() for _, c in cuts]
        return pa.table({"shard": pa.array([s for s, _ in cuts], pa.int64()), "from_bucket": pa.array([at] * len(cuts), pa.int64()), "packed": pa.array(packed, pa.binary())})

    def look_up(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        if not arrays.num_rows:
            raise ValueError("a shard without arrays")
        index = LineIndex.unpacked(arrays.column("arrays")[0].as_py())
        said = [np.packbits(index.are_common(np.frombuffer(x, _KEY), min_docs)).tobytes() for x in probes.column("packed").to_pylist()]
        return pa.table({"at_bucket": probes.column("from_bucket"), "at_shard": probes.column("shard"), "said": pa.array(said, pa.binary())})

    published = dealt.rows.groupBy("bucket").applyInArrow(send, "shard long, packed binary").groupBy("shard").applyInArrow(build, "of_shard long, arrays binary")
    probes = dealt.rows.groupBy("bucket").applyInArrow(probe, "shard long, from_bucket long, packed binary")
    answers = probes.groupBy("shard").cogroup(published.groupBy("of_shard")).applyInArrow(lambda p, a: look_up(p, a), "at_bucket long, at_shard long, said binary")

    def apply(docs: pa.Table, said: pa.Table) -> pa.Table:
        entries, cuts = entries_of(docs)
        hit = entries[read_bitmaps(said, [(s, c.stop - c.start) for s, c in cuts])]
        packed = in_full(hit).tobytes()
        common = {packed[i : i + 16] for i in range(0, len(packed), 16)}
        n_lines, n_dropped, kept = [], [], []
        for text in docs.column("text").to_pylist():
            lines, keys = line_keys(text)
            stay = [x for x, k in zip(lines, keys, strict=True) if k not in common] if common else lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode("utf-8", "surrogatepass") if len(stay) < len(lines) else text)
        out = {"id": docs.column("id"), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "text": pa.array(kept, pa.string())}
        return pa.table(out | ({"rest": docs.column("rest")} if carry else {}))

    fields = [StructField("id", df.schema[id_col].dataType), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType())]
    schema = StructType(fields + ([StructField("rest", dealt.rows.schema["rest"].dataType)] if carry else []))
    out = with_answers(dealt, answers, apply, schema)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("text").alias(text_col), *[F.col("rest")[c].alias(c) for c in carry])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, without lines found in at least 10 documents."""
    rows = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, rn, i, line, lower_key AS key FROM (
    SELECT doc_id, rn, unnest(parts) AS line, generate_subscripts(parts, 1) AS i,
           translate(regexp_replace(regexp_replace(unnest(parts), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT rn) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY rn, doc_id"""
}
