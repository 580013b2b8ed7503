"""Media columns: content-addressed payloads in tar shards.

Each text becomes a payload of whole rows of 64 bytes, stored as an 8-bit greyscale PNG, 64 samples wide. Tasks append
the PNGs that they haven't stored yet to tar files in the shared folder; a member's name is the digest of its payload.
Rows carry digest, shard, offset and length. Of the places that a digest got from several tasks, the least is used, so
equal payloads have equal rows. Header-only range reads (33 bytes each) fill the metadata columns; a read of the whole
member gives the payload back and its features.

A task that is repeated writes a file of its own, and only the rows of the attempt that counted name it, so lost
executors do no harm; the manifest is cut before it is used. Null texts count as empty; an empty text is one row of
zeros; a very long text is one payload, made and read back whole by one task. Repeated rows share a payload. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipper.llm.common import blocks, cut, parallelism, shared_dir, text_column

WIDTH = 64
#: A task begins another tar file beyond this size.
SHARD_BYTES = 128 << 20
#: A task of the reading side reads so much on average, where there is enough.
TASK_BYTES = 128 << 20
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0: samples as they are
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict[str, int]:
    """Metadata from the first HEADER_BYTES of a PNG."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def read_png(data: bytes) -> bytes:
    """The samples of a PNG that ``write_png`` could have written."""
    meta = read_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def _open_store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class TarWriter:
    """Appends members to tar files in a folder; says where each lies."""

    def __init__(self, root: str):
        self.store, self.path = _open_store(root)
        self.stream, self.name, self.at, self.files = None, "", 0, 0
        self.prefix = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex[:8]}"

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"{self.prefix}-{self.files}.tar", 0
            self.files += 1
            self.stream = self.store.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head + data + bytes(-len(data) % 512))
        place = (self.name, self.at + len(head), len(data))
        self.at += len(head) + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream = None


def store_payloads(df: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, places): (the id, ``n_bytes``, ``digest``) of each row, and (digest, ``shard``, ``offset``, ``length``) once a payload.

    A digest is the SHA-256 of the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, seen = TarWriter(root), set()
        names = ["id", "n_bytes", "digest", "shard", "offset", "length"]
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        for b in blocks(batches, "text"):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text in text_column(b, "text").cast(pa.large_binary()).to_pylist():
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                place: tuple = (None, None, None)
                if digest not in seen:
                    seen.add(digest)
                    place = writer.add(digest.hex(), write_png(payload))
                for c, v in zip(rows, (len(text), digest, *place), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=names)
        writer.close()

    store, path = _open_store(root)
    store.create_dir(path, recursive=True)
    kind = df.schema[id_col].dataType.simpleString()
    rows = cut(df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, n_bytes long, digest binary, shard string, offset long, length long"))
    places = rows.where("shard is not null").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "digest"), places


_META = {"width": "int", "height": "int", "bit_depth": "int", "colour_type": "int"}
_BODY = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def read_media(places: DataFrame, root: str, body: bool = False) -> DataFrame:
    """``places`` with metadata columns from range reads of headers and, if asked for, what a read of the payload gives.

    Members are read in the order of their shard, a few MB of a shard a task.
    """
    columns = _META | (_BODY if body else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open_store(root)
        name, file = None, None
        for b in batches:
            out: dict[str, list] = {k: [] for k in columns}
            for shard, offset, length in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{path}/{shard}")
                found: dict = read_header(file.read_at(HEADER_BYTES, offset))
                if body:
                    media = file.read_at(length, offset)
                    payload = read_png(media)
                    samples = np.frombuffer(payload, np.uint8)
                    found |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
                    found["feature"] = f"{found['width']}x{found['height']}x{found['bit_depth']};sum={int(samples.sum(dtype=np.int64))};distinct={int((np.bincount(samples, minlength=256) > 0).sum())};zeros={int((samples == 0).sum())}"
                for k, v in out.items():
                    v.append(found[k])
            arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, arrow[columns[k]]) for k, v in out.items())], names=[*b.schema.names, *out])
        if file is not None:
            file.close()

    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(4 * parallelism(places.sparkSession), total // TASK_BYTES)
    dealt = places.select("digest", "shard", "offset", "length").repartition(parts, "shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(run, "digest binary, shard string, offset long, length long, " + ", ".join(f"{k} {t}" for k, t in columns.items()))


def media_columns(df: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", body: bool = False) -> DataFrame:
    """One row per row: the id, ``n_bytes``, and the columns of ``read_media`` for its payload."""
    rows, places = store_payloads(df, root, id_col, text_col)
    return rows.join(read_media(places, root, body), "digest")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, stored as media and read back."""
    root = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    rows = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, body=True)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op4_media_columns": op4_media_columns}
