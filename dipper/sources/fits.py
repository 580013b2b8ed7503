"""FITS files as a Spark data source: ``spark.read.format("fits").load(path)``.

Reads the first binary table that has a time and a flux column, of each file that a path or glob names, as (path,
target, t, flux, quality), or with option ``mode`` = ``headers`` as (path, hdu, cards). Only the columns of the schema asked
for are decoded, filters are applied where rows are read, and large tables are split by rows and read by ranges. ``.gz`` files are unpacked. Rows whose time or flux isn't finite are left out unless ``keepNan`` is true.
Options ``hdu`` (its number), ``time``, ``flux`` and ``flags`` (column names) pick others than the usual ones.
Files are listed and read by the Hadoop client through ``binaryFile`` in ``read_fits``, which is the way for remote
stores; the format itself lists local or mounted paths, and gives Arrow batches. It writes with a commit: files get
their names when all tasks have ended. As a stream it takes each file that lands once.
``write_fits`` writes light curves, and ``write_frames`` pixels, from tasks.
"""

from __future__ import annotations

import glob
import gzip
import json
import math
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField, StructType

from dipper.sources.store import write_file

BLOCK, CARD = 2880, 80
#: File endings that an upload may have, in any case.
ENDINGS = (".fits", ".fits.gz", ".fit", ".fts")
#: The same for listings.
ENDINGS_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in ENDINGS) + "}"
#: Names that the columns may have, in order of preference.
TIME_NAMES = ("TIME", "BARYTIME", "BJD")
FLUX_NAMES = ("PDCSAP_FLUX", "SAP_FLUX", "FLUX", "DETRENDED_FLUX")
QUALITY_NAMES = ("QUALITY", "SAP_QUALITY")
#: NumPy types of the format letters.
_TYPES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16", "P": ">i8", "Q": ">i8"}
LC_SCHEMA = "path string, target string, t double, flux double, quality int"
HEADER_SCHEMA = "path string, hdu int, cards map<string,string>"


def padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def _value(raw: str) -> str:
    """The value of a card, without the comment and quotes; doubled quotes are one."""
    raw = raw.strip()
    if raw.startswith("'"):
        end = 1
        while (end := raw.find("'", end)) >= 0 and raw[end : end + 2] == "''":
            end += 2
        return raw[1 : end if end > 0 else None].replace("''", "'").rstrip()
    return raw.partition("/")[0].strip()


def read_header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The cards of the header at an offset, and where its data begin."""
    cards: dict[str, str] = {}
    while at < len(data):
        block = data[at : at + BLOCK]
        at += BLOCK
        for i in range(0, len(block), CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                cards[key] = _value(card[10:])
    raise ValueError("a FITS header without END")


def data_bytes(cards: dict[str, str]) -> int:
    """Bytes of an HDU's data before padding, with the heap behind a table."""
    n = int(cards.get("NAXIS", 0))
    if not n:
        return 0
    size = math.prod(int(cards[f"NAXIS{i}"]) for i in range(1, n + 1))
    return abs(int(cards["BITPIX"])) // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + size)


def hdus(data: bytes) -> Iterator[tuple[dict[str, str], int]]:
    at = 0
    while at < len(data):
        cards, start = read_header(data, at)
        yield cards, start
        at = start + padded(data_bytes(cards))


def table_dtype(cards: dict[str, str]) -> np.dtype:
    """The row layout of a binary table. X counts bits; P and Q are descriptors."""
    names, kinds = [], []
    for i in range(1, int(cards["TFIELDS"]) + 1):
        form = cards[f"TFORM{i}"].strip()
        digits = len(form) - len(form.lstrip("0123456789"))
        count, letter = int(form[:digits] or 1), form[digits]
        name = cards.get(f"TTYPE{i}", f"COL{i}").strip().upper()
        names.append(name if name not in names else f"{name}_{i}")
        if letter == "A":
            kinds.append(f"S{count}")
        elif letter == "X":
            kinds.append(("u1", (-(-count // 8),)))
        elif letter in "PQ":
            kinds.append((">i4" if letter == "P" else ">i8", (2 * count,)))
        elif letter in _TYPES:
            kinds.append(_TYPES[letter] if count == 1 else (_TYPES[letter], (count,)))
        else:
            raise ValueError(f"unknown column format {form}")
    return np.dtype([(n, *(k if isinstance(k, tuple) else (k,))) for n, k in zip(names, kinds, strict=True)])


def _column(rows: np.ndarray, cards: dict[str, str], name: str) -> np.ndarray:
    """A column as doubles, scaled; the first element of vector cells."""
    x = rows[name]
    if x.ndim > 1:
        x = x[:, 0] if x.shape[1] else np.full(len(x), np.nan)
    at = next(i for i in range(1, int(cards["TFIELDS"]) + 1) if cards.get(f"TTYPE{i}", f"COL{i}").strip().upper() == name)
    out = x.astype(float)
    if f"TNULL{at}" in cards:
        out[x == int(cards[f"TNULL{at}"])] = np.nan
    return out * float(cards.get(f"TSCAL{at}", 1)) + float(cards.get(f"TZERO{at}", 0))


def _flags(rows: np.ndarray, name: str | None) -> np.ndarray:
    """Quality flags, kept within 32 bits; zeros where a table has none."""
    return rows[name].astype(np.int64).clip(-(1 << 31), (1 << 31) - 1).astype(np.int32) if name else np.zeros(len(rows), np.int32)


def target_of(cards: dict[str, str], path: str) -> str:
    """The catalogue number, else the object's name without its prefix, else the file's name."""
    return cards.get("TICID") or cards.get("OBJECT", "").replace("TIC ", "") or path.rsplit("/", 1)[-1]


def accepted(name: str) -> bool:
    return name.lower().endswith(ENDINGS)


def light_curve(data: bytes, path: str, keep_nan: bool = False, hdu: int | None = None, **names: str) -> pd.DataFrame:
    """LC_SCHEMA rows of one file; none if no table has time and flux. ``names``: columns for ``time``, ``flux``, ``flags``."""
    empty = pd.DataFrame({"path": [], "target": [], "t": [], "flux": [], "quality": []})
    if path.endswith(".gz") or data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    primary: dict[str, str] = {}
    for number, (cards, start) in enumerate(hdus(data)):
        primary = primary or cards
        if cards.get("XTENSION") != "BINTABLE" or (hdu is not None and number != hdu):
            continue
        kind = table_dtype(cards)
        pick = lambda names: next((n for n in names if n in kind.names), None)  # noqa: E731, B023
        usual = {"time": TIME_NAMES, "flux": FLUX_NAMES, "flags": QUALITY_NAMES}
        time, flux, flag = (pick((names[k].upper(),) if k in names else known) for k, known in usual.items())
        if not time or not flux:
            continue
        rows = np.frombuffer(data, kind, int(cards["NAXIS2"]), start)
        t, f = _column(rows, cards, time), _column(rows, cards, flux)
        q = _flags(rows, flag)
        ok = np.ones(len(t), bool) if keep_nan else np.isfinite(t) & np.isfinite(f)
        return pd.DataFrame({"path": path, "target": target_of(primary | cards, path), "t": t[ok], "flux": f[ok], "quality": q[ok]})
    return empty


#: Rows that a task gives back at once, and points of a file that it writes.
ROWS, POINTS = 50_000, 100_000


def _decoded(files: DataFrame, decode: Callable[[bytes, str], pd.DataFrame], schema: str) -> DataFrame:
    """What ``decode`` gives for each row of (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = decode(content, name)
                for first in range(0, max(len(rows), 1), ROWS):
                    yield rows.iloc[first : first + ROWS]

    return files.select("path", "content").mapInPandas(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", ENDINGS_GLOB).load(path)


def read_fits(spark: SparkSession, path: str, keep_nan: bool = False, **options: object) -> DataFrame:
    """LC_SCHEMA rows of all FITS files in a folder (or of one file), from any store that Spark reads."""
    return _decoded(_files(spark, path), lambda data, name: light_curve(data, name, keep_nan, **options), LC_SCHEMA)


def stream_fits(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of LC_SCHEMA rows of the FITS files that land in a folder; other files are passed over."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("pathGlobFilter", ENDINGS_GLOB).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return _decoded(files, light_curve, LC_SCHEMA)


def _header_rows(data: bytes, path: str) -> pd.DataFrame:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    return pd.DataFrame([(path, i, cards) for i, (cards, _) in enumerate(hdus(data))], columns=["path", "hdu", "cards"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADER_SCHEMA rows of all FITS files in a folder, or of one: the cards of each HDU."""
    return _decoded(_files(spark, path), _header_rows, HEADER_SCHEMA)


def pixel_frames(data: bytes, path: str) -> pd.DataFrame:
    """FRAME_SCHEMA rows of one target pixel file: a frame a cadence, from the first table whose FLUX cells are images."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    primary: dict[str, str] = {}
    for cards, start in hdus(data):
        primary = primary or cards
        if cards.get("XTENSION") != "BINTABLE":
            continue
        kind = table_dtype(cards)
        time = next((n for n in TIME_NAMES if n in kind.names), None)
        if time is None or "FLUX" not in kind.names or not kind["FLUX"].shape:
            continue
        at = next(i for i in range(1, int(cards["TFIELDS"]) + 1) if cards.get(f"TTYPE{i}", "").strip().upper() == "FLUX")
        count = kind["FLUX"].shape[0]
        # TDIM names the fastest axis, the columns, first
        width, height = map(int, cards.get(f"TDIM{at}", f"({count},1)").strip("() ").split(","))
        rows = np.frombuffer(data, kind, int(cards["NAXIS2"]), start)
        frames = rows["FLUX"].astype(np.float32).reshape(len(rows), height, width)
        flag = next((n for n in QUALITY_NAMES if n in kind.names), None)
        quality = rows[flag].astype(np.int32) if flag else np.zeros(len(rows), np.int32)
        return pd.DataFrame({"path": path, "target": target_of(primary | cards, path), "cadence": np.arange(len(rows)), "t": _column(rows, cards, time), "quality": quality, "flux": [list(map(list, f)) for f in frames]})
    return pd.DataFrame({"path": [], "target": [], "cadence": [], "t": [], "quality": [], "flux": []})


FRAME_SCHEMA = "path string, target string, cadence long, t double, quality int, flux array<array<float>>"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAME_SCHEMA rows of all target pixel files in a folder, or of one; NaN pixels stay NaN."""
    return _decoded(_files(spark, path), pixel_frames, FRAME_SCHEMA)


#: Bytes of table rows in one partition of the format, and in one read.
SPLIT_BYTES, READ_BYTES = 64 << 20, 16 << 20


def _place(path: str) -> tuple[fs.FileSystem, str, str]:
    """(store, path in it, what stood before it): of any store that Arrow knows; plain paths are local."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    store, name = fs.FileSystem.from_uri(path)
    return store, name, path.removesuffix(name) if path.endswith(name) else ""


def open_file(path: str) -> pa.NativeFile:
    """A file for reads of ranges."""
    store, name, _ = _place(path)
    return store.open_input_file(name)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the FITS files that a folder, a file or, locally, a glob names."""
    store, name, scheme = _place(path)
    if any(c in name for c in "*?["):
        found = store.get_file_info(sorted(glob.glob(name)))
    elif (one := store.get_file_info(name)).type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(name))
    else:
        found = [one]
    if missing := [f.path for f in found if f.type == fs.FileType.NotFound]:
        raise FileNotFoundError(missing[0])
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and accepted(f.path) and not f.base_name.startswith("_"))


def find_table(file: pa.NativeFile, hdu: int | None = None, names: dict[str, str] | None = None) -> tuple[dict[str, str], dict[str, str], int, dict[str, str | None]] | None:
    """(primary cards, cards, offset of the rows, columns) of the first table with time and flux; reads headers alone."""
    at, number, size, primary = 0, 0, file.size(), {}
    while at < size:
        raw = b""
        while True:  # block after block, until the header's END
            block = file.read_at(BLOCK, at + len(raw))
            raw += block
            if not block or any(block[i : i + 8].strip() == b"END" for i in range(0, len(block), CARD)):
                break
        cards, start = read_header(raw, 0)
        primary = primary or cards
        if cards.get("XTENSION") == "BINTABLE" and hdu in (None, number):
            kind = table_dtype(cards)
            columns = {k: next((n for n in ((names[k].upper(),) if k in (names or {}) else known) if n in kind.names), None) for k, known in _USUAL.items()}
            if columns["time"] and columns["flux"]:
                return primary, cards, at + start, columns
        at, number = at + start + padded(data_bytes(cards)), number + 1
    return None


class _Split(InputPartition):
    """Row ranges of files: (path, first row, row after the last or None for all)."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        self.ranges = ranges


_COMPARE = {"EqualTo": np.equal, "GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal, "LessThan": np.less, "LessThanOrEqual": np.less_equal}
_USUAL = {"time": TIME_NAMES, "flux": FLUX_NAMES, "flags": QUALITY_NAMES}


class _Reader(DataSourceReader):
    """Takes columns from the schema asked for, and filters on any of them; splits large tables by rows and puts small files together."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.headers = options.get("mode") == "headers"
        self.keep_nan = options.get("keepnan", "false").lower() == "true"
        self.hdu = int(options["hdu"]) if "hdu" in options else None
        self.names = {k: options[k] for k in ("time", "flux", "flags") if k in options}
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of one column with a value; Spark applies what is given back."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kind = type(f).__name__
            number = column == "quality" or (column in ("t", "flux") and not self.keep_nan)  # Spark's NaN exceed all numbers, NumPy's none
            if self.headers or column is None:
                yield f
            elif kind == "IsNotNull" and column in ("path", "target", "t", "flux", "quality"):
                continue
            elif (kind in _COMPARE and number or kind == "EqualTo" and column in ("path", "target")) and f.value is not None:
                self.pushed.append((column, kind, f.value))
            elif kind == "In" and (number or column in ("path", "target")) and None not in f.value:
                self.pushed.append((column, kind, tuple(f.value)))
            else:
                yield f

    def _passes(self, column: str, value: str) -> bool:
        return all(value in x if kind == "In" else value == x for c, kind, x in self.pushed if c == column)

    def partitions(self) -> list[InputPartition]:
        return self.splits(list_files(self.options["path"]))

    def splits(self, files: list[tuple[str, int]]) -> list[InputPartition]:
        size = int(self.options.get("splitbytes", SPLIT_BYTES))
        splits: list[InputPartition] = []
        small: list[tuple[str, int, int | None]] = []
        held = 0
        for p, n in files:
            if not self._passes("path", p):
                continue
            table = None
            if n > size and not self.headers and not p.lower().endswith(".gz"):
                with open_file(p) as file:
                    table = find_table(file, self.hdu, self.names)
            if table:
                rows, step = int(table[1]["NAXIS2"]), max(1, size // max(1, int(table[1]["NAXIS1"])))
                splits += [_Split([(p, i, min(i + step, rows))]) for i in range(0, rows, step)]
                continue
            small.append((p, 0, None))
            held += n
            if held >= size:
                splits.append(_Split(small))
                small, held = [], 0
        return splits + ([_Split(small)] if small else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, first, stop in partition.ranges if partition else ():  # Spark asks for none where there are none
            if self.headers:
                with open_file(path) as f:
                    rows = _header_rows(f.read(), path)
                every = {"path": pa.array(rows["path"], pa.string()), "hdu": pa.array(rows["hdu"], pa.int32()), "cards": pa.array([list(c.items()) for c in rows["cards"]], pa.map_(pa.string(), pa.string()))}
                yield pa.RecordBatch.from_arrays([every[c] for c in self.columns], names=self.columns)
            else:
                yield from self._rows(path, first, stop)

    def _rows(self, path: str, first: int, stop: int | None) -> Iterator[pa.RecordBatch]:
        with open_file(path) as raw:
            file = raw
            if path.lower().endswith(".gz") or raw.read_at(2, 0) == b"\x1f\x8b":
                file = pa.BufferReader(gzip.decompress(raw.read()))
            table = find_table(file, self.hdu, self.names)
            if table is None:
                return
            primary, cards, start, names = table
            target = target_of(primary | cards, path)
            if not self._passes("target", target):
                return
            kind, stop = table_dtype(cards), int(cards["NAXIS2"]) if stop is None else stop
            step = max(1, READ_BYTES // max(1, kind.itemsize))
            needed = {*self.columns, *(c for c, _, _ in self.pushed)} | ({"t", "flux"} if not self.keep_nan else set())
            for a in range(first, stop, step):
                n = min(step, stop - a)
                rows = np.frombuffer(file.read_at(n * kind.itemsize, start + a * kind.itemsize), kind, n)
                values: dict[str, np.ndarray] = {}
                for c, name in (("t", names["time"]), ("flux", names["flux"])):
                    if c in needed:
                        values[c] = _column(rows, cards, name)
                if "quality" in needed:
                    values["quality"] = _flags(rows, names["flags"])
                ok = np.ones(n, bool) if self.keep_nan else np.isfinite(values["t"]) & np.isfinite(values["flux"])
                for c, what, x in self.pushed:
                    if c in values:
                        ok &= np.isin(values[c], x) if what == "In" else _COMPARE[what](values[c], x)
                left = int(ok.sum())
                if left:
                    every = {c: pa.array(v[ok]) for c, v in values.items()} | {c: pa.array([v] * left, pa.string()) for c, v in (("path", path), ("target", target)) if c in needed}
                    yield pa.RecordBatch.from_arrays([every[c] for c in self.columns], names=self.columns)


class _Stream(DataSourceStreamReader):
    """Files that land, each once. An offset is a number of entries of a log, which holds the files that each entry adds.

    An entry is there before its number is told, so a query that starts again finds the files of its last batch. Files
    are known by name: times of change and order don't matter, and a name that is written anew isn't read again.
    """

    def __init__(self, reader: _Reader):
        if "log" not in reader.options:
            raise ValueError("a stream of FITS files needs option log, a folder of its own in a shared store")
        self.reader, self.most = reader, int(reader.options.get("maxfiles", 1000))
        self.seen: set[str] = set()
        self.known = 0  # entries whose files are in ``seen``

    def _entries(self) -> list[str]:
        store, folder, scheme = _place(self.reader.options["log"])
        store.create_dir(folder, recursive=True)
        return sorted(scheme + f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".json"))

    @staticmethod
    def _files(entry: str) -> list[tuple[str, int]]:
        with open_file(entry) as f:
            return [(p, n) for p, n in json.loads(f.read())]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        entries = self._entries()
        self.seen.update(p for e in entries[self.known :] for p, _ in self._files(e))
        self.known = len(entries)
        new = [f for f in list_files(self.reader.options["path"]) if f[0] not in self.seen]
        store, folder, _ = _place(self.reader.options["log"])
        for k in range(0, len(new), self.most):
            name = f"{folder}/{len(entries) + k // self.most:09d}"
            with store.open_output_stream(f"{name}.tmp", compression=None) as f:
                f.write(json.dumps(new[k : k + self.most]).encode())
            store.move(f"{name}.tmp", f"{name}.json")
        return {"entries": len(entries) + -(-len(new) // self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [s for e in self._entries()[start["entries"] : end["entries"]] for s in self.reader.splits(self._files(e))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Each task writes files under names of its own; the driver gives them their final names when all tasks have ended."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.points = options["path"], int(options.get("points", 500_000))
        self.ending, self.overwrite = options.get("ending", ".fits"), overwrite
        self.names = tuple(options.get(k, usual) for k, usual in (("time", "TIME"), ("flux", "FLUX"), ("flags", "QUALITY")))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder, _ = _place(self.folder)
        store.create_dir(folder, recursive=True)
        held: dict[str | None, list[pd.DataFrame]] = {}
        names: list[str] = []

        def flush(target: str | None) -> None:
            part = pd.concat(held.pop(target)).sort_values(["t", "flux"])
            data = curve_file(target, part, self.names)
            names.append(f"{quote(str(target), '')}-{uuid.uuid4().hex}{self.ending}")
            with store.open_output_stream(f"{folder}/_{names[-1]}", compression=None) as f:
                f.write(gzip.compress(data) if self.ending.endswith(".gz") else data)

        for b in iterator:
            rows = b.to_pandas()
            for target, part in rows.groupby("target", dropna=False, sort=False):
                own = None if pd.isna(target) else target
                at = 0
                while at < len(part):  # no file holds more, whatever a batch brings
                    room = self.points - sum(map(len, held.setdefault(own, [])))
                    held[own].append(part.iloc[at : at + room])
                    at += room
                    if at <= len(part):
                        flush(own)
            while sum(len(p) for parts in held.values() for p in parts) >= 4 * self.points:  # many targets share a bound
                flush(max(held, key=lambda x: sum(map(len, held[x]))))
        for target in list(held):
            flush(target)
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder, _ = _place(self.folder)
        if self.overwrite:
            for path, _ in list_files(self.folder):
                store.delete_file(_place(path)[1])
        for n in (n for m in messages if m for n in m.names):
            store.move(f"{folder}/_{n}", f"{folder}/{n}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder, _ = _place(self.folder)
        for n in (n for m in messages if m for n in m.names):
            store.delete_file(f"{folder}/_{n}")


class FitsSource(DataSource):
    """``register(spark)`` makes the format known, for reads and writes.

    A schema of some of the columns, as in ``.schema("t double, flux double")``, decodes these alone. Reads take filters,
    split tables beyond option ``splitBytes`` and put small files together. Writes (``append`` or ``overwrite``) take
    (target, t, flux, quality) rows, at most ``points`` of them a file; ``time``, ``flux`` and ``flags`` name their columns.
    Streams (``readStream``) take files as they land; option ``log`` names the folder that says which were taken, in
    entries of at most ``maxFiles``. They take no filters from Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("mode") == "headers" else LC_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        known = {f.name: f.dataType for f in _parsed(self.schema()).fields}
        for f in schema.fields:
            if known.get(f.name) != f.dataType:
                raise ValueError(f"the format has no column {f.name} of type {f.dataType.simpleString()}")
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.reader(schema))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def _parsed(ddl: str) -> StructType:
    kinds = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "map<string,string>": MapType(StringType(), StringType())}
    return StructType([StructField(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in ddl.split(", "))])


def register(spark: SparkSession) -> None:
    """Makes the format ``fits`` known, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsSource)


def _card(key: str, value: object) -> bytes:
    text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) else ("T" if value else "F").rjust(20) if isinstance(value, bool) else str(value).rjust(20)
    return f"{key:<8}= {text}".ljust(CARD).encode("ascii")


def _header(cards: list[tuple[str, object]]) -> bytes:
    out = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(CARD)
    return out.ljust(padded(len(out)), b" ")


def write_table(columns: list[tuple[str, str, np.ndarray]], primary: dict[str, object]) -> bytes:
    """A FITS file with one binary table; (name, format letter, values) for each column. Images are stored row by row."""
    kind = np.dtype([(n, _TYPES[f], v.shape[1:] and (int(np.prod(v.shape[1:])),)) for n, f, v in columns])
    rows = np.zeros(len(columns[0][2]), kind)
    for n, _, v in columns:
        rows[n] = v.reshape(rows[n].shape)
    head = _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), *primary.items()])
    fields: list[tuple[str, object]] = []
    for i, (n, f, v) in enumerate(columns, 1):
        fields += [(f"TTYPE{i}", n), (f"TFORM{i}", f"{int(np.prod(v.shape[1:]))}{f}")]
        fields += [(f"TDIM{i}", f"({v.shape[2]},{v.shape[1]})")] if v.ndim == 3 else []
    table = _header([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", kind.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), *fields])
    data = rows.tobytes()
    return head + table + data.ljust(padded(len(data)), b"\0")


def curve_file(target: str | None, part: pd.DataFrame, names: tuple[str, ...] = ("TIME", "FLUX", "QUALITY")) -> bytes:
    """A file of one target's points, with some names for its columns."""
    columns = [(names[0], "D", part["t"].to_numpy(float)), (names[1], "D", part["flux"].to_numpy(float)), (names[2], "J", part["quality"].to_numpy(np.int32))]
    return write_table(columns, {} if target is None else {"OBJECT": f"TIC {target}"})


def write_fits(lc: DataFrame, folder: str, ending: str = ".fits", points: int = POINTS) -> None:
    """Writes light curves as FITS files of at most about ``points`` rows each, from tasks; no task holds more of a target."""
    from dipper.operators.lightcurve import with_target_stats

    rows = with_target_stats(lc.select("target", "t", "flux", "quality"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("t", "flux"), F.ceil(F.col("n") / points)).cast("int")).drop("n")

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "flux"])
        data = curve_file(key[0], part)
        write_file(folder, f"{quote(str(key[0]), '')}-{key[1]}{ending}", gzip.compress(data) if ending.endswith(".gz") else data)
        return pd.DataFrame({"rows": [len(part)]})

    rows.groupBy("target", "part").applyInPandas(one, "rows long").agg(F.sum("rows")).collect()


def write_frames(pixels: DataFrame, folder: str, cadences: int = 1000) -> None:
    """Writes (target, cadence, row, col, px) as target pixel files of ``cadences`` frames at most; the time is the cadence."""
    rows = pixels.withColumn("part", F.floor(F.col("cadence") / cadences).cast("long"))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, frame = np.unique(part["cadence"], return_inverse=True)
        cube = np.full((len(at), int(part["row"].max()) + 1, int(part["col"].max()) + 1), np.nan)
        cube[frame, part["row"], part["col"]] = part["px"]
        data = write_table([("TIME", "D", at.astype(float)), ("FLUX", "E", cube), ("QUALITY", "J", np.zeros(len(at), np.int32))], {"TICID": str(key[0])})
        write_file(folder, f"{quote(str(key[0]), '')}-{key[1]}.fits", data)
        return pd.DataFrame({"rows": [len(part)]})

    rows.groupBy("target", "part").applyInPandas(one, "rows long").agg(F.sum("rows")).collect()
