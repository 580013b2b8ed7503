"""Vector code compression: product quantization by Lloyd's rounds with Elkan's bounds.

Vectors become integers, floor(scale * x), and are cut into ``parts`` equal consecutive parts. Each part position has a
codebook of at most ``entries`` entries, at first that part of the rows with the smallest ids. A round assigns every part
to its nearest entry and replaces each entry by the floored mean of its parts; after the last, parts are assigned again.

Rows carry their state from round to round in a table in the shared folder: for each part the entry, an upper bound of
the distance to it, and one lower bound for each entry. When entries move, bounds are shifted by how far. An entry is
passed over if its lower bound, or half its distance from the row's own entry, is strictly above the upper bound;
what is left is compared by exact integer squared distances, ties to the lower index, so results are those of a search
through all entries. Lower bounds are whole numbers rounded down (16 bits, so 2 KB a row of 16 parts and 64 entries),
upper bounds doubles with a margin: rounding only weakens a bound.

All that meets on the driver are sums and counts of entries, ``entries`` times the length of a vector, whatever the data;
they are sums of each task's sums. Rows are never dealt by id.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors count as filled up with
zeros to the longest length, and that to a multiple of ``parts``. Scaled components beyond +-2^26 count as that, so that
sums fit 64 bits. Rows of one id are rows each; among the first entries they go by their integers; null ids come last.
With fewer rows than entries, there are as many entries as rows. An empty table gives no rows. Columns other than the
id, the vector and the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipper.llm.common import cut
from dipper.sources.store import new_folder, remove

#: Scaled components beyond this count as this.
LARGEST = 1 << 26
#: A label with more rows than one in this many is joined by a broadcast of such labels, of which there are fewer.
HOT_SHARE = 1000
#: Rows that the kernel handles at a time.
BLOCK_ROWS = 4096
_LOW = 65535


def integers(df: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """Rows with a finite vector, and the column ``v`` of its integers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    scaled = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int")
    return df.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, bad)).withColumn("v", F.transform(vector_col, scaled))


class Codebooks:
    """The entries of all part positions: integers of shape (parts, entries, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts, self.size, self.width = entries.shape
        gaps = entries[:, :, None, :] - entries[:, None, :, :]
        #: Half the distance between two entries of a part, rounded down a little.
        self.half = np.sqrt((gaps.astype(np.float64) ** 2).sum(-1)) * (0.5 * (1 - 1e-12))

    def moved(self, other: Codebooks) -> np.ndarray:
        """How far each entry has moved from another state, rounded up a little."""
        return np.sqrt(((self.entries - other.entries).astype(np.float64) ** 2).sum(-1)) * (1 + 1e-12)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(books: Codebooks, v: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, int]:
    """Brings codes and bounds of rows up to date, in place: (squared distance of each part, how many distances were computed).

    ``v``: (rows, parts, width); ``code`` and ``upper``: (rows, parts); ``lower``: (rows, parts, entries). Where a row's
    upper bound rules out all other entries, not even its own distance is computed, unless ``exact`` ones are asked for.
    """
    squares = np.zeros(code.shape, np.int64)
    done = 0
    for p in range(books.parts):
        mine, up, low, half, entries = code[:, p], upper[:, p], lower[:, p], books.half[p], books.entries[p]

        def unsettled(at: np.ndarray, mine: np.ndarray = mine, up: np.ndarray = up, low: np.ndarray = low, half: np.ndarray = half) -> np.ndarray:
            pairs = (low[at] <= up[at, None]) & (half[mine[at]] <= up[at, None])
            pairs[np.arange(len(at)), mine[at]] = False
            return pairs

        every = np.arange(len(mine))
        todo = every[unsettled(every).any(1)]
        own = every if exact else todo
        best = squares[:, p]
        best[own] = ((v[own, p] - entries[mine[own]]) ** 2).sum(1)
        done += len(own)
        distance = np.sqrt(best[own].astype(np.float64))
        up[own] = distance * (1 + 1e-12)
        low[own, mine[own]] = np.minimum(distance * (1 - 1e-12), _LOW)
        pairs = unsettled(todo)
        for j in np.flatnonzero(pairs.any(0)).tolist():
            at = todo[pairs[:, j]]
            at = at[(half[mine[at], j] <= up[at]) & (mine[at] != j)]  # entries found since then may rule it out
            d = ((v[at, p] - entries[j]) ** 2).sum(1)
            done += len(at)
            root = np.sqrt(d.astype(np.float64))
            low[at, j] = np.minimum(root * (1 - 1e-12), _LOW)
            better = (d < best[at]) | ((d == best[at]) & (j < mine[at]))
            won = at[better]
            best[won], mine[won], up[won] = d[better], j, root[better] * (1 + 1e-12)
    return squares, done


def shift(upper: np.ndarray, lower: np.ndarray, code: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after entries have moved: (upper, lower)."""
    up = upper + moved[np.arange(len(moved))[None, :], code]
    low = np.floor(np.maximum(lower - moved[None], 0)).astype(np.uint16)
    return up, low


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    off = column.offsets.to_numpy().astype(np.int64)
    length = np.diff(off)
    out = np.zeros((len(length), dims), np.int64)
    out[np.repeat(np.arange(len(length)), length), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], length)] = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return out


def _packed(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _assigned(rows: DataFrame, books: Codebooks, before: Codebooks | None, dims: int, last: bool) -> DataFrame:
    """``rows`` with codes, and bounds or, at the last time, errors; ``before``: the entries that their bounds are of."""
    moved = books.moved(before) if before else None
    shape = (books.parts, books.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                v = _matrix(b.column(2), dims).reshape(b.num_rows, books.parts, books.width)
                if moved is None:
                    code, upper, lower = np.zeros((b.num_rows, books.parts), np.int64), np.full((b.num_rows, books.parts), np.inf), np.zeros((b.num_rows, *shape), np.uint16)
                else:
                    code = _packed(b.column(3), np.uint8, shape[:1]).astype(np.int64)
                    upper, lower = shift(_packed(b.column(4), np.float64, shape[:1]), _packed(b.column(5), np.uint16, shape), code, moved)
                squares, _ = assign(books, v, code, upper, lower, last)
                names = ["id", "label", "v", "code", *(["error"] if last else ["upper", "lower"])]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], _rows(code.astype(np.uint8)), *([pa.array(squares.sum(1), pa.int64())] if last else [_rows(upper), _rows(lower)])], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<int>, code binary, " + ("error long" if last else "upper binary, lower binary")
    return rows.mapInArrow(run, schema)


def _sums(assigned: DataFrame, books: Codebooks, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the parts of each entry: each task's sums, added up."""
    width = books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((books.parts, books.size), np.int64)
        total = np.zeros((books.parts, books.size, width), np.int64)
        for b in batches:
            v = _matrix(b.column(0), dims).reshape(b.num_rows, books.parts, width)
            code = _packed(b.column(1), np.uint8, (books.parts,)).astype(np.int64)
            for p in range(books.parts):
                count[p] += np.bincount(code[:, p], minlength=books.size)
                np.add.at(total[p], code[:, p], v[:, p])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count.ravel()[at], pa.int64()), *(pa.array(total[..., i].ravel()[at], pa.int64()) for i in range(width))], names=["at", "n", *(f"s{i}" for i in range(width))])

    columns = [f"s{i}" for i in range(width)]
    found = assigned.select("v", "code").mapInArrow(run, "at long, n long, " + ", ".join(f"{c} long" for c in columns))
    count, total = np.zeros(books.parts * books.size, np.int64), np.zeros((books.parts * books.size, width), np.int64)
    for r in found.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect():
        count[r["at"]], total[r["at"]] = r["n"], [r[c] for c in columns]
    return count.reshape(books.parts, books.size), total.reshape(books.parts, books.size, width)


def with_label_sums(rows: DataFrame) -> DataFrame:
    """``rows`` and ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of_label"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(sums.where(F.col("n") * HOT_SHARE > total).drop("n"))  # fewer than HOT_SHARE rows
    rest = sums.where(F.col("n") * HOT_SHARE <= total).drop("n")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    return rows.join(hot, same).unionByName(rows.join(F.broadcast(hot.select("of_label")), same, "left_anti").join(rest, same)).drop("of_label")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks): of each row that takes part the id, ``label``, ``code`` (a byte a part), ``error`` and ``label_error``."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries, a byte each")
    spark = df.sparkSession
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    given = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("vector"))
    rows = integers(given, "vector", scale).select("id", "label", "v")
    longest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    dims = max(1, -(-longest // parts)) * parts
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    start = np.array([r + [0] * (dims - len(r)) for r in first], np.int64).reshape(len(first), parts, dims // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    root = new_folder(spark, "codes")
    before = None
    for i in range(rounds if len(first) else 0):
        _assigned(rows, books, before, dims, False).write.parquet(f"{root}/{i}")
        if i:
            remove(f"{root}/{i - 1}")
        rows = spark.read.parquet(f"{root}/{i}")
        count, total = _sums(rows, books, dims)
        moved = np.where(count[..., None] > 0, np.floor_divide(total, np.maximum(count, 1)[..., None]), books.entries)
        before, books = books, Codebooks(moved)
    if len(first):
        coded = _assigned(rows, books, before, dims, True)
    else:
        coded = rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = cut(coded.select("id", "label", "code", "error"))
    remove(root)
    return with_label_sums(coded).withColumnRenamed("id", id_col), books


def decompress(codes: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "approximate") -> DataFrame:
    """All columns of ``codes`` and the integers that the codes stand for (null for a null code)."""
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(books.parts)
        for b in batches:
            given = b.column(b.schema.get_field_index(code_col)).to_pylist()
            values = [None if c is None else books.entries[every, np.frombuffer(c, np.uint8)].ravel() for c in given]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.list_(pa.int64()))], names=[*b.schema.names, out_col])

    return codes.mapInArrow(run, StructType([*codes.schema.fields, StructField(out_col, ArrayType(LongType()))]))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` in 16 codes of 64 entries, after two rounds."""
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _round(n: int) -> str:
    """SQL of one assignment to the entries of c{n}."""
    return f"""
d{n} AS (SELECT f.vec_id, f.part, c.entry, sum((f.x - c.x) * (f.x - c.x))::BIGINT AS d FROM flat f JOIN c{n} c USING (part, pos) GROUP BY ALL),
a{n} AS (SELECT vec_id, part, entry, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1),"""


def _update(n: int) -> str:
    """SQL of the entries c{n}, from the assignment before."""
    return f"""
t{n} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM a{n - 1} JOIN flat USING (vec_id, part) GROUP BY ALL),
s{n} AS (SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS x FROM t{n}),
c{n} AS (SELECT part, entry, pos, coalesce(s.x, c.x) AS x FROM c{n - 1} c LEFT JOIN s{n} s USING (part, entry, pos)),"""


ORACLE_SQL = {
    "op13_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nr FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
long AS (SELECT vec_id, nr, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x, generate_subscripts(embedding, 1) - 1 AS k, len(embedding) // 16 AS width FROM kept),
flat AS (SELECT vec_id, nr, k // width AS part, k % width AS pos, x FROM long),
c0 AS (SELECT part, nr AS entry, pos, x FROM flat WHERE nr < 64),{_round(0)}{_update(1)}{_round(1)}{_update(2)}{_round(2)}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
labelled AS (SELECT vec_id, code, error, label FROM coded JOIN kept USING (vec_id)),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM labelled GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
FROM labelled l JOIN sums s ON l.label IS NOT DISTINCT FROM s.label"""
}
