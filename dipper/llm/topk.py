"""Exact top-k search by inner product: columnar branch and bound.

Vectors become integers, floor(scale * x). Queries and candidates are dealt into cells, a group of candidates against
a group of queries, so that neither side needs to fit anywhere as a whole. In a cell, candidates lie in vertical
layout, one row a dimension. Partial scores are accumulated block of dimensions by block of dimensions, those with
most of the query's mass first. Before the first block and after each, candidates whose partial score and remaining mass
(product of the norms of what is left of both vectors) can't reach the query's bound are dropped, and the survivors
compacted. The bound is the k-th best lower bound of the cell, or, if that is more, the query's k-th best score among the
first group of candidates: all queries meet that group first, and take what they found to the other cells. Bounds only
drop what is strictly below, so ties stay. The best k of each cell meet in a ranking by query.

Vectors that are null, or hold null or non-finite components, take no part. A shorter vector counts as filled up with
zeros. Scores must fit 64 bits. Repeated rows are candidates each; a query is never its own candidate by id. Rows are
dealt by where they lie, not by their id, so that an id of many rows fills no cell. Columns other than the id and the
vector are not read. With fewer than k candidates, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dipper.llm.common import cut

#: Rows of one cell's two sides.
CELL_CANDIDATES, CELL_QUERIES = 8192, 4096
#: Dimensions accumulated before survivors are compacted.
BLOCK = 16


def search_cell(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, bounds: np.ndarray) -> tuple[list, list, list]:
    """The k best candidates of each query: (number of the query, candidate ids, scores). ``data`` and ``queries``: rows of integers.

    ``bounds``: a score for each query, below which its candidates aren't wanted.
    """
    dims = data.shape[1]
    top = max(int(np.abs(data).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * max(dims, 1)
    kind = np.float64 if top < 2**53 else np.int64  # both exact; doubles are faster
    columns = np.ascontiguousarray(data.T).astype(kind)
    cuts = [slice(i, min(i + BLOCK, dims)) for i in range(0, dims, BLOCK)] or [slice(0, 0)]
    mass = np.stack([(columns[c].astype(np.float64) ** 2).sum(0) for c in cuts])
    out: tuple[list, list, list] = ([], [], [])
    for number, (q, own, bound) in enumerate(zip(queries, query_ids, bounds.astype(np.float64), strict=True)):
        wide = q.astype(np.float64)
        q_mass = np.array([(wide[c] ** 2).sum() for c in cuts])
        order = np.argsort(-q_mass, kind="stable")
        at = np.flatnonzero(ids != own)
        score = np.zeros(len(at), kind)
        rest, q_rest = mass[:, at].sum(0), q_mass.sum()
        q = q.astype(kind)
        if np.isfinite(bound):
            live = np.sqrt(rest * q_rest) * (1 + 1e-9) + 1 + abs(bound) * 1e-12 >= bound
            if live.sum() < 0.9 * len(at):
                at, score, rest = at[live], score[live], rest[live]
        for done, b in enumerate(order):
            if not len(at):
                break
            c = cuts[b]
            # the first block as a whole; later ones for survivors
            score = score + (q[c] @ columns[c][:, at] if len(at) < columns.shape[1] - 1 else (q[c] @ columns[c])[at])
            if done == len(order) - 1:
                break
            rest, q_rest = np.maximum(rest - mass[b, at], 0), max(q_rest - q_mass[b], 0.0)
            if len(at) > k:
                margin = np.sqrt(rest * q_rest) * (1 + 1e-9) + 1
                floor = max(np.partition(score - margin, len(at) - k)[len(at) - k], bound - abs(bound) * 1e-12)
                live = score + margin >= floor
                if live.sum() < 0.9 * len(at):
                    at, score, rest = at[live], score[live], rest[live]
        if len(at) > k:
            live = score >= np.partition(score, len(at) - k)[len(at) - k]
            at, score = at[live], score[live]
        best = np.lexsort((ids[at], -score))[:k]
        out[0].extend([number] * len(best))
        out[1].extend(ids[at[best]].tolist())
        out[2].extend(score[best].astype(np.int64).tolist())
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query row its k best other rows: ``query_id``, ``rank`` (from 1), the id column and ``score``."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    # kept with their numbers, so that every reader deals a row to the same cell
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("is_query").cast("int")), F.lit(0)).alias("q")).first()
    groups, query_groups = max(32, -(-size["n"] // CELL_CANDIDATES)), max(1, -(-size["q"] // CELL_QUERIES))
    cell = F.col("c") * query_groups + F.col("g")
    candidates = rows.select("id", "v", F.pmod(F.xxhash64("at"), F.lit(groups)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_groups - 1).cast("long"))).alias("g"))
    candidates = candidates.select("c", cell.alias("cell"), "id", "v", F.lit(False).alias("is_query"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("bound"))
    queries = rows.where("is_query").select("at", "id", "v", F.pmod(F.xxhash64("at", F.lit(1)), F.lit(query_groups)).alias("g"))

    def search(table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks()
        off = vectors.offsets.to_numpy().astype(np.int64)
        length = np.diff(off)
        matrix = np.zeros((len(vectors), int(length.max(initial=0))), np.int64)
        flat = vectors.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        matrix[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], length)] = flat
        ids = table.column("id").to_numpy()
        ask = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        bounds = table.column("bound").cast(pa.float64()).to_numpy(zero_copy_only=False)[ask]
        number, found, score = search_cell(matrix[ask], ids[ask], matrix[~ask], ids[~ask], k, np.where(np.isnan(bounds), -np.inf, bounds))
        number = np.asarray(number, np.int64)
        at = table.column("at").to_numpy(zero_copy_only=False)[ask].astype(np.int64)
        return pa.table({"at": pa.array(at[number], pa.int64()), "query_id": pa.array(ids[ask][number], pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    def best_of(asked: DataFrame, offered: DataFrame) -> DataFrame:
        asked = asked.select(cell.alias("cell"), "id", "v", F.lit(True).alias("is_query"), "at", "bound")
        return offered.select("cell", "id", "v", "is_query", "at", "bound").unionByName(asked).groupBy("cell").applyInArrow(search, "at long, query_id long, id long, score long")

    first = cut(best_of(queries.withColumns({"c": F.lit(0).cast("long"), "bound": F.lit(None).cast("long")}), candidates.where("c = 0")))
    bounds = first.groupBy(F.col("at").alias("bound_at")).agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = queries.join(bounds.select("bound_at", "bound"), F.col("at") == F.col("bound_at"), "left")
    rest = known.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(groups - 1).cast("long"))).alias("c"))
    found = first.unionByName(best_of(rest, candidates.where("c > 0")))
    order = Window.partitionBy("at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for each of those whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES = {"op1_exact_top_k": op1_exact_top_k}
ORACLE_SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM flat q JOIN flat c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 10"""
}
