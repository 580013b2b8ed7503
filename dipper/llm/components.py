"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipper.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex joins its larger neighbours to the least of its neighbourhood; one row an edge."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "v")
    return both.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex joins its smaller neighbours, and itself, to the least of them. Edges point down: a > b.

    Edges of the smaller neighbours are few for each vertex (those of a hub come from its larger ones), so a window holds.
    """
    by = Window.partitionBy("a").orderBy("b")
    rows = edges.withColumns({"m": F.first("b").over(by), "place": F.row_number().over(by)})
    return rows.where("place = 1 or b > m").select(F.when(F.col("place") == 1, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """Vertices that have an edge, as (vertex, component): the least vertex that each is connected with.

    ``edges``: (a, b), longs, in any direction; loops count for nothing. The number of rounds grows with the logarithm
    of the diameter; a round has three exchanges, never has more rows than the one before, and its edges are written to
    the shared folder.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now)
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        now = cut(_small_star(_large_star(now)))
    least = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return least.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component"))).distinct()
