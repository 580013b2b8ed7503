"""Scans in order within targets of any size: running sums, last values and numbers, without a task that sees a whole target.

Rows are range-partitioned by (target, time), so a slice is a stretch of one target, or several whole ones. A window runs
within (target, slice); a summary per (target, slice), such as a count or the last value, is carried from slice to slice by
a window over the summaries, which are as many as slices and targets together; and what was carried is added to the rows.
Slices are kept in the shared folder, as every step must see the same ones.

A null target is a target of its own: keys are compared within a struct, which is never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dipper.sources.store import kept, small

#: Rows of one slice, about, where there are more than a slice for each task.
SLICE_ROWS = 1_000_000
#: What ``sliced`` adds.
ADDED = ("of", "slice")


def sliced(rows: DataFrame, keys: tuple[str, ...] = ("target",), order: tuple[str, ...] = ("t", "flux"), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` in slices: adds ``of`` (the keys) and ``slice``, which ascends with the keys and the order."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // slice_rows))
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *keys, *order, "place").drop("place")
    return kept(dealt.withColumns({"of": F.struct(*keys), "slice": F.spark_partition_id().cast("long")}))


def within(*order: str | Column, keys: tuple[str, ...] = ADDED) -> WindowSpec:
    """The rows of a slice up to each."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: tuple[str, ...] = ("of",), by: str = "slice", following: bool = False) -> WindowSpec:
    """Of a summary: the slices before (or after) each."""
    return Window.partitionBy(*keys).orderBy(F.desc(by) if following else F.asc(by)).rowsBetween(Window.unboundedPreceding, -1)


def attach(rows: DataFrame, summary: DataFrame, keys: tuple[str, ...] = ADDED) -> DataFrame:
    """``rows`` with what a summary has for their slices."""
    return rows.join(small(summary), list(keys))


def added(x: str, spec: WindowSpec) -> Column:
    """The sum over a window; 0 where that is empty."""
    return F.coalesce(F.sum(x).over(spec), F.lit(0))


def numbered(rows: DataFrame, order: tuple[str, ...] = ("t", "flux")) -> DataFrame:
    """Adds to sliced rows ``i``, the number in the target from 0, and ``n``, the target's rows."""
    counts = rows.groupBy(*ADDED).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(*ADDED, added("c", before()).alias("base"), F.sum("c").over(Window.partitionBy("of")).alias("n"))
    local = rows.withColumn("i", F.row_number().over(Window.partitionBy(*ADDED).orderBy(*order)).cast("long") - 1)
    return attach(local, counts).withColumn("i", F.col("i") + F.col("base")).drop("base")


def segmented(rows: DataFrame, gap: float) -> DataFrame:
    """Adds to rows sliced by (t, flux) ``segment``, which begins anew after more than ``gap`` days without a row."""
    by = Window.partitionBy(*ADDED).orderBy("t", "flux")
    rows = rows.withColumn("new", F.when(F.col("t") - F.lag("t").over(by) > gap, 1).otherwise(0)).withColumn("inner", F.sum("new").over(within("t", "flux")))
    ends = rows.groupBy(*ADDED).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("new").alias("inside"))
    crossed = F.when(F.col("first_t") - F.lag("last_t").over(Window.partitionBy("of").orderBy("slice")) > gap, 1).otherwise(0)
    ends = ends.withColumn("crossed", crossed)
    base = F.col("crossed") + added("crossed", before()) + added("inside", before())
    return attach(rows, ends.select(*ADDED, base.alias("base"))).withColumn("segment", (F.col("inner") + F.col("base")).cast("long")).drop("new", "inner", "base")


def nearest_known(rows: DataFrame, known: Column, *order: str) -> DataFrame:
    """Adds to sliced rows ``left_known`` and ``right_known``: the nearest values of ``known``, which sorts as the rows do, that aren't null."""
    rows = rows.withColumn("known", known)
    last = lambda by: F.last("known", ignorenulls=True).over(within(*map(by, order)))
    local = rows.withColumn("left_known", last(F.asc)).withColumn("right_known", last(F.desc))
    ends = rows.groupBy(*ADDED).agg(F.min("known").alias("first_known"), F.max("known").alias("last_known"))
    carried = ends.select(*ADDED, F.last("last_known", ignorenulls=True).over(before()).alias("from_left"), F.last("first_known", ignorenulls=True).over(before(following=True)).alias("from_right"))
    both = {"left_known": F.coalesce("left_known", "from_left"), "right_known": F.coalesce("right_known", "from_right")}
    return attach(local, carried).withColumns(both).drop("known", "from_left", "from_right")
