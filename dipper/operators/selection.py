"""Exact order statistics of groups of any size, by radix selection: no task holds a group's values.

A sketch of each group gives a bracket of a rank, and counts say how many values lie below and in it. A bracket that misses
its rank, which nothing relies on, becomes the whole range. A value becomes 64 bits that sort as it does. A range whose values don't fit a buffer of FEW is counted by its next
DIGIT bits, within the range that still holds the rank; the digit where the counts reach the rank gives the next range, from
its least to its largest value. Ranges lose DIGIT bits a round, so there are at most six rounds, whatever the values.
Counting combines before the shuffle. What is left at the end, FEW values or one value of any number, is sorted.

Nulls are left out; NaN counts as the largest value, as in Spark's order. A null key is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipper.sources.store import kept, small

#: Values that one buffer may hold, and that a task of Python may.
FEW, WHOLE = 100_000, 2_000_000
#: Steps of the quantiles that brackets are taken from, and their accuracy.
STEPS, ACCURACY = 512, 10_000
#: Bits of a round.
DIGIT = 12


def ordered_bits(x: Column) -> Column:
    """A long that sorts as a double does, NaN last; zeros of both signs are equal."""
    size = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))
    # powers of two are exact, the logarithm isn't
    exponent = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * 2.0**52).try_cast("long")
    normal = (exponent + 1023) * (1 << 52) + fraction
    bits = F.when(size < 2.0**-1022, (size / 2.0**-1074).try_cast("long")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(x < 0, -bits).otherwise(bits)


def all_fit(rows: DataFrame, keys: tuple[str, ...], few: int = FEW) -> bool:
    """Whether no group has more rows than a buffer holds."""
    return rows.groupBy(*keys).count().where(F.col("count") > few).isEmpty()


def selected(rows: DataFrame, keys: tuple[str, ...], value: str, ranks: dict[str, str], few: int = FEW, fit: bool | None = None) -> DataFrame:
    """One row a group: its keys, ``n`` (its values) and, for each of ``ranks``, the value at that place of the sorted ones.

    ``ranks``: places from 0, as SQL of ``n``. Groups without values are left out. ``rows`` are read for the sketch, the counts and the values, and once more a round. ``fit``: what
    ``all_fit`` says, where it's known.
    """
    every = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("of"), F.col(value).cast("double").alias("value"))
    if all_fit(every, ("of",), few) if fit is None else fit:
        found = every.groupBy("of").agg(F.sort_array(F.collect_list("value")).alias("values")).withColumn("n", F.size("values").cast("long"))
        return found.select("of.*", "n", *(F.try_element_at("values", (F.expr(sql) + 1).cast("int")).alias(name) for name, sql in ranks.items()))
    sketch = F.percentile_approx("value", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
    sizes = small(every.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), sketch.alias("knots")))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.expr(sql).cast("long").alias("k")) for name, sql in ranks.items()))).alias("rank")
    at = F.floor(F.col("rank.k") / F.col("n") * STEPS).cast("int")
    # the last rank is known, and needs no bracket
    last_one = F.col("rank.k") == F.col("n") - 1
    from_, to = F.when(last_one, F.col("most")).when(at >= 2, F.try_element_at("knots", at)).otherwise(F.col("least")), F.when(last_one, F.col("most")).when(at <= STEPS - 3, F.try_element_at("knots", at + 3)).otherwise(F.col("most"))
    brackets = small(sizes.select("of", "n", "least", "most", each, "knots").select("of", "n", "least", "most", "rank", from_.alias("from"), to.alias("to")))
    asked_for = F.collect_set(F.struct("from", "to")).alias("spans")
    own = small(brackets.where(~last_one).groupBy(F.col("of").alias("own")).agg(asked_for))
    value_of = every.join(own, F.col("of") == F.col("own")).select("own", "value", F.explode("spans").alias("span")).select("own", "value", "span.from", "span.to")
    inside = F.when(F.col("value").between(F.col("from"), F.col("to")), F.col("value"))
    counts = value_of.groupBy("own", "from", "to").agg(F.count(F.when(F.col("value") < F.col("from"), 1)).alias("below"), F.count(inside).alias("inside"), F.min(inside).alias("low"), F.max(inside).alias("high"))
    counts = counts.withColumnsRenamed({"from": "own_from", "to": "own_to"})
    same = (F.col("of") == F.col("own")) & (F.col("from") == F.col("own_from")) & (F.col("to") == F.col("own_to"))
    hit = (F.col("below") <= F.col("rank.k")) & (F.col("rank.k") < F.col("below") + F.col("inside"))
    held = lambda c, other: F.when(last_one, F.col("most") if c in ("low", "high") else other).when(hit, F.col(c)).otherwise(other)
    asked = brackets.join(counts, same, "left")
    # the last rank is of the largest value, so no more than its bits are asked for
    asked = asked.select("of", "n", ordered_bits(held("low", F.col("least"))).alias("lo"), ordered_bits(held("high", F.col("most"))).alias("hi"), F.when(last_one, F.col("n") - 1).when(hit, F.col("below")).otherwise(0).cast("long").alias("below"), F.when(last_one, 1).when(hit, F.col("inside")).otherwise(F.col("n")).cast("long").alias("inside"), "rank", held("low", F.col("least")).alias("low"), held("high", F.col("most")).alias("high"))
    asked = kept(asked)
    every = every.withColumn("bits", ordered_bits(F.col("value")))
    wide = f"hi > lo and inside > {few}"
    while not (open_ones := asked.where(wide)).isEmpty():
        # half the range fits a long, the range may not
        ranges = open_ones.select(F.col("of").alias("own"), "lo", "hi").distinct().withColumn("shift", F.expr(f"greatest(0, length(bin(shiftright(hi, 1) - shiftright(lo, 1))) + 1 - {DIGIT})"))
        within = every.join(small(ranges), (F.col("of") == F.col("own")) & F.col("bits").between(F.col("lo"), F.col("hi")))
        digit = F.expr("shiftright(bits, shift) - shiftright(lo, shift)")
        counts = within.groupBy("own", "lo", "hi", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"), F.min("bits").alias("least"), F.max("bits").alias("most"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = Window.partitionBy("own", "lo", "hi").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("prior", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumnsRenamed({"lo": "from", "hi": "to"})
        place = F.col("rank.k") - F.col("below") - F.col("prior")
        hit = open_ones.drop("low", "high").join(counts, (F.col("of") == F.col("own")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to"))).where((place >= 0) & (place < F.col("c")))
        narrower = hit.select("of", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("prior")).alias("below"), F.col("c").alias("inside"), "rank", "low", "high")
        asked = kept(asked.where(f"not ({wide})").unionByName(narrower))
    # ranges of one value are known, the others are read by their least and largest value, which is cheaper than by bits
    span = ("of", "n", "below", "low", "high")
    spans = small(asked.where("hi > lo").groupBy(*span).agg(F.collect_list("rank").alias("ranks")).withColumnRenamed("of", "own"))
    read = every.join(spans, (F.col("of") == F.col("own")) & F.col("value").between(F.col("low"), F.col("high")))
    read = read.groupBy("own", "n", "below", "low", "high", "ranks").agg(F.sort_array(F.collect_list("value")).alias("values"))
    read = read.select("own", "n", "below", "values", F.explode("ranks").alias("rank")).select("own", "n", F.col("rank.name").alias("name"), F.try_element_at("values", (F.col("rank.k") - F.col("below") + 1).cast("int")).alias("at"))
    found = asked.where("hi = lo").select(F.col("of").alias("own"), "n", F.col("rank.name").alias("name"), F.col("low").alias("at")).unionByName(read)
    return found.groupBy("own", "n").agg(*(F.max(F.when(F.col("name") == name, F.col("at"))).alias(name) for name in ranks)).select("own.*", "n", *ranks)


def medians(rows: DataFrame, keys: tuple[str, ...], value: str, out: str = "median", poisoned: bool = False, few: int = FEW, fit: bool | None = None) -> DataFrame:
    """(keys, out): the median of each group that has values; NaN are left out, or with ``poisoned`` make it NaN as in NumPy."""
    number = F.col(value).isNotNull() if poisoned else F.col(value).isNotNull() & ~F.isnan(value)
    ranks = {"low": "(n - 1) div 2", "high": "n div 2"} | ({"top": "n - 1"} if poisoned else {})
    found = selected(rows.where(number), keys, value, ranks, few, fit)
    middle = F.col("low") / 2 + F.col("high") / 2
    # NaN are last
    return found.select(*keys, (F.when(F.isnan("top"), float("nan")).otherwise(middle) if poisoned else middle).alias(out))
