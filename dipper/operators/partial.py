"""Sums over the points of a target from bounded blocks of them: no group holds a whole light curve.

Points go to (target, block, chunk of trials) groups, packed where they are read, so copies for chunks are of a few large
rows of bytes. A block's sums of its trials are packed arrays, added by (target, part of trials). A target of one block is
finished where its points are, so small light curves send no sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipper.operators.lightcurve import with_target_stats

#: Points of a block, and trials of a part, whose sums are one row.
BLOCK, PART = 2_000_000, 32
#: Groups and tasks for each of Spark's shuffle partitions, so that they share out evenly.
SHARES = 8

#: Points that are packed at once, and groups for each core.
PIECE, GROUPS = 200_000, 2

#: The place of a part that failed.
FAILED = -1

PACKED = "target string, n long, lo double, hi double, chunk int, part int, done boolean, packed binary, error string"


def with_error(schema: str, errors: bool) -> str:
    return f"{schema}, error string" if errors else schema


def failed(target: str | None, columns: tuple[str, ...], e: Exception) -> pd.DataFrame:
    """The one row of a group that failed: nulls, and what went wrong."""
    return pd.DataFrame([(target, *[None] * len(columns), f"{type(e).__name__}: {e}")], columns=["target", *columns, "error"], dtype=object)


def or_error(run: Callable[[tuple, pd.DataFrame], pd.DataFrame], columns: tuple[str, ...], errors: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A function of a group by target and more; with ``errors``, one that gives the row of ``failed`` where it raises."""

    def safe(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(key, part).assign(error=None)
        except Exception as e:  # noqa: BLE001
            return failed(key[0], columns, e)

    return safe if errors else run


def chunks_for(lc: DataFrame, block: int | None = None, tasks: int | None = None) -> int:
    """Into how many shares of its trials each light curve's blocks go: 1 where there are enough blocks for all ``tasks``."""
    sizes = lc.groupBy("target").agg((F.ceil(F.count(F.lit(1)) / block) if block else F.lit(1)).alias("blocks"))
    groups = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    tasks = SHARES * int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")) if tasks is None else tasks
    return max(1, -(-tasks // max(groups, 1)))


def copies_for(lc: DataFrame, block: int | None = None) -> int:
    """``chunks_for`` as many groups as keep all cores busy: copies of points grow with cores, not with shuffle partitions."""
    return chunks_for(lc, block, GROUPS * lc.sparkSession.sparkContext.defaultParallelism)


def packed(rows: DataFrame, keys: tuple[str, ...], also: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(keys, also, points): the ``values`` of the rows of a key as bytes, in pieces; ``also``: what is the same in all rows of a key."""
    each = rows.select(*keys, *also, *(F.col(v).cast("double") for v in values))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.select(*keys, *also).schema) + ", points binary"

    def pieces(held: list[pd.DataFrame]) -> pd.DataFrame:
        now = pd.concat(held, ignore_index=True)
        codes = now.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        points = now[list(values)].to_numpy(float)[order]
        heads = now.iloc[order[starts]][[*keys, *also]]
        return heads.assign(points=[points[a:b].T.tobytes() for a, b in zip(starts, [*starts[1:], len(order)], strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(map(len, held)) >= PIECE:
                yield pieces(held)
                held = []
        if held:
            yield pieces(held)

    return each.mapInPandas(run, schema)


def unpacked(points: pd.Series, n_values: int) -> np.ndarray:
    """The values (a row for each) of the pieces of a group."""
    return np.concatenate([np.frombuffer(p).reshape(n_values, -1) for p in points], axis=1)


def summed(lc: DataFrame, trials: Callable[[float, float], np.ndarray], sums: Callable, finish: Callable, columns: tuple[str, ...], schema: str, chunks: int | None = None, block: int = BLOCK, error: str | None = None, errors: bool = False, prepare: Callable = lambda t, x, w, lo: (t, x, w)) -> DataFrame:
    """Rows of ``schema``, a target and then ``columns``, for trials of each target.

    ``trials(lo, hi)``: all trials of a target by its first and last time. ``sums(t, x, w, own, lo)``: an array of sums for
    some points and trials; ``x`` is flux less its mean, ``w`` are weights that sum to 1 in the target, uniform or by
    ``error`` ** -2; ``prepare(t, x, w, lo)``: what to give in place of these three, made once for all trials. ``finish(total, places, own, n, lo, hi)``: tuples of ``columns``, from sums of all points. All numeric.

    A target whose functions raise fails the job; with ``errors`` there is a column of that name, ``error``, and for each
    share of the work that failed a row with the text and nulls, while all others go on. A target with such a row is not
    searched whole.
    """
    chunks = copies_for(lc, block) if chunks is None else chunks
    w = F.lit(1.0) if error is None else F.pow(F.col(error), -2)
    stats = (F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("w").alias("w_total"), F.sum(F.col("w") * F.col("flux")).alias("wf_total"))
    rows = with_target_stats(lc.withColumn("w", w).select("target", "t", "flux", "w"), *stats)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("t", "flux"), F.ceil(F.col("n") / block)).cast("int"))
    rows = rows.withColumn("mean", F.col("wf_total") / F.col("w_total"))
    values = ("t", "flux") if error is None else ("t", "flux", "w")
    rows = packed(rows, ("target", "block"), ("n", "lo", "hi", "w_total", "mean"), values)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def one_block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pd.concat(parts)
        head = pieces.iloc[0]
        n, lo, hi, chunk = int(head["n"]), float(head["lo"]), float(head["hi"]), int(head["chunk"])
        points = unpacked(pieces["points"], len(values))
        t, x, w = points[0], points[1] - float(head["mean"]), (np.ones(points.shape[1]) if error is None else points[2]) / float(head["w_total"])
        order = np.lexsort((x, t))
        t, x, w = t[order], x[order], w[order]
        own = {"target": [head["target"]], "n": n, "lo": lo, "hi": hi, "chunk": chunk}
        try:
            every, given = trials(lo, hi), prepare(t, x, w, lo)
            parts_of = ((part, places, sums(*given, every[places], lo)) for part, places in enumerate(_parts(len(every), chunk, chunks)))
            if n <= block:
                # all parts in one row, as each row is a group of its own afterwards
                found = [np.array(finish(total, places, every[places], n, lo, hi), float).ravel() for _, places, total in parts_of]
                yield pd.DataFrame({**own, "part": 0, "done": True, "packed": [np.concatenate([np.zeros(0), *found]).tobytes()], "error": None})
                return
            for part, _, total in parts_of:
                yield pd.DataFrame({**own, "part": part, "done": False, "packed": [total.tobytes()], "error": None})
        except Exception as e:
            if not errors:
                raise
            yield pd.DataFrame({**own, "part": FAILED, "done": True, "packed": [b""], "error": f"{type(e).__name__}: {e}"})

    def all_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for rows in parts:
            for packed in rows["packed"]:
                now = np.frombuffer(packed)
                total = now if total is None else total + now
            head = rows.iloc[0] if len(rows) else head
        if head["part"] == FAILED:
            yield pd.DataFrame([(head["target"], *[None] * len(columns), head["error"])], columns=["target", *columns, "error"], dtype=object)
            return
        try:
            if head["done"]:
                found = total.reshape(-1, len(columns))
            else:
                every = trials(head["lo"], head["hi"])
                places = _parts(len(every), int(head["chunk"]), chunks)[int(head["part"])]
                found = np.array(finish(total, places, every[places], int(head["n"]), head["lo"], head["hi"]), float).reshape(-1, len(columns))
        except Exception as e:
            if not errors:
                raise
            yield failed(head["target"], columns, e)
            return
        out = pd.DataFrame(found, columns=list(columns))
        out.insert(0, "target", head["target"])
        yield out.assign(error=None) if errors else out

    # a given number, as groups of few bytes hold much work and mustn't be put together
    rows = rows.repartition(SHARES * int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target", "block", "chunk")
    done = rows.groupBy("target", "block", "chunk").applyInPandas(one_block, PACKED)
    return done.groupBy("target", "chunk", "part").applyInPandas(all_blocks, with_error(schema, errors))


def _parts(n: int, chunk: int, chunks: int) -> list[np.ndarray]:
    """The places of a chunk's trials, in parts."""
    own = np.arange(chunk, n, chunks)
    return [own[i : i + PART] for i in range(0, len(own), PART)]
