"""A second box search, of another kind, that results are compared with: no bins, given durations, likelihood.

Points are sorted by phase; a box of a given duration begins at each point and holds those from there to its end, around
the cycle. Both ends move along the sorted phases, so a period takes a sort and one search of ends a duration. The
objective is the gain in likelihood of a box below the rest: half the weight inside times the squared depth.

Long curves aren't sorted for each period, nor read. What a box of a given duration holds in one cycle depends on the time
at which it begins there, not on the period; so for cells of time the least sum and the least and most weight of such a
stretch are found once, and a period adds them up at its cycles' beginnings. They bound the best box that begins in a cell of
phase; only cells whose bound reaches the best box found so far have their points sorted, so the result is that of all boxes
(``Curve``).

A group is a target and a share of its periods, and holds that light curve, as all boxes are over all points; the search
that the flow uses (``bls.search``) has no such bound. Points go packed to as many groups as keep all cores busy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipper.operators import kernels
from dipper.operators.partial import SHARES, copies_for, or_error, packed, unpacked, with_error

FIELDS = ("period", "duration_days", "transit_time", "depth", "power")
SCHEMA = "target string, pid long, " + ", ".join(f"{c} double" for c in FIELDS)
#: Points from which on cells bound boxes, cells that are tried first, cells of a duration for each cycle, and cells of a curve of fewer points.
MANY, FIRST, CELLS, MOST = 4000, 2, 32, 1_000_000
#: Parts of a cell, points in cells beyond which parts are bounded first, and cells of a duration that weights are bounded in.
PARTS, SORTED, COUNTED = 4, 2_000, 256
#: Cells for each point that are tried first, at most.
EMPTY = 4


def auto_periods(baseline: float, durations: Sequence[float], transits: int = 3, factor: float = 1.0) -> np.ndarray:
    """The grid without limits: uniform in frequency, from twice the longest duration to a ``transits``-th of the baseline."""
    if baseline <= 0:
        return np.zeros(0)
    lo, hi = 2.0 * max(durations), baseline / transits
    if hi < lo:
        return np.zeros(0)
    step = factor * min(durations) / baseline**2
    return 1 / (1 / lo - step * np.arange(1 + round((1 / lo - 1 / hi) / step)))


def best_box(t: np.ndarray, y: np.ndarray, w: np.ndarray, period: float, durations: Sequence[float]) -> tuple[float, ...] | None:
    """FIELDS of the best box of a period; times are from the first one. None if no box lies below the rest.

    Ties after rounding to 9 digits go to the earlier duration, then the earlier phase.
    """
    phase = t % period
    order = np.lexsort((y, phase))
    phase, y, w = phase[order], y[order], w[order]
    n = len(phase)
    twice = np.concatenate([phase, phase + period])
    sums = np.concatenate([[0.0], np.cumsum(np.tile(w * y, 2))])
    weights = np.concatenate([[0.0], np.cumsum(np.tile(w, 2))])
    all_sum, all_weight = (w * y).sum(), w.sum()
    best: tuple[float, ...] | None = None
    for d in durations:
        end = np.minimum(np.searchsorted(twice, phase + d, side="left"), np.arange(n) + n)
        s, inside = sums[end] - sums[:n], weights[end] - weights[:n]
        outside = all_weight - inside
        ok = outside > 1e-9 * all_weight
        depth = np.where(ok, (all_sum - s) / np.where(ok, outside, 1) - s / inside, -1)
        power = np.where(depth > 0, 0.5 * inside * depth**2, -1)
        i = int(np.argmax(np.round(power, 9)))
        if power[i] > 0 and (best is None or round(power[i], 9) > round(best[4], 9)):
            best = (period, d, (phase[i] + d / 2) % period, depth[i], power[i])
    return best


class Cells:
    """Cells of time of a ``m``-th of a duration: where their points are, and bounds of what a stretch of the duration holds that begins in a cell or the next.

    ``least``, from cell ``first`` on: the least sum of ``x`` of any such stretch; ``weights``: the least and the most weight, only
    of cells that aren't finer than COUNTED. Ends of cells are taken a little wider than they are, so that
    rounding of phases makes no difference.
    """

    def __init__(self, t: np.ndarray, x: np.ndarray, w: np.ndarray, duration: float, m: int) -> None:
        self.size, self.m, self.first = duration / m, m, -(m + 2)
        last = int(t[-1] / self.size) + 1
        n, room = last - self.first + 1, 1e-12 * (t[-1] + duration)
        edges = np.arange(self.first, last + m + 3) * self.size
        # the first point of each cell, and the first behind the one before
        self.lo, self.hi = (np.searchsorted(t, edges + v, side=side).astype(np.int32) for v, side in ((-room, "left"), (room, "right")))
        ends = np.column_stack([self.lo[:-1], self.hi[1:] + 1]).ravel()
        more = np.append(x, x[-1])
        least, most = np.minimum.reduceat(more, ends)[::2], np.maximum.reduceat(more, ends)[::2]
        least = np.minimum(least[m : m + n], least[m + 1 : m + 1 + n]) - np.maximum(most[:n], most[1 : n + 1])
        self.least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        if m <= COUNTED:
            few = np.maximum(w[self.lo[m : m + n]] - w[self.hi[2 : 2 + n]], 0.0)
            self.weights = np.array([few, w[self.hi[m + 2 : m + 2 + n]] - w[self.lo[:n]]])

    def bases(self, period: float, cycles: np.ndarray) -> np.ndarray:
        """The place of the cell that each cycle begins in."""
        return np.floor(cycles * period / self.size).astype(int) - self.first

    def folded(self, values: np.ndarray, period: float, cycles: np.ndarray) -> np.ndarray:
        """Sums of values (in the last axis), of boxes that begin in each cell of phase."""
        n, last = int(np.ceil(period / self.size)), values.shape[-1]
        total = np.zeros((*values.shape[:-1], n))
        for base in self.bases(period, cycles).tolist():
            a, b = max(0, -base), min(n, last - base)
            if a < b:
                total[..., a:b] += values[..., base + a : base + b]
        return total

    def folded_at(self, values: np.ndarray, period: float, cycles: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``folded`` for some cells of phase."""
        if len(own) * 4 * self.size > period:
            return self.folded(values, period, cycles)[own]
        place = self.bases(period, cycles)[:, None] + own
        there = (place >= 0) & (place < len(values))
        return np.where(there, values[np.where(there, place, 0)], 0.0).sum(axis=0)


class Curve:
    """A long curve for many periods: sorted by time, with sums that boxes are bounded by. Times are from the first one."""

    def __init__(self, t: np.ndarray, y: np.ndarray, w: np.ndarray, many: int = MANY) -> None:
        self.t, self.y, self.w, self.many = t, y, w, many
        self.weight = w.sum()
        self.x = w * (y - (w * y).sum() / self.weight)  # sums to 0, which depths don't depend on
        self.sound = bool(len(t) >= many and t[0] >= 0 and t[-1] > 0 and np.isfinite(t).all() and np.isfinite(self.x).all() and (w > 0).all())
        self.cells: dict[tuple[float, int], Cells] = {}
        if self.sound:
            self.sum_x, self.sum_w, self.least_w = kernels.running(self.x), kernels.running(w), w.min()

    def cells_for(self, duration: float, m: int) -> Cells:
        if (duration, m) not in self.cells:
            self.cells[duration, m] = Cells(self.t, self.sum_x, self.sum_w, duration, m)
        return self.cells[duration, m]

    def best_box(self, period: float, durations: Sequence[float]) -> tuple[float, ...] | None:
        """As the function of that name."""
        tried = [(k, d) for k, d in enumerate(durations) if d <= period]
        if not tried or not self.sound or any(1.25 * d >= period for _, d in tried):
            return best_box(self.t, self.y, self.w, period, durations)
        # a box that begins in the last cycle goes on in the first one, as one of the cycle before that
        cycles = np.arange(-1, int(self.t[-1] / period) + 1)
        found: list[tuple] = []
        left = []
        for k, d in tried:
            # so fine that what bounds add up over the cycles stays below the noise of a box, or that most cells are empty
            cells = self.cells_for(d, 2 ** min(self._finest(d), self._finest(d, EMPTY * len(self.t)), max(4, round(np.log2(CELLS * len(cycles))))))
            counted = self.cells_for(d, min(cells.m, COUNTED))
            size = self._size(*counted.folded(counted.weights, period, cycles))
            own = np.arange(int(np.ceil(period / cells.size)))
            bounds = self._bounds(cells.folded(cells.least, period, cycles), size[own // (cells.m // counted.m)])
            left.append([k, d, cells, counted, size, *self._tried(period, cycles, k, d, cells, own, bounds, found)])
        for k, d, cells, counted, size, own, bounds in left:
            own, bounds = self._rest(own, bounds, found)
            # where many cells stay, their parts are bounded before points are sorted
            while 2 * len(own) * len(cycles) * len(self.t) * cells.size > SORTED * self.t[-1] and cells.m * PARTS <= 2 ** self._finest(d):
                cells = self.cells_for(d, cells.m * PARTS)
                own = (own[:, None] * PARTS + np.arange(PARTS)).ravel()
                own = own[own < int(np.ceil(period / cells.size))]
                bounds = self._bounds(cells.folded_at(cells.least, period, cycles, own), size[own // (cells.m // counted.m)])
                own, bounds = self._rest(*self._tried(period, cycles, k, d, cells, own, bounds, found), found)
            found += self._found(period, cycles, k, d, cells, own) if len(own) else []
        best = min(found, key=lambda f: (-round(f[0], 9), f[1], f[2]), default=None)
        if best is None:
            return None
        power, k, phase, depth = best
        d = durations[k]
        return period, d, (phase + d / 2) % period, depth, power

    def _finest(self, duration: float, n: float | None = None) -> int:
        """Cells of a duration, by their logarithm, of which a curve has about n; by default four times as many as points, or MOST."""
        return int(np.ceil(np.log2(max(16.0, (n or max(4 * len(self.t), MOST)) * duration / self.t[-1]))))

    def _size(self, few: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What the squared sum of a box of some least and most weight is divided by, at least. A box holds the point that it begins at."""
        return np.minimum(*(v * (self.weight - v) ** 2 for v in (np.maximum(few, self.least_w), np.minimum(most, self.weight))))

    def _bounds(self, least: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The most power of a box in cells of phase."""
        return np.divide(0.5 * (np.minimum(least, 0.0) * self.weight) ** 2, size, out=np.full(len(least), np.inf), where=size > 0)

    def _tried(self, period: float, cycles: np.ndarray, k: int, d: float, cells: Cells, own: np.ndarray, bounds: np.ndarray, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Adds the best box of the cells of the highest bounds to ``found``; the others."""
        top = np.zeros(len(own), bool)
        top[np.argpartition(-bounds, FIRST)[:FIRST] if len(own) > FIRST else slice(None)] = True
        found += self._found(period, cycles, k, d, cells, own[top]) if top.any() else []
        return own[~top], bounds[~top]

    @staticmethod
    def _rest(own: np.ndarray, bounds: np.ndarray, found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The cells that may hold a better box than the best one found, the noise of sums aside."""
        stay = bounds >= max(0.0, max((f[0] for f in found), default=0.0) * (1 - 1e-9) - 1e-6)
        return own[stay], bounds[stay]

    def _found(self, period: float, cycles: np.ndarray, k: int, d: float, cells: Cells, own: np.ndarray) -> list[tuple]:
        """(power, which duration, phase, depth) of the best box of a duration that begins in some cells of phase, if there is one."""
        # cells in a row, of half a duration at most, share their points
        new = np.flatnonzero(np.concatenate([[True], (np.diff(own) > 1) | (np.diff(own // (cells.m // 2)) > 0)]))
        from_, to = own[new], own[np.append(new[1:], len(own)) - 1]
        base = cells.bases(period, cycles)[:, None]
        at = lambda edge, place: edge[np.minimum(np.maximum(base + place, 0), len(edge) - 1)].ravel()
        # points of where boxes begin, those between, which all boxes of the cells hold, and points of where they end
        a, b, c, e = at(cells.lo, from_), at(cells.hi, to + 2), at(cells.lo, from_ + cells.m), at(cells.hi, to + cells.m + 2)
        of = np.tile(np.arange(len(new), dtype=np.int16 if len(new) < 1 << 15 else np.int64), len(cycles))
        # without points between, the stretches may meet
        c = np.maximum(b, c)
        between = [np.bincount(of, s[c] - s[b], len(new)) for s in (self.sum_x, self.sum_w)]
        first, count = np.concatenate([a, c]), np.concatenate([b - a, np.maximum(e - c, 0)])
        ends = np.cumsum(count)
        rows = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
        begin = np.repeat(np.arange(len(count)) < len(a), count)
        of = np.repeat(np.concatenate([of, of]), count)
        phase = self.t[rows] % period
        turn = np.rint(((((from_ + to) / 2 + 1) * cells.size)[of] + np.where(begin, 0.0, d) - phase) / period)
        cell = np.minimum((phase / cells.size).astype(np.int64), int(np.ceil(period / cells.size)) - 1)
        begin &= (turn == 0) & (from_[of] <= cell) & (cell <= to[of])
        phase = phase + period * turn
        order = np.argsort(phase)
        order = order[np.argsort(of[order], kind="stable")]
        if (np.diff(phase[order]) == 0).any():
            order = np.lexsort((self.y[rows], phase, of))
        rows, begin, of, phase = rows[order], begin[order], of[order], phase[order]
        start = np.flatnonzero(begin)
        if not len(start):
            return []
        end = np.empty(len(start), np.int64)
        starts, points = (np.searchsorted(v, np.arange(len(new) + 1)).tolist() for v in (of[start], of))
        until = phase[start] + d
        for i in range(len(new)):
            own, near = slice(starts[i], starts[i + 1]), slice(points[i], points[i + 1])
            end[own] = points[i] + np.searchsorted(phase[near], until[own], side="left")
        s, inside = (np.concatenate([[0.0], np.cumsum(v[rows])]) for v in (self.x, self.w))
        s, inside = s[end] - s[start] + between[0][of[start]], inside[end] - inside[start] + between[1][of[start]]
        outside = self.weight - inside
        ok = outside > 1e-9 * self.weight
        depth = np.where(ok, -s / np.where(ok, outside, 1) - s / inside, -1)
        power = np.where(depth > 0, 0.5 * inside * depth**2, -1)
        i = int(np.argmax(np.round(power, 9)))
        return [(power[i], k, phase[start[i]], depth[i])] if power[i] > 0 else []


def search(lc: DataFrame, periods: Sequence[float] | None = None, durations: Sequence[float] = (0.1,), error: str | None = None, chunks: int | None = None, errors: bool = False) -> DataFrame:
    """SCHEMA rows: the best box of each period, among given durations; the grid without limits where no ``periods`` are given.

    ``error``: the column of errors that points are weighted by. ``transit_time``: the first middle from the target's first time on.
    ``errors``: as in ``partial.summed``.
    """
    w = None if error is None else F.pow(F.col(error), -2)
    parts = copies_for(lc) if chunks is None else chunks
    values = ("t", "flux") if error is None else ("t", "flux", "w")
    rows = packed(lc.select("target", "t", "flux", *([] if error is None else [w.alias("w")])), ("target",), (), values)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        points = unpacked(part["points"], len(values))
        points = points[:, np.lexsort((points[1], points[0]))]
        t, y = points[:2]
        first = t[0]
        grid = auto_periods(t[-1] - first, durations) if periods is None else np.asarray(periods, float)
        curve = Curve(t - first, y - np.median(y), np.ones(len(t)) if error is None else points[2])
        out = [(pid, curve.best_box(float(grid[pid]), durations)) for pid in range(key[1], len(grid), parts)]
        found = pd.DataFrame([(pid, *b) for pid, b in out if b], columns=["pid", *FIELDS])
        found["transit_time"] += first
        found.insert(0, "target", key[0])
        return found.astype({"pid": "int64"} | dict.fromkeys(FIELDS, "float64"))

    # a given number of tasks, as small groups hold much work
    tasks = SHARES * int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "target", "chunk").groupBy("target", "chunk").applyInPandas(or_error(run, ("pid", *FIELDS), errors), with_error(SCHEMA, errors))


def best_of(found: DataFrame) -> DataFrame:
    """The strongest row of each target, ties after rounding to 6 digits to the lower ``pid``."""
    order = F.min_by(F.struct(*found.columns), F.struct(-F.round("power", 6), F.col("pid"))).alias("b")
    return found.groupBy("target").agg(order).select("b.*")
