"""NumPy kernels for one light curve, run by Spark on groups: smoothing, detrending, full-grid box search.

Built-in functions express the same on small grids (``bls``); tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np


class TooShort(ValueError):
    """A run with fewer points than a window."""


@lru_cache(maxsize=64)
def _hat(window: int, order: int) -> np.ndarray:
    """Row i fits a polynomial to the whole window and evaluates it at place i."""
    x = np.linspace(-1, 1, window)
    q, _ = np.linalg.qr(np.vander(x, order + 1))
    return q @ q.T


def savgol(y: np.ndarray, window: int, order: int) -> np.ndarray:
    """Local-polynomial smoothing; half a window at either end follows the polynomial of the last whole window."""
    n, m = len(y), window // 2
    if n < window:
        raise TooShort(f"{n} points are fewer than a window of {window}")
    hat = _hat(window, order)
    out = np.empty(n)
    out[m : n - m] = np.convolve(y, hat[m][::-1], mode="valid")
    out[:m], out[n - m :] = hat[:m] @ y[:window], hat[m + 1 :] @ y[-window:]
    return out


def fitting_window(window: int, n: int, order: int) -> int:
    """An odd window that fits n points and an order, where there is one."""
    window += window % 2 == 0
    if window >= n:
        window = n - 1 - (n - 1 + 1) % 2
    if window <= order:
        window = order + 2
        window += window % 2 == 0
    return window


def detrend_segment(flux: np.ndarray, window: int, order: int, rounds: int, lower: float) -> np.ndarray:
    """The trend of a gapless run; points far below it don't pull it down in the next round."""
    n = len(flux)
    w = fitting_window(window, n, order)
    keep, trend, place = np.ones(n, bool), np.ones(n), np.arange(n)
    for _ in range(rounds):
        if keep.sum() < w:
            keep = np.ones(n, bool)
        smooth = savgol(flux[keep], w, order)
        trend = np.interp(place, place[keep], smooth)
        rest = flux - trend
        keep = rest > -lower * np.std(rest[keep])
    return trend


def trend(t: np.ndarray, flux: np.ndarray, window: int = 151, order: int = 3, rounds: int = 2, lower: float = 3.0, gap: float = 0.5) -> np.ndarray:
    """The trend, segment by segment; times ascend. Segments shorter than a least window raise."""
    cuts = np.flatnonzero(np.diff(t) > gap) + 1
    return np.concatenate([detrend_segment(part, window, order, rounds, lower) for part in np.split(flux, cuts) if len(part)] or [np.zeros(0)])


def detrend(t: np.ndarray, flux: np.ndarray, window: int = 151, order: int = 3, rounds: int = 2, lower: float = 3.0, gap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(flux over trend, trend) of ``trend``."""
    own = trend(t, flux, window, order, rounds, lower, gap)
    return flux / own, own


def clip_bounds(flux: np.ndarray, sigma: float = 5.0, rounds: int = 5, both: bool = False) -> tuple[float, float]:
    """(low, high) of the values that survive ``rounds`` of clipping about the median, above or, with ``both``, on both sides; (-inf, NaN) where NaN or infinite values leave no bounds."""
    low, high = -np.inf, np.inf
    for _ in range(rounds):
        n = len(flux)
        if not n:
            break
        middle = np.partition(flux, [(n - 1) // 2, n // 2])
        with np.errstate(invalid="ignore"):
            m, room = middle[(n - 1) // 2] / 2 + middle[n // 2] / 2, sigma * np.std(flux)
        if np.isnan(m + room):
            return -np.inf, np.nan
        low, high = max(low, m - room) if both else low, min(high, m + room)
        inside = (flux >= low) & (flux <= high)
        if inside.all():
            break
        flux = flux[inside]
    return float(low), float(high)


def clip_upper(flux: np.ndarray, sigma: float = 5.0, rounds: int = 5) -> np.ndarray:
    """Which values survive upper clipping about the median."""
    keep = np.ones(len(flux), bool)
    for _ in range(rounds):
        now = flux[keep]
        if not len(now):
            break
        new = keep & (flux - np.median(now) <= sigma * np.std(now))
        if (new == keep).all():
            break
        keep = new
    return keep


def weights(flux: np.ndarray, errors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    w = np.full(len(flux), 1 / max(len(flux), 1)) if errors is None else errors**-2.0 / np.sum(errors**-2.0)
    return flux - np.sum(w * flux), w


def phase_bins(t: np.ndarray, period: float, n_bins: int) -> np.ndarray:
    return np.minimum((np.mod(t, period) / period * n_bins).astype(np.int64), n_bins - 1)


def histogram(t: np.ndarray, x: np.ndarray, w: np.ndarray, period: float, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    b = phase_bins(t, period, n_bins)
    return np.bincount(b, w * x, n_bins), np.bincount(b, w, n_bins)


class Ordered:
    """A curve by time with running sums, so that sums of phase bins come from where bins begin in each cycle.

    A period then takes as many steps as it has bins in all its cycles, however many points there are. A time so near to a
    bin's beginning that rounding decides goes where its own phase says, so bins hold just the points they'd hold one by one.
    """

    def __init__(self, t: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        self.t, self.x, self.w = t, x, w
        # without an order of phases within cycles, or with sums that one value spoils, points are taken one by one
        self.sound = bool(len(t) and t[0] >= 0 and np.isfinite(t).all() and np.isfinite(x).all() and np.isfinite(w).all())
        if self.sound:
            new = np.flatnonzero(np.concatenate([[True], np.diff(t) > 0]))
            self.at, self.first = t[new], np.append(new, len(t))
            self.sums = {"x": running(x), "w": running(w), "wx": running(w * x)}

    def begins(self, period: float, offsets: np.ndarray, bins: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
        """The first point of each bin of each cycle (cycles x bins), and the number of points; None where points are fewer than that work.

        ``offsets``: where bins begin, in days after the cycle does; ``bins``: the bin of a time in its cycle.
        """
        n = len(offsets)
        if not self.sound or n * (self.at[-1] - self.at[0] + period) / period > len(self.t) / 2:
            return None
        low, high = (np.rint((v - np.mod(v, period)) / period) for v in (self.at[0], self.at[-1]))
        edges = ((low + np.arange(int(high - low) + 1))[:, None] * period + offsets).ravel()
        place, last = np.searchsorted(self.at, edges), len(self.at)
        room = 64 * np.finfo(float).eps * (self.at[-1] + period)
        after, before = self.at[np.minimum(place, last - 1)] - edges, edges - self.at[np.maximum(place - 1, 0)]
        near = np.flatnonzero((np.abs(after) <= room) | (np.abs(before) <= room))

        def number(v: np.ndarray) -> np.ndarray:
            own = np.mod(v, period)
            return (np.rint((v - own) / period) - low) * n + bins(own)

        while len(near):
            here = place[near]
            back = (here > 0) & (number(self.at[np.maximum(here - 1, 0)]) >= near)
            on = ~back & (here < last) & (number(self.at[np.minimum(here, last - 1)]) < near)
            place[near] = here + on - back
            near = near[back | on]
        return np.append(self.first[place], len(self.t))

    def counts(self, begins: np.ndarray, n: int) -> np.ndarray:
        return np.diff(begins).reshape(-1, n).sum(axis=0)

    def totals(self, name: str, begins: np.ndarray, n: int) -> np.ndarray:
        return np.diff(self.sums[name][begins]).reshape(-1, n).sum(axis=0)

    def phase_begins(self, period: float, n_bins: int) -> np.ndarray | None:
        """``begins`` of ``phase_bins``."""
        return self.begins(period, np.arange(n_bins) / n_bins * period, lambda own: np.minimum((own / period * n_bins).astype(np.int64), n_bins - 1))

    def histogram(self, period: float, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
        """As the function of that name."""
        begins = self.phase_begins(period, n_bins)
        if begins is None:
            return histogram(self.t, self.x, self.w, period, n_bins)
        return self.totals("wx", begins, n_bins), self.totals("w", begins, n_bins)


def running(v: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values (rows), added up in more digits than they are kept in."""
    return np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, axis=0, dtype=np.longdouble).astype(float)])


def widths(min_fraction: float, max_fraction: float, n_bins: int) -> range:
    lo = max(1, int(np.floor(min_fraction * n_bins)))
    hi = min(max(lo + 1, int(np.ceil(max_fraction * n_bins))), n_bins // 2)
    return range(lo, hi + 1)


def best_window(s: np.ndarray, r: np.ndarray, spans: range, dips: bool) -> tuple[int, int, float, float, float] | None:
    """(start, width, s, r, score) of the window of largest s^2 / (r (1 - r)); ties, within 1e-10 of it, to the narrower, then the earlier.

    ``dips``: windows of positive s (brightenings) don't count.
    """
    n = len(s)
    wide = np.arange(spans.start, spans.stop)[:, None]
    if not len(wide):
        return None
    ps, pr = (np.concatenate([[0.0], np.cumsum(np.concatenate([v, v]))]) for v in (s, r))
    end = wide + np.arange(n)
    ws, wr = ps[end] - ps[:n], pr[end] - pr[:n]
    ok = (wr > 1e-12) & (wr < 1 - 1e-12)
    if dips:
        ok &= ws < 0
    score = np.divide(ws * ws, wr * (1 - wr), out=np.full(ws.shape, -1.0), where=ok)
    top = score.max()
    if top < 0:
        return None
    row, i = divmod(int(np.argmax(score >= top * (1 - 1e-10))), n)
    return i, int(wide[row, 0]), float(ws[row, i]), float(wr[row, i]), float(score[row, i])


def best_dip(x: np.ndarray, count: np.ndarray, spans: np.ndarray) -> tuple[int, int, float, float] | None:
    """(start, which span, depth, snr) of the circular run of bins of the best depth / sqrt(1 / n inside + 1 / n outside).

    ``x`` and ``count``: sums of flux, less its mean, and numbers of points by bin. Only dips count.
    """
    n, total, every = len(x), x.sum(), count.sum()
    spans = spans[:, None]
    turns = -(-int(spans.max()) // n) + 1
    px, pc = (np.concatenate([[0.0], np.cumsum(np.tile(v, turns))]) for v in (x, count))
    end = spans + np.arange(n)
    s_in, n_in = px[end] - px[:n], pc[end] - pc[:n]
    ok = (n_in > 0) & (n_in < every) & (spans < n)
    n_out = np.where(ok, every - n_in, 1)
    n_in = np.where(ok, n_in, 1)
    depth = (total - s_in) / n_out - s_in / n_in
    snr = np.where(ok & (depth > 0), depth / np.sqrt(1 / n_in + 1 / n_out), -1.0)
    k, i = divmod(int(np.argmax(np.round(snr, 9))), n)
    return None if snr[k, i] < 0 else (i, k, float(depth[k, i]), float(snr[k, i]))


def hashed_order(n: int, k: int, seed: int = 1) -> np.ndarray:
    """The places of n points in the order of shuffle ``k``: by a hash of the place, ties by the place itself. SQL can give the same."""
    salt, mask = (seed * 1009 + k) * 7919, (1 << 31) - 1
    place = np.arange(n, dtype=np.int64)
    x = place * 69069 & mask
    for _ in range(3):
        x = x * 1103515245 + (12345 + salt) & mask
        x ^= x >> 15
    # a hash has 31 bits, so both fit a number, and its plain order is by hash and place
    return np.sort(x << 32 | place) & ((1 << 32) - 1) if n < 1 << 32 else np.argsort(x, kind="stable")


def best_scores(s: np.ndarray, r: np.ndarray, spans: range, dips: bool = False) -> np.ndarray:
    """The largest score of ``best_window`` for each column of ``s`` (bins x shuffles), 0 where no window has one."""
    n, wide = len(r), max(spans, default=0)
    ps, pr = (np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(np.concatenate([v, v[:wide]]), axis=0)]) for v in (s, r))
    best, now = np.zeros(s.shape[1]), np.empty(s.shape)
    for w in spans:
        inside = pr[w : w + n] - pr[:n]
        ok = (inside > 1e-12) & (inside < 1 - 1e-12)
        scale = np.divide(1.0, inside * (1 - inside), out=np.zeros(n), where=ok)
        np.subtract(ps[w : w + n], ps[:n], out=now)
        if dips:
            np.minimum(now, 0.0, out=now)
        np.multiply(now, now, out=now)
        np.multiply(now, scale[:, None], out=now)
        np.maximum(best, now.max(axis=0), out=best)
    return best


def shuffled_best(t: np.ndarray, flux: np.ndarray, orders: list[np.ndarray | Callable[[], np.ndarray]], periods: np.ndarray, spans: list[range], n_bins: int, errors: np.ndarray | None = None, dips: bool = False, most: int | None = None) -> np.ndarray:
    """The best score of each shuffle of the flux over all periods; times and errors stay where they are.

    A period's bins are found once for all shuffles. Where points are many, its sums come from running sums of the shuffled
    flux at the beginnings of its bins (``Ordered``), else they are one product of the (bins x points) matrix of the period,
    which has a single one in each column, with the (points x shuffles) matrix: rows in order of bins, summed run by run.
    """
    _, w = weights(flux, errors)
    curve = Ordered(t, flux, w)
    cuts = [curve.phase_begins(period, n_bins) for period in periods]
    best = np.zeros(len(orders))
    for first in range(0, len(orders), most := most or len(orders)):
        moved = flux[np.array([order() if callable(order) else order for order in orders[first : first + most]])]
        moved = np.ascontiguousarray(((moved - (moved @ w)[:, None]) * w).T)
        ahead = running(moved) if any(c is not None for c in cuts) else None
        top = best[first : first + most]
        for period, wide, begins in zip(periods, spans, cuts, strict=True):
            if begins is not None:
                s = np.diff(ahead[begins], axis=0).reshape(-1, n_bins, moved.shape[1]).sum(axis=0)
                r = curve.totals("w", begins, n_bins)
            else:
                bins = phase_bins(t, period, n_bins)
                by_bin = np.argsort(bins, kind="stable")
                filled, starts = np.unique(bins[by_bin], return_index=True)
                s = np.zeros((n_bins, moved.shape[1]))
                s[filled] = np.add.reduceat(moved[by_bin], starts, axis=0)
                r = np.bincount(bins, w, n_bins)
            np.maximum(top, best_scores(s, r, wide, dips), out=top)
    return best


def duration_fractions(period: float, min_duration: float, max_duration: float) -> tuple[float, float]:
    lo = min(max(min_duration / period, 0.005), 0.5)
    return lo, max(lo + 0.005, min(max_duration / period, 0.5))


def period_grid(baseline: float, min_duration: float, max_duration: float, min_period: float | None = None, max_period: float | None = None, transits: int = 3, factor: float = 1.0) -> np.ndarray:
    """Periods, uniform in frequency with step factor * min_duration / baseline^2, ascending."""
    if min_period is None:
        min_period = 2 * max_duration
    if max_period is None:
        if transits <= 1:
            raise ValueError("transits must be more than 1")
        max_period = baseline / (transits - 1)
    low, high, step = 1 / max_period, 1 / min_period, factor * min_duration / baseline**2
    periods = 1 / (low + step * np.arange(int(np.ceil((high - low) / step)) + 1)) if high >= low else np.zeros(0)
    return np.sort(periods[(periods >= min_period) & (periods <= max_period)])


FIT_FIELDS = ("period", "start", "width", "phase_start", "phase_width", "duration_days", "s", "r", "l", "h", "depth", "sr")


def fit(i: int, period: float, s: np.ndarray, r: np.ndarray, min_duration: float, max_duration: float, dips: bool = False) -> tuple | None:
    """Place ``i`` and FIT_FIELDS of the best box of a period's histogram, if it has one."""
    n_bins = len(s)
    found = best_window(s, r, widths(*duration_fractions(period, min_duration, max_duration), n_bins), dips)
    if found is None:
        return None
    start, width, bs, br, sr = found
    low, high = bs / br, -bs / (1 - br)
    return i, float(period), start, width, start / n_bins, width / n_bins, width / n_bins * period, bs, br, low, high, high - low, sr


def search(t: np.ndarray, flux: np.ndarray, periods: np.ndarray, n_bins: int, min_duration: float, max_duration: float, errors: np.ndarray | None = None, dips: bool = False) -> list[tuple]:
    """FIT_FIELDS of the best box of each period that has one, after its place in ``periods``."""
    x, w = weights(flux, errors)
    found = (fit(i, period, *histogram(t, x, w, period, n_bins), min_duration, max_duration, dips) for i, period in enumerate(periods))
    return [f for f in found if f]


def in_window(phase: np.ndarray, start: float, width: float, padding: float) -> np.ndarray:
    a, b = start - padding, start + width + padding
    if b > 1:
        return (phase >= a) | (phase < b - 1)
    if a < 0:
        return (phase >= a + 1) | (phase < b)
    return (phase >= a) & (phase < b)


def detrend_masked(t: np.ndarray, flux: np.ndarray, window: int = 151, n_bins: int = 200, padding: float = 0.01, min_period: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Detrending that leaves the strongest box out of the trend, and bridges it."""
    flat, trend = detrend(t, flux, window)
    baseline = t.max() - t.min()
    fits = search(t, flat, period_grid(baseline, 0.05, 0.3, min_period, baseline / 3), n_bins, 0.05, 0.3)
    best = max(fits, key=lambda f: (f[-1], -f[0]), default=None)
    if best is None or best[-1] < 1e-6:
        return flat, trend
    return detrend_around(t, flux, (best[1], best[4], best[5]), window, padding) or (flat, trend)


def detrend_around(t: np.ndarray, flux: np.ndarray, box: tuple[float, float, float], window: int = 151, padding: float = 0.01) -> tuple[np.ndarray, np.ndarray] | None:
    """Detrending that leaves a (period, start, width) out; None if less than a window is left."""
    period, start, width = box
    out = ~in_window(np.mod(t, period) / period, start, width, padding)
    if out.sum() < window:
        return None
    _, clean = detrend(t[out], flux[out], window)
    full = np.interp(t, t[out], clean)
    return flux / full, full
