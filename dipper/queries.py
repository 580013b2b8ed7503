"""The library's queries over the driver's tables, and DuckDB SQL that gives the same rows.

Statistics are rounded to 6 digits on both sides; inputs are whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipper.functions.phase import in_circular_box, in_plain_box, in_window, start_phase
from dipper.functions.scores import checks, erfc_sql, false_alarm, finite
from dipper.operators import bls, boxes, crosscheck, photometry, report, vetting
from dipper.operators import detrend as detrending
from dipper.operators import lightcurve as lcs
from dipper.plans import pipeline
from dipper.sources import fits, store, synthetic
from dipper.sources.adapters import event_times, light_curves, pixels, user_light_curves
from dipper.streaming import jobs, landing

PERIOD = 5.0
N_PERIODS, N_BINS, WIDEST, THRESHOLD = 64, 100, 8, 1.0
SIGMAS = (0.5, 1.0, 1.5, 2.0, 2.5)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Some columns to 6 digits, with no negative zero."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# --- shared pieces of SQL ---

_LC = """
lc AS (SELECT event_type AS target, (epoch_us(ts) - 1704067200000000) / 8.64e10::DOUBLE AS t, value AS flux,
              (CAST(json_extract_string(props, '$.k') AS BIGINT) & 3)::INTEGER AS quality FROM events)"""
_USER = _LC.replace("event_type", "user_id::VARCHAR")
_XW = "xw AS (SELECT target, t, flux - avg(flux) OVER (PARTITION BY target) AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY target) AS w FROM lc)"
_HIST = f"""
grid AS (SELECT i AS pid, 1 / (0.1::DOUBLE + 0.01::DOUBLE * i) AS period FROM range({N_PERIODS}) r(i)),
sums AS (SELECT target, pid, least(floor((t % period) / period * {N_BINS}), {N_BINS - 1})::INTEGER AS bin, sum(w * x) AS s, sum(w) AS r
         FROM xw, grid GROUP BY ALL),
hist AS (SELECT g.target, g.pid, b.bin, coalesce(s, 0) AS s, coalesce(r, 0) AS r
         FROM (SELECT DISTINCT target, pid FROM sums) g CROSS JOIN (SELECT i::INTEGER AS bin FROM range({N_BINS}) r(i)) b
         LEFT JOIN sums USING (target, pid, bin))"""
_PREFIX = f"""
twice AS (SELECT * FROM hist UNION ALL SELECT target, pid, bin + {N_BINS}, s, r FROM hist WHERE bin < {WIDEST}),
prefix AS (SELECT target, pid, bin + 1 AS k, sum(s) OVER o AS pf, sum(r) OVER o AS pr FROM twice
           WINDOW o AS (PARTITION BY target, pid ORDER BY bin ROWS UNBOUNDED PRECEDING)
           UNION ALL SELECT DISTINCT target, pid, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM hist)"""


def _power(dips: bool = False) -> str:
    return f"""
box AS (SELECT a.target, a.pid, a.k AS start, w.w AS width, b.pf - a.pf AS s, b.pr - a.pr AS r
        FROM prefix a, (SELECT i::INTEGER AS w FROM range(1, {WIDEST + 1}) q(i)) w JOIN prefix b ON true
        WHERE a.target = b.target AND a.pid = b.pid AND b.k = a.k + w.w AND a.k < {N_BINS}),
scored AS (SELECT *, round(s * s / (r * (1 - r)), 6) AS sr FROM box WHERE r > 1e-12 AND r < 1 - 1e-12 {"AND s < 0" * dips}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY target, pid ORDER BY sr DESC, width, start) = 1),
power AS (SELECT target, pid, period, start, width, s, r, -s / (1 - r) - s / r AS depth, sr FROM best JOIN grid USING (pid)),
sde AS (SELECT *, CASE WHEN d > 0 THEN (sr - m) / d ELSE 0 END AS sde
        FROM (SELECT *, avg(sr) OVER (PARTITION BY target) AS m, stddev_pop(sr) OVER (PARTITION BY target) AS d FROM power))"""


_NEAR = " OR ".join(f"abs(period / k - {h!r}::DOUBLE) < 0.02::DOUBLE * {h!r}::DOUBLE" for h in bls.HARMONICS)
_PEAKS = f"""
around AS (SELECT *, lag(sde) OVER o AS before, lead(sde) OVER o AS after, row_number() OVER o AS place FROM sde
           WINDOW o AS (PARTITION BY target ORDER BY period)),
peaks AS (SELECT target, pid, period, start, width, s, r, depth, sr, sde,
                 (row_number() OVER (PARTITION BY target ORDER BY sde DESC, CASE WHEN before IS NULL THEN 1 WHEN after IS NULL THEN 2 ELSE 0 END, place))::INTEGER AS peak_rank
          FROM around WHERE sde > {THRESHOLD} AND (before IS NULL OR sde > before) AND (after IS NULL OR sde > after))"""
_HARMONIC = f"""
chain AS (
  SELECT target, peak_rank, [period] AS kept, false AS is_harmonic FROM peaks WHERE peak_rank = 1
  UNION ALL
  SELECT target, peak_rank, CASE WHEN near THEN kept ELSE list_append(kept, period) END, near FROM (
    SELECT p.target, p.peak_rank, p.period, c.kept, len(list_filter(c.kept, lambda k: {_NEAR.replace("period", "p.period")})) > 0 AS near
    FROM chain c JOIN peaks p ON p.target = c.target AND p.peak_rank = c.peak_rank + 1)),
cands AS (SELECT p.*, is_harmonic, start / {N_BINS}::DOUBLE AS phase_start, width / {N_BINS}::DOUBLE AS phase_width, width / {N_BINS}::DOUBLE * period AS duration_days
          FROM peaks p JOIN chain USING (target, peak_rank))"""
_VET = """
hits AS (SELECT c.target, c.peak_rank, flux, floor(t / period)::BIGINT % 2 AS odd, least(floor((t % period) / period * 400), 399)::INTEGER AS b,
                floor(phase_start * 400)::INTEGER AS b0, floor(phase_width * 400)::INTEGER AS bw, floor(((phase_start + 0.5) % 1.0) * 400)::INTEGER AS b2
         FROM cands c JOIN lc USING (target)),
flags AS (SELECT *, CASE WHEN b0 + bw <= 400 THEN b >= b0 AND b < b0 + bw ELSE b >= b0 OR b < b0 + bw - 400 END AS p,
                 CASE WHEN b2 + bw <= 400 THEN b >= b2 AND b < b2 + bw ELSE b >= b2 OR b < b2 + bw - 400 END AS q FROM hits),
depths AS (SELECT target, peak_rank,
    abs(avg(flux) FILTER (WHERE odd = 1 AND NOT p) - avg(flux) FILTER (WHERE odd = 1 AND p)) AS depth_odd,
    abs(avg(flux) FILTER (WHERE odd = 0 AND NOT p) - avg(flux) FILTER (WHERE odd = 0 AND p)) AS depth_even,
    abs(avg(flux) FILTER (WHERE NOT q) - avg(flux) FILTER (WHERE q)) AS secondary_depth FROM flags GROUP BY ALL),
tests AS (SELECT c.*, depth_odd, depth_even, secondary_depth,
    coalesce(abs(depth_odd - depth_even) / nullif(abs((depth_odd + depth_even) / 2), 0) / 0.1::DOUBLE, 0) AS sigma, coalesce(secondary_depth / nullif(abs(depth), 0), 0) AS ratio
    FROM cands c LEFT JOIN depths USING (target, peak_rank)),
vetted AS (SELECT *, CASE WHEN NOT is_harmonic THEN sigma END AS odd_even_diff_sigma, CASE WHEN NOT is_harmonic AND sigma <= 3 THEN ratio END AS secondary_ratio,
    CASE WHEN is_harmonic THEN 'REJECTED (Harmonic Alias)' WHEN sigma > 3 THEN 'REJECTED (Odd/Even Mismatch)' WHEN ratio > 0.1 THEN 'REJECTED (Secondary Eclipse)' ELSE 'PASSED' END AS status FROM tests)"""
_CHAIN = f"WITH RECURSIVE {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()}, {_PEAKS}, {_HARMONIC}, {_VET}"
_PIXELS = """
pixels AS (SELECT label::VARCHAR AS target, vec_id AS cadence, ((i - 1) // 8)::INTEGER AS row, ((i - 1) % 8)::INTEGER AS col, px::DOUBLE AS px
           FROM (SELECT label, vec_id, unnest(embedding) AS px, generate_subscripts(embedding, 1) AS i FROM embeddings)),
image AS (SELECT target, row, col, avg(px) AS value FROM pixels GROUP BY ALL),
seed AS (SELECT * FROM image QUALIFY row_number() OVER (PARTITION BY target ORDER BY value DESC, row, col) = 1),
background AS (SELECT i.target, median(i.value) AS background FROM image i JOIN seed s USING (target)
               WHERE sqrt((i.row - s.row) ** 2 + (i.col - s.col) ** 2) BETWEEN 3 AND 5 GROUP BY ALL)"""
_APERTURE = f"""
level AS (SELECT target, sigma, background + sigma * spread AS threshold FROM background JOIN (SELECT target, stddev_pop(value) AS spread FROM image GROUP BY ALL) USING (target),
          (SELECT unnest({list(SIGMAS)})::DOUBLE AS sigma)),
mask AS (
  SELECT target, sigma, row, col FROM seed JOIN level USING (target) WHERE value >= threshold
  UNION
  SELECT i.target, l.sigma, i.row, i.col FROM mask m JOIN image i ON i.target = m.target AND abs(i.row - m.row) <= 1 AND abs(i.col - m.col) <= 1
  JOIN level l ON l.target = m.target AND l.sigma = m.sigma WHERE i.value >= l.threshold),
flux AS (SELECT target, sigma, cadence, sum(px - background) AS flux FROM pixels JOIN mask USING (target, row, col) JOIN background USING (target) GROUP BY ALL)"""


# --- light curves ---


@query(f"WITH {_LC} SELECT * FROM lc WHERE quality = 0")
def lc_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcs.filter_quality(light_curves(spark, sf_dir))


@query(f"WITH {_LC} SELECT target, t, flux FROM (SELECT target, t, CASE WHEN quality = 0 THEN 'NaN'::DOUBLE ELSE flux END AS flux FROM lc) WHERE NOT isnan(flux)")
def lc_nan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = light_curves(spark, sf_dir).withColumn("flux", F.when(F.col("quality") == 0, float("nan")).otherwise(F.col("flux")))
    return lcs.filter_nan(lc).select("target", "t", "flux")


@query(f"WITH {_LC} SELECT target, t, {_r('flux / m')} AS flux FROM lc JOIN (SELECT target, median(flux) AS m FROM lc GROUP BY 1) USING (target)")
def lc_normalize_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.normalize_median(light_curves(spark, sf_dir)), "flux").select("target", "t", "flux")


@query(f"WITH {_LC} SELECT target, t, {_r('flux / m')} AS flux FROM lc JOIN (SELECT target, list_sort(list(flux))[count(*) // 2 + 1] AS m FROM lc GROUP BY 1) USING (target)")
def lc_normalize_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.normalize_upper_median(light_curves(spark, sf_dir)), "flux").select("target", "t", "flux")


@query(f"WITH {_LC}, {_XW} SELECT target, t, round(x, 6) + 0.0 AS x, round(w, 9) AS w FROM xw")
def lc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.with_weights(light_curves(spark, sf_dir)), "x").select("target", "t", "x", F.round("w", 9).alias("w"))


@query(f"""WITH {_LC}, e AS (SELECT *, 1 / (1 + quality) ** 2 AS v FROM lc)
SELECT target, t, round(v / sum(v) OVER o, 9) AS w, {_r('flux - sum(v * flux) OVER o / sum(v) OVER o')} AS x FROM e WINDOW o AS (PARTITION BY target)""")
def lc_error_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = light_curves(spark, sf_dir).withColumn("error", 1.0 + F.col("quality"))
    return rounded(lcs.with_weights(lc, "error"), "x").select("target", "t", F.round("w", 9).alias("w"), "x")


@query(f"WITH {_LC} SELECT target, t, {_r(f'(t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE')} AS phase FROM lc")
def lc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.fold(light_curves(spark, sf_dir), PERIOD), "phase").select("target", "t", "phase")


@query(f"WITH {_LC} SELECT target, t, {_r(f'(t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE')} AS phase, {_r('flux')} AS display FROM lc")
def lc_display_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.display_flux(lcs.fold(light_curves(spark, sf_dir), PERIOD)), "phase", "display").select("target", "t", "phase", "display")


@query(f"WITH {_LC} SELECT target, (floor(t / 2.5::DOUBLE)::BIGINT % 2)::INTEGER AS parity, count(*) AS n, {_r('avg(flux)')} AS mean_flux FROM lc GROUP BY ALL")
def lc_epoch_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lcs.with_parity(light_curves(spark, sf_dir), 2.5).groupBy("target", "parity").agg(F.count(F.lit(1)).alias("n"), F.avg("flux").alias("mean_flux"))
    return rounded(own, "mean_flux")


@query(f"WITH {_LC} SELECT target, count(*) AS n, {_r('max(t) - min(t)')} AS baseline FROM lc GROUP BY ALL")
def lc_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.baselines(light_curves(spark, sf_dir)), "baseline")


@query(f"""WITH {_LC}, m AS (SELECT target, median(flux) AS m FROM lc GROUP BY 1)
SELECT target, {_r('any_value(m)')} AS signal, {_r('stddev_pop(flux)')} AS noise, {_r('any_value(m) / stddev_pop(flux)')} AS snr, {_r('sqrt(avg((flux - m) ** 2))')} AS rms
FROM lc JOIN m USING (target) GROUP BY target""")
def lc_snr_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.snr_and_rms(light_curves(spark, sf_dir)), "signal", "noise", "snr", "rms")


@query(f"""WITH {_USER}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY target ORDER BY t, flux) > 0.5 THEN 1 ELSE 0 END AS n FROM lc)
SELECT target, t, flux, (sum(n) OVER (PARTITION BY target ORDER BY t, flux ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM g""")
def lc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcs.segments(user_light_curves(spark, sf_dir)).select("target", "t", "flux", "segment")


_SG = " + ".join(f"{c!r}::DOUBLE * " + (f"lag(flux, {-i}) OVER o" if i < 0 else f"lead(flux, {i}) OVER o" if i else "flux") for i, c in zip(range(-75, 76), lcs.savgol_coefficients(151), strict=True))


@query(f"""WITH {_LC}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY target ORDER BY t, flux) > 0.5 THEN 1 ELSE 0 END AS n FROM lc),
s AS (SELECT *, sum(n) OVER (PARTITION BY target ORDER BY t, flux ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT target, t, {_r(f'({_SG})')} AS smooth FROM s WINDOW o AS (PARTITION BY target, segment ORDER BY t, flux)""")
def lc_savgol_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detrending.smooth(light_curves(spark, sf_dir)).withColumn("smooth", F.when(F.col("interior"), F.col("smooth")))
    return rounded(found, "smooth").select("target", "t", "smooth")


@query(f"""WITH {_LC}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY target ORDER BY t, flux) > 0.02 THEN 1 ELSE 0 END AS b FROM lc),
s AS (SELECT *, sum(b) OVER (PARTITION BY target ORDER BY t, flux ROWS UNBOUNDED PRECEDING) AS segment FROM g),
r AS (SELECT target, t, flux, segment, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY target, segment) AS n FROM s WINDOW o AS (PARTITION BY target, segment ORDER BY t, flux)),
x AS (SELECT i, (i - 7)::DOUBLE AS x FROM range(15) q(i)),
p AS (SELECT i, 1.0::DOUBLE AS p0, x AS p1, x * x - 56.0::DOUBLE / 3 AS p2, x * x * x - x * 167 / 5.0::DOUBLE AS p3 FROM x),
norm AS (SELECT sum(p0 * p0) AS n0, sum(p1 * p1) AS n1, sum(p2 * p2) AS n2, sum(p3 * p3) AS n3 FROM p),
hat AS (SELECT a.i AS spot, b.i AS of, a.p0 * b.p0 / n0 + a.p1 * b.p1 / n1 + a.p2 * b.p2 / n2 + a.p3 * b.p3 / n3 AS c FROM p a, p b, norm),
place AS (SELECT *, CASE WHEN i < 7 THEN i WHEN i >= n - 7 THEN i - n + 15 ELSE 7 END AS spot, CASE WHEN i < 7 THEN 0 WHEN i >= n - 7 THEN n - 15 ELSE i - 7 END AS first FROM r),
fit AS (SELECT p.target, p.segment, p.i, sum(h.c * y.flux) AS smooth FROM place p JOIN hat h USING (spot) JOIN r y ON y.target = p.target AND y.segment = p.segment AND y.i = p.first + h.of WHERE p.n >= 15 GROUP BY ALL)
SELECT r.target, t, r.segment::BIGINT AS segment, {_r('smooth')} AS smooth FROM r LEFT JOIN fit USING (target, segment, i)""")
def lc_savgol_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 15 over runs without a gap of half an hour, with both ends of each."""
    return rounded(detrending.smooth(light_curves(spark, sf_dir), 15, gap=0.02), "smooth").select("target", "t", "segment", "smooth")


def _clip_sql(rounds: int, sigma: float) -> str:
    out, last = [f"WITH {_LC}"], "lc"
    for i in range(rounds):
        out.append(f"c{i} AS (SELECT l.* FROM {last} l JOIN (SELECT target, median(flux) AS m, stddev_pop(flux) AS s FROM {last} GROUP BY 1) USING (target) WHERE flux - m <= {sigma} * s)")
        last = f"c{i}"
    return ", ".join(out) + f" SELECT target, t, flux FROM {last}"


@query(_clip_sql(5, 2.0))
def lc_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcs.clip_upper(light_curves(spark, sf_dir), 2.0).select("target", "t", "flux")


@query(f"""WITH {_LC}, k AS (SELECT target, t, CASE WHEN quality <> 0 THEN flux END AS flux FROM lc),
n AS (SELECT *, max(CASE WHEN flux IS NOT NULL THEN t END) OVER (PARTITION BY target ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0,
             min(CASE WHEN flux IS NOT NULL THEN t END) OVER (PARTITION BY target ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM k)
SELECT n.target, n.t, {_r('CASE WHEN n.flux IS NOT NULL THEN n.flux WHEN n.t0 IS NULL THEN b.flux WHEN n.t1 IS NULL THEN a.flux ELSE a.flux + (b.flux - a.flux) * (n.t - a.t) / (b.t - a.t) END')} AS filled
FROM n LEFT JOIN k a ON a.target = n.target AND a.t = n.t0 LEFT JOIN k b ON b.target = n.target AND b.t = n.t1""")
def lc_interp_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = light_curves(spark, sf_dir).select("target", "t", F.when(F.col("quality") != 0, F.col("flux")).alias("flux"))
    return rounded(lcs.interpolate_pairs(lc), "filled").select("target", "t", "filled")


@query(f"""WITH {_LC} SELECT target, count(*) FILTER (WHERE least(abs(p - 0.97), 1 - abs(p - 0.97)) <= 0.05) AS in_circular, count(*) FILTER (WHERE abs(p - 0.97) < 0.05) AS in_plain,
count(*) FILTER (WHERE p >= 0.94::DOUBLE OR p < 0.06::DOUBLE) AS in_wrapped, count(*) FILTER (WHERE isfinite(flux)) AS n_finite, {_r('any_value(((3.0 - 0.2 / 2) % 5.0) / 5.0)')} AS begins
FROM (SELECT target, flux, (t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE AS p FROM lc) GROUP BY target""")
def phase_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = lcs.fold(light_curves(spark, sf_dir), PERIOD)
    p, c = F.col("phase"), F.lit(0.97)
    count = lambda x, n: F.count(F.when(x, 1)).alias(n)
    own = lc.groupBy("target").agg(count(in_circular_box(p, c, F.lit(0.1)), "in_circular"), count(in_plain_box(p, c, F.lit(0.1)), "in_plain"), count(in_window(p, F.lit(0.95), F.lit(0.1)), "in_wrapped"), count(finite(F.col("flux")), "n_finite"), F.first(start_phase(F.lit(3.0), F.lit(0.2), F.lit(5.0))).alias("begins"))
    return rounded(own, "begins")


@query(f"""WITH {_LC} SELECT target, bin, {_r('(bin + 0.5) / 100')} AS center, {_r('m')} AS mean_flux
FROM (SELECT DISTINCT target FROM lc) CROSS JOIN (SELECT i::INTEGER AS bin FROM range(100) r(i))
LEFT JOIN (SELECT target, floor((t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE * 100)::INTEGER AS bin, avg(flux) AS m FROM lc GROUP BY ALL) USING (target, bin)""")
def phase_bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.bin_mean(lcs.fold(light_curves(spark, sf_dir), PERIOD)), "center", "mean_flux")


@query(f"""WITH {_LC}, p AS (SELECT target, flux, (t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE AS p FROM lc),
e AS (SELECT *, min(p) OVER (PARTITION BY target) AS a, max(p) OVER (PARTITION BY target) AS b FROM p)
SELECT target, least(floor((p - a) / (b - a) * 50), 49)::INTEGER AS bin, {_r('median(flux)')} AS median_flux FROM e GROUP BY ALL""")
def phase_bin_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lcs.bin_median(lcs.fold(light_curves(spark, sf_dir), PERIOD), lcs.display_bins(0.5, PERIOD)), "median_flux")


# --- box search ---


@query(f"""WITH {_LC}, b AS (SELECT target, max(t) - min(t) AS baseline FROM lc GROUP BY 1),
s AS (SELECT *, 0.1::DOUBLE / (baseline * baseline) AS step FROM b),
g AS (SELECT target, 1 / (1 / 10.0::DOUBLE + step * i) AS period FROM s, LATERAL (SELECT unnest(range(0, ceil((0.5::DOUBLE - 1 / 10.0::DOUBLE) / step)::BIGINT + 1)) AS i))
SELECT target, row_number() OVER (PARTITION BY target ORDER BY period) - 1 AS pid, {_r('period')} AS period FROM g WHERE period BETWEEN 2 AND 10""")
def period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bls.period_grid(lcs.baselines(light_curves(spark, sf_dir)), 0.1, 0.3, 2.0, 10.0), "period")


@query(f"""WITH {_LC}, b AS (SELECT target, max(t) - min(t) AS baseline FROM lc GROUP BY 1),
s AS (SELECT *, 0.05::DOUBLE / (baseline * baseline) AS step, baseline / 2 AS longest FROM b),
g AS (SELECT target, longest, 1 / (1 / longest + step * i) AS p FROM s, LATERAL (SELECT unnest(range(0, ceil((1 / 0.5::DOUBLE - 1 / longest) / step)::BIGINT + 1)) AS i)),
w AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY p) - 1 AS pid, p, least(greatest(0.05::DOUBLE / p, 0.005), 0.5) AS lo FROM g WHERE p BETWEEN 0.5 AND longest),
h AS (SELECT *, greatest(lo + 0.005::DOUBLE, least(0.25::DOUBLE / p, 0.5)) AS hi FROM w)
SELECT target, pid, greatest(1, floor(lo * 400)::INTEGER) AS min_width, least(greatest(greatest(1, floor(lo * 400)::INTEGER) + 1, ceil(hi * 400)::INTEGER), 200) AS max_width FROM h""")
def duration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrowest and widest boxes of each period of each target's grid."""
    periods = bls.period_grid(lcs.baselines(light_curves(spark, sf_dir)), 0.05, 0.25, 0.5)
    lo = F.least(F.greatest(0.05 / F.col("period"), F.lit(0.005)), F.lit(0.5))
    hi = F.greatest(lo + 0.005, F.least(0.25 / F.col("period"), F.lit(0.5)))
    a, b = bls.duration_grid(400, lo, hi)
    return periods.select("target", "pid", a.alias("min_width"), b.alias("max_width"))


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bls.histogram(lcs.with_weights(light_curves(spark, sf_dir)), N_PERIODS, N_BINS)


@query(f"WITH {_LC}, {_XW}, {_HIST} SELECT target, pid, bin, {_r('s')} AS s, {_r('r')} AS r FROM hist")
def bls_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_hist(spark, sf_dir), "s", "r").withColumn("pid", F.col("pid").cast("long"))


@query(f"WITH {_LC}, {_XW}, {_HIST}, {_PREFIX} SELECT target, pid, k, {_r('pf')} AS pf, {_r('pr')} AS pr FROM prefix WHERE k <= {N_BINS}")
def bls_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bls.prefix_sums(_hist(spark, sf_dir)), "pf", "pr").withColumn("pid", F.col("pid").cast("long"))


@query(f"WITH {_LC}, {_XW}, {_HIST} SELECT target, pid, bin, {_r('s')} AS s, {_r('r')} AS r FROM hist")
def bls_bins_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bls.bins_of_prefix(bls.prefix_sums(_hist(spark, sf_dir))), "s", "r").withColumn("pid", F.col("pid").cast("long"))


def _power_of(spark: SparkSession, sf_dir: str, dips: bool = False) -> DataFrame:
    return bls.periodogram(light_curves(spark, sf_dir), N_PERIODS, N_BINS, 1, WIDEST, dips).withColumn("pid", F.col("pid").cast("long"))


_FIT = f"target, pid, {_r('period')} AS period, start, width, {_r('s')} AS s, {_r('r')} AS r, {_r('depth')} AS depth, {_r('sr')} AS sr"


@query(f"WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()} SELECT {_FIT} FROM power")
def bls_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_power_of(spark, sf_dir), "period", "s", "r", "depth", "sr")


@query(f"WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()} SELECT {_FIT}, s < 0 AS is_dip FROM power QUALIFY row_number() OVER (PARTITION BY target ORDER BY sr DESC, pid) = 1")
def bls_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = pipeline.flagship(light_curves(spark, sf_dir)).withColumn("pid", F.col("pid").cast("long"))
    return rounded(best, "period", "s", "r", "depth", "sr")


@query(f"WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()} SELECT target, pid, {_r('sr')} AS sr, {_r('sde')} AS sde FROM sde")
def bls_sde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bls.with_sde(_power_of(spark, sf_dir)).select("target", "pid", "sr", "sde"), "sr", "sde")


@query(f"WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power(True)} SELECT target, pid, {_r('sqrt(n * s * s / (r * (1 - r)))')} AS power FROM power JOIN (SELECT target, count(*) AS n FROM lc GROUP BY 1) USING (target)")
def bls_snr_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lcs.baselines(light_curves(spark, sf_dir)).select("target", "n")
    return rounded(bls.snr_objective(_power_of(spark, sf_dir, dips=True), counts).select("target", "pid", "power"), "power")


def _peaks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bls.peaks(bls.with_sde(_power_of(spark, sf_dir)), THRESHOLD)


@query(f"WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()}, {_PEAKS} SELECT target, pid, {_r('sde')} AS sde, peak_rank FROM peaks")
def bls_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_peaks_of(spark, sf_dir).select("target", "pid", "sde", "peak_rank"), "sde")


@query(f"{_CHAIN} SELECT target, peak_rank, {_r('period')} AS period, is_harmonic FROM cands")
def bls_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bls.flag_harmonics(_peaks_of(spark, sf_dir)).select("target", "peak_rank", "period", "is_harmonic"), "period")


_LIST = ", ".join(f"({i}, {1 / (0.1 + 0.01 * i)!r}::DOUBLE)" for i in range(N_PERIODS))


def _list_search(n: int, shortest: float, longest: float) -> str:
    """``pick``, the best box of each period of the list with n bins, from ``xw``; ties as in the kernel."""
    return f"""
grid AS (SELECT * FROM (VALUES {_LIST}) v(pid, period)),
sums AS (SELECT target, pid, least(floor((t % period) / period * {n}), {n - 1})::INTEGER AS bin, sum(w * x) AS s, sum(w) AS r FROM xw, grid GROUP BY ALL),
hist AS (SELECT g.target, g.pid, b.bin, coalesce(s, 0) AS s, coalesce(r, 0) AS r FROM (SELECT DISTINCT target, pid FROM sums) g CROSS JOIN (SELECT i::INTEGER AS bin FROM range({n}) r(i)) b
         LEFT JOIN sums USING (target, pid, bin)),
twice AS (SELECT * FROM hist UNION ALL SELECT target, pid, bin + {n}, s, r FROM hist),
prefix AS (SELECT target, pid, bin + 1 AS k, sum(s) OVER o AS pf, sum(r) OVER o AS pr FROM twice WINDOW o AS (PARTITION BY target, pid ORDER BY bin ROWS UNBOUNDED PRECEDING)
           UNION ALL SELECT DISTINCT target, pid, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM hist),
spans AS (SELECT pid, period, greatest(1, floor(lo * {n})::INTEGER) AS a, least(greatest(greatest(1, floor(lo * {n})::INTEGER) + 1, ceil(hi * {n})::INTEGER), {n // 2}) AS b
  FROM (SELECT *, greatest(lo + 0.005::DOUBLE, least({longest}::DOUBLE / period, 0.5)) AS hi FROM (SELECT *, least(greatest({shortest}::DOUBLE / period, 0.005), 0.5) AS lo FROM grid))),
box AS (SELECT a.target, a.pid, p.period, a.k AS start, b.k - a.k AS width, b.pf - a.pf AS s, b.pr - a.pr AS r
  FROM prefix a JOIN spans p USING (pid) JOIN prefix b ON b.target = a.target AND b.pid = a.pid AND b.k BETWEEN a.k + p.a AND a.k + p.b WHERE a.k < {n}),
top AS (SELECT *, max(sr) OVER (PARTITION BY target, pid) AS most FROM (SELECT *, s * s / (r * (1 - r)) AS sr FROM box WHERE r > 1e-12 AND r < 1 - 1e-12)),
pick AS (SELECT * FROM top WHERE sr >= most * (1 - 1e-10::DOUBLE) QUALIFY row_number() OVER (PARTITION BY target, pid ORDER BY width, start) = 1)"""


@query(f"""WITH {_LC}, {_XW}, {_list_search(N_BINS, 0.05, 0.25)}
SELECT target, pid::BIGINT AS pid, {_r('period')} AS period, start::INTEGER AS start, width::INTEGER AS width, {_r('-s / (1 - r) - s / r')} AS depth, {_r('sr')} AS sr FROM pick""")
def bls_search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.range(N_PERIODS).select(F.col("id").alias("pid"), bls.explicit_period(F.col("id")).alias("period"))
    found = bls.search(lcs.filter_nan(light_curves(spark, sf_dir)), periods, N_BINS, 0.05, 0.25)
    return rounded(found.select("target", "pid", "period", "start", "width", "depth", "sr"), "period", "depth", "sr")


_LIVE = [1.7, 2.3, 3.1, 4.4, 5.0, 6.2, 8.1, 9.7]
_LIVE_LIST = ", ".join(f"({i}, {p!r}::DOUBLE, {math.ceil(p / 0.005)})" for i, p in enumerate(_LIVE))
_SPANS = ", ".join(f"({k}, {d!r}::DOUBLE, {max(1, round(d / 0.005))})" for k, d in enumerate(bls.DURATIONS))


@query(f"""WITH {_LC}, p AS (SELECT * FROM (VALUES {_LIVE_LIST}) v(pid, period, m)), d AS (SELECT * FROM (VALUES {_SPANS}) v(di, duration, w)),
x AS (SELECT target, t, flux - avg(flux) OVER o AS x, min(t) OVER o AS first, count(*) OVER o AS n FROM lc WINDOW o AS (PARTITION BY target)),
sums AS (SELECT target, pid, least(floor(((t - first) % period) / 0.005::DOUBLE), m - 1)::BIGINT AS b, sum(x) AS s, count(*) AS c FROM x, p GROUP BY ALL),
dense AS (SELECT g.target, p.pid, b.b, coalesce(s, 0) AS s, coalesce(c, 0) AS c FROM (SELECT DISTINCT target FROM lc) g, p, LATERAL (SELECT unnest(range(m)) AS b) b LEFT JOIN sums ON sums.target = g.target AND sums.pid = p.pid AND sums.b = b.b),
twice AS (SELECT target, pid, b, s, c FROM dense UNION ALL SELECT target, pid, b + m, s, c FROM dense JOIN p USING (pid)),
pre AS (SELECT target, pid, b + 1 AS k, sum(s) OVER o AS ps, sum(c) OVER o AS pc FROM twice WINDOW o AS (PARTITION BY target, pid ORDER BY b) UNION ALL SELECT DISTINCT target, pid, 0, 0, 0 FROM dense),
box AS (SELECT a.target, a.pid, di, a.k AS i, b.ps - a.ps AS s_in, b.pc - a.pc AS n_in FROM pre a JOIN p USING (pid) CROSS JOIN d JOIN pre b ON b.target = a.target AND b.pid = a.pid AND b.k = a.k + d.w WHERE a.k < m),
whole AS (SELECT target, any_value(first) AS first, any_value(n) AS n, sum(x) AS total FROM x GROUP BY 1),
scored AS (SELECT *, (total - s_in) / (n - n_in) - s_in / n_in AS depth FROM box JOIN whole USING (target) WHERE n_in > 0 AND n_in < n),
best AS (SELECT *, depth / sqrt(1 / n_in::DOUBLE + 1 / (n - n_in)::DOUBLE) AS snr FROM scored WHERE depth > 0
  QUALIFY row_number() OVER (PARTITION BY target, pid ORDER BY round(depth / sqrt(1 / n_in::DOUBLE + 1 / (n - n_in)::DOUBLE), 9) DESC, di, i) = 1)
SELECT target, pid::BIGINT AS pid, period, {_r('duration')} AS duration_days, {_r('first + ((i + w / 2.0::DOUBLE) * 0.005::DOUBLE) % period')} AS transit_time, round(depth, 4) AS depth, {_r('snr')} AS sr
FROM best JOIN p USING (pid) JOIN d USING (di)""")
def live_search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bls.live_search(lcs.filter_nan(light_curves(spark, sf_dir)), periods=_LIVE)
    return rounded(found.select("target", "pid", "period", "duration_days", "transit_time", F.round("depth", 4).alias("depth"), "sr"), "duration_days", "transit_time", "sr")


@query()
def live_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bls.live_search(lcs.filter_nan(light_curves(spark, sf_dir)))


@query()
def validation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison search on its 10,000 periods in equal steps."""
    return crosscheck.search(lcs.filter_nan(light_curves(spark, sf_dir)), [2 + i * (8 / 9999) for i in range(10_000)])


@query()
def validation_search_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison search on the grid without limits."""
    return crosscheck.search(lcs.filter_nan(light_curves(spark, sf_dir)))


_CHECK_LIST = ", ".join(f"({i}, {1 / (0.1 + 0.01 * i)!r}::DOUBLE)" for i in range(N_PERIODS))
_CHECK = f"""
first AS (SELECT target, t - min(t) OVER o AS t, min(t) OVER o AS t0, flux - median(flux) OVER o AS y FROM lc WINDOW o AS (PARTITION BY target)),
pl AS (SELECT * FROM (VALUES {_CHECK_LIST}) v(pid, period)), du AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.25::DOUBLE)) v(di, d)),
f AS (SELECT target, pid, period, t0, t % period AS ph, y FROM first, pl),
tw AS (SELECT target, pid, period, t0, ph, y, true AS own FROM f UNION ALL SELECT target, pid, period, t0, ph + period, y, false FROM f),
ins AS (SELECT *, 0 AS di, 0.1::DOUBLE AS d, sum(y) OVER o AS s, count(*) OVER o AS c, row_number() OVER (PARTITION BY target, pid ORDER BY ph, y) AS nr FROM tw WINDOW o AS (PARTITION BY target, pid ORDER BY ph RANGE BETWEEN CURRENT ROW AND 0.1::DOUBLE FOLLOWING)
        UNION ALL SELECT *, 1, 0.25::DOUBLE, sum(y) OVER o, count(*) OVER o, row_number() OVER (PARTITION BY target, pid ORDER BY ph, y) FROM tw WINDOW o AS (PARTITION BY target, pid ORDER BY ph RANGE BETWEEN CURRENT ROW AND 0.25::DOUBLE FOLLOWING)),
whole AS (SELECT target, sum(y) AS total, count(*) AS n FROM first GROUP BY 1),
lik AS (SELECT *, (total - s) / (n - c) - s / c AS depth FROM ins JOIN whole USING (target) WHERE own AND c < n),
pick AS (SELECT *, 0.5 * c * depth * depth AS power FROM lik WHERE depth > 0
         QUALIFY row_number() OVER (PARTITION BY target, pid ORDER BY round(0.5 * c * depth * depth, 6) DESC, di, nr) = 1)"""


@query(f"""WITH {_LC}, {_CHECK} SELECT target, pid::BIGINT AS pid, {_r('period')} AS period, d AS duration_days, {_r('t0 + (ph + d / 2) % period')} AS transit_time, round(depth, 4) AS depth, round(power, 3) AS power FROM pick""")
def validation_search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison search with two durations on the periods of ``bls_search_list``."""
    periods = [1 / (0.1 + 0.01 * i) for i in range(N_PERIODS)]
    found = crosscheck.search(lcs.filter_nan(light_curves(spark, sf_dir)), periods, (0.1, 0.25))
    # nine digits first: a value that lies on a tie of its last digit, but for the noise of its sums, rounds as the exact one
    digits = lambda c, n: F.round(F.round(c, 9), n).alias(c)
    return rounded(found, "period", "transit_time").select("target", "pid", "period", "duration_days", "transit_time", digits("depth", 4), digits("power", 3))


@query()
def flatten_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.flatten_and_search(light_curves(spark, sf_dir))


@query()
def bls_full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bls.search_per_target(lcs.filter_nan(light_curves(spark, sf_dir)))


_FAP = erfc_sql("x").replace("D *", "::DOUBLE *").replace("D /", "::DOUBLE /")


@query(f"""WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()}, e AS (SELECT target, pid, {_FAP} AS e FROM (SELECT *, sde / sqrt(2.0::DOUBLE) AS x FROM sde))
SELECT target, pid, {_r(f"CASE WHEN e >= 1 THEN 1 ELSE 1 - (1 - e) ** {N_PERIODS} END")} AS fap FROM e""")
def fap_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bls.with_sde(_power_of(spark, sf_dir)).select("target", "pid", false_alarm("sde", F.lit(float(N_PERIODS))).alias("fap")), "fap")


_LIST_PERIODS = [1 / (0.1 + 0.01 * i) for i in range(N_PERIODS)]
_LIST_SEARCH = {"min_duration": 0.05, "max_duration": 0.25}


@query()
def fap_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 shuffles of the search with 400 bins on the periods of ``bls_search_list``."""
    lc = lcs.filter_nan(light_curves(spark, sf_dir))
    periods = spark.range(N_PERIODS).select(F.col("id").alias("pid"), bls.explicit_period(F.col("id")).alias("period"))
    observed = bls.search(lc, periods, **_LIST_SEARCH).groupBy("target").agg(F.max("sr").alias("sr"))
    return bls.search_fap(lc, observed, periods=_LIST_PERIODS, **_LIST_SEARCH)


def _shuffled_sql(rounds: int, seed: int = 1) -> str:
    """xw of each shuffle, as a target of its own: point i takes the flux of the i-th point by hash."""
    steps = "SELECT target, k, i, x, i * 69069 % 2147483648 AS h FROM pts, ks"
    for _ in range(3):
        steps = f"SELECT target, k, i, x, xor(y, y >> 15) AS h FROM (SELECT target, k, i, x, (h * 1103515245 + 12345 + ({seed * 1009} + k) * 7919) % 2147483648 AS y FROM ({steps}))"
    return f"""ks AS (SELECT i AS k FROM range({rounds}) r(i)),
pts AS (SELECT target, t, flux - avg(flux) OVER (PARTITION BY target) AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY target) AS w, row_number() OVER (PARTITION BY target ORDER BY t, flux) - 1 AS i FROM lc),
moved AS (SELECT target, k, x, row_number() OVER (PARTITION BY target, k ORDER BY h, i) - 1 AS i FROM ({steps})),
xw AS (SELECT p.target || '|' || m.k AS target, p.t, m.x, p.w FROM pts p JOIN moved m USING (target, i))"""


@query(f"""SELECT split_part(target, '|', 1) AS target, split_part(target, '|', 2)::INTEGER AS round, max(sr) AS best
FROM ({ORACLE_SQL["bls_search_list"].replace(_XW, _shuffled_sql(4))}) GROUP BY ALL""")
def fap_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each of four shuffles, whole, of the search on the list."""
    return rounded(bls.search_shuffles(lcs.filter_nan(light_curves(spark, sf_dir)), 4, _LIST_PERIODS, N_BINS, **_LIST_SEARCH), "best")


@query(f"""WITH {_LC}, {_XW}, {_HIST}, {_PREFIX}, {_power()}, m AS (SELECT target, avg(sr) AS level FROM power GROUP BY 1)
SELECT target, {_r('avg((sr >= level)::INTEGER)')} AS fap, count(*) AS rounds FROM power JOIN m USING (target) GROUP BY 1""")
def fap_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    power = _power_of(spark, sf_dir)
    levels = power.groupBy("target").agg(F.avg("sr").alias("sr"))
    return rounded(bls.exceedance(power.select("target", F.col("sr").alias("best")), levels), "fap")


@query(f"""WITH a AS (SELECT target, period AS ours FROM ({ORACLE_SQL["bls_search_list"]}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY sr DESC, pid) = 1),
b AS (SELECT target, period AS theirs FROM ({ORACLE_SQL["validation_search_list"]}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY power DESC, pid) = 1)
SELECT target, 'period' AS quantity, ours, theirs, {_r('abs(ours - theirs)')} AS abs_diff, {_r('abs(ours - theirs) / theirs')} AS rel_diff FROM a JOIN b USING (target)""")
def compare_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best periods of the flow's search and of the comparison search, on one list."""
    best = lambda df, by: rounded(df.groupBy("target").agg(F.min_by("period", F.struct(-F.col(by), F.col("pid"))).alias("value")), "value").withColumn("quantity", F.lit("period"))
    both = bls.compare_results(best(bls_search_list(spark, sf_dir), "sr"), best(validation_search_list(spark, sf_dir), "power"), ("target", "quantity"))
    return rounded(both, "abs_diff", "rel_diff")


# --- vetting and reports ---


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bls.flag_harmonics(_peaks_of(spark, sf_dir))
    return c.withColumns({"phase_start": F.col("start") / N_BINS, "phase_width": F.col("width") / N_BINS, "duration_days": F.col("width") / N_BINS * F.col("period")})


def _vetted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vetting.vet(light_curves(spark, sf_dir), _candidates(spark, sf_dir))


@query(f"{_CHAIN} SELECT target, peak_rank, {_r('depth_odd')} AS depth_odd, {_r('depth_even')} AS depth_even, {_r('odd_even_diff_sigma')} AS odd_even_diff_sigma FROM vetted")
def vet_odd_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vetted(spark, sf_dir).select("target", "peak_rank", "depth_odd", "depth_even", "odd_even_diff_sigma"), "depth_odd", "depth_even", "odd_even_diff_sigma")


@query(f"{_CHAIN} SELECT target, peak_rank, {_r('secondary_depth')} AS secondary_depth, {_r('secondary_ratio')} AS secondary_ratio FROM vetted")
def vet_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vetted(spark, sf_dir).select("target", "peak_rank", "secondary_depth", "secondary_ratio"), "secondary_depth", "secondary_ratio")


@query(f"{_CHAIN} SELECT target, peak_rank, status, coalesce(sigma < 3.0 AND NOT is_harmonic, false) AS odd_even_ok, coalesce(ratio < 0.1 AND sigma <= 3 AND NOT is_harmonic, false) AS secondary_ok, sde > 6.0 AS sde_ok FROM vetted")
def vet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    lights = checks(F.coalesce("odd_even_diff_sigma", F.lit(99.0)), F.coalesce("secondary_ratio", F.lit(99.0)), F.col("sde"))
    return _vetted(spark, sf_dir).select("target", "peak_rank", "status", *lights)


@query(f"{_CHAIN} SELECT target, peak_rank, CASE WHEN status = 'PASSED' THEN greatest(40, least(99, floor(sde / 15 * 100 + 0.5)))::INTEGER ELSE 0 END AS confidence FROM vetted")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_confidence(_vetted(spark, sf_dir)).select("target", "peak_rank", "confidence")


@query(f"""{_CHAIN}, b AS (SELECT * FROM vetted WHERE status = 'PASSED' QUALIFY row_number() OVER (PARTITION BY target ORDER BY peak_rank) = 1)
SELECT l.target AS tic_id, CASE WHEN b.target IS NOT NULL THEN 'VETTED CANDIDATE' ELSE 'NO CANDIDATE / FALSE POSITIVE' END AS status, {_r('coalesce(period, 0)')} AS period,
  {_r('coalesce(abs(depth) * 1e6, 0)')} AS depth_ppm, {_r('coalesce(duration_days * 24, 0)')} AS duration_hrs, {_r('coalesce(sde, 0)')} AS sde, 'N/A' AS fap,
  {_r('coalesce(odd_even_diff_sigma, 0)')} AS odd_even_sigma, {_r('coalesce(secondary_ratio, 0)')} AS secondary_ratio
FROM (SELECT DISTINCT target FROM lc) l LEFT JOIN b USING (target)""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = light_curves(spark, sf_dir).select("target").distinct()
    return rounded(report.batch_report(targets, vetting.best_passed(_vetted(spark, sf_dir))), "period", "depth_ppm", "duration_hrs", "sde", "odd_even_sigma", "secondary_ratio")


@query(f"{_CHAIN} SELECT target, peak_rank, {_r('period')} AS period, {_r('sde')} AS sde FROM cands WHERE peak_rank <= 5")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.top_candidates(_candidates(spark, sf_dir), 5).select("target", "peak_rank", "period", "sde"), "period", "sde")


@query(f"""WITH {_LC}, n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t, flux) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM lc)
SELECT target, t, flux, quality FROM n WHERE i % greatest(1, n // 300) = 0""")
def folded_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.downsample(light_curves(spark, sf_dir), 300)


@query(f"WITH {_LC} SELECT target, {_r('min(flux) - (max(flux) - min(flux)) * 0.1::DOUBLE')} AS lo, {_r('max(flux) + (max(flux) - min(flux)) * 0.1::DOUBLE')} AS hi FROM lc GROUP BY 1")
def chart_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.chart_domain(light_curves(spark, sf_dir)), "lo", "hi")


def _as_progress(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_id") % 17 == 0, "error").when(F.col("event_id") % 5 == 0, "complete").otherwise("running")
    return events.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), status.alias("status"))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_progress(spark.read.parquet(f"{sf_dir}/events.parquet"))


_PROGRESS = "progress AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, event_type AS stage, CASE WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'complete' ELSE 'running' END AS status FROM events)"


@query(f"WITH {_PROGRESS} SELECT job_id, stage, arg_max(status, seq) AS status, min(seq) AS first_seq FROM progress GROUP BY ALL")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.latest_status(_progress(spark, sf_dir))


@query(f"WITH {_PROGRESS} SELECT job_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'complete') THEN 'completed' WHEN bool_or(stage <> 'upload') THEN 'running' ELSE 'pending' END AS state FROM progress GROUP BY 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.job_states(_progress(spark, sf_dir))


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a stream over all events as they lie in their files."""
    state, log = store.new_folder(spark, "jobs"), store.new_folder(spark, "jobs-log")
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", 64)
    jobs.follow(_as_progress(raw.parquet(f"{sf_dir}/events.parque[t]")), log, state).awaitTermination()  # a pattern, as a stream's plain path must be a folder
    return jobs.read_log(spark, log)


@query(ORACLE_SQL["job_states"])
def job_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States kept by job while events stream in."""
    return jobs.states(_followed(spark, sf_dir))


@query(ORACLE_SQL["latest_status"])
def latest_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each stage, kept by job while events stream in."""
    return jobs.stages(_followed(spark, sf_dir))


# --- box statistics ---

_FOLDED = f"folded AS (SELECT target, flux, (t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE AS p FROM lc)"


def _two_levels(n_in: str, sum_in: str) -> str:
    return f"""SELECT *, total / n AS m, sum_in / n_in AS mi, (total - sum_in) / (n - n_in) AS mo, squares / n - (total / n) ** 2 AS v
FROM (SELECT *, {n_in} AS n_in, {sum_in} AS sum_in FROM base)"""


@query(f"""WITH {_LC}, {_FOLDED}, base AS (SELECT target, count(*) AS n, sum(flux) AS total, sum(flux * flux) AS squares,
  count(*) FILTER (WHERE least(abs(p - 0.3::DOUBLE), 1 - abs(p - 0.3::DOUBLE)) <= 0.05::DOUBLE) AS k, sum(flux) FILTER (WHERE least(abs(p - 0.3::DOUBLE), 1 - abs(p - 0.3::DOUBLE)) <= 0.05::DOUBLE) AS si FROM folded GROUP BY 1),
s AS ({_two_levels('k', 'si')})
SELECT target, {_r('mo - mi')} AS depth, {_r('(mo - mi) / sqrt(v)')} AS snr, {_r('(mo - mi) ** 2 * n_in / v')} AS power, round(squares - n_in * mi * mi - (n - n_in) * mo * mo, 2) AS ssr,
  {_r('mi')} AS inside_mean, {_r('mo')} AS outside_mean, n_in AS n_inside, n - n_in AS n_outside
FROM s WHERE n_in >= 5 AND n - n_in >= 5 AND mo - mi > 0 AND v > 0""")
def box_statistics_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes.transit_statistics(lcs.fold(light_curves(spark, sf_dir), PERIOD), 0.3, 0.1).drop("bls_score")
    return rounded(rows, "depth", "snr", "power", "inside_mean", "outside_mean").withColumn("ssr", F.round("ssr", 2))


@query(f"""WITH {_LC}, {_FOLDED}, tot AS (SELECT target, count(*) AS n, sum(flux) AS total, sum(flux * flux) AS squares FROM folded GROUP BY 1),
trial AS (SELECT c.i AS ci, d.i AS di, c.i * (1 / 299.0::DOUBLE) AS center, 0.01::DOUBLE + d.i * ((0.05::DOUBLE - 0.01::DOUBLE) / 14) AS duration FROM range(300) c(i), range(15) d(i)),
hit AS (SELECT target, ci, di, count(*) AS n_in, sum(flux) AS sum_in FROM folded, trial WHERE least(abs(p - center), 1 - abs(p - center)) <= duration / 2 GROUP BY ALL),
s AS (SELECT *, sum_in / n_in AS mi, (total - sum_in) / (n - n_in) AS mo, squares / n - (total / n) ** 2 AS v FROM hit JOIN tot USING (target) WHERE n_in >= 5 AND n - n_in >= 5),
b AS (SELECT *, squares - n_in * mi * mi - (n - n_in) * mo * mo AS ssr FROM s WHERE mo > mi AND v > 0
      QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(squares - n_in * mi * mi - (n - n_in) * mo * mo, 4), ci, di) = 1)
SELECT target, {_r('ci / 299.0')} AS center, {_r('0.01 + di * (0.04 / 14)')} AS duration, {_r('mo - mi')} AS depth, {_r('(mo - mi) / sqrt(v)')} AS snr, n_in AS n_inside FROM b""")
def box_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes.analyze_period(lcs.fold(light_curves(spark, sf_dir), PERIOD)).select("target", "center", "duration", "depth", "snr", "n_inside")
    return rounded(rows, "center", "duration", "depth", "snr")


@query(f"""WITH {_LC}, f AS (SELECT 0.25::DOUBLE + i * 0.02::DOUBLE AS f FROM range(5) r(i)), span AS (SELECT target, max(t) - min(t) AS baseline FROM lc GROUP BY 1),
folded AS (SELECT target, f, flux, (t % (1 / f)) / (1 / f) AS p FROM lc, f),
tot AS (SELECT target, f, count(*) AS n, sum(flux) AS total, sum(flux * flux) AS squares FROM folded GROUP BY ALL),
trial AS (SELECT c.i AS ci, d.i AS di, c.i / 299.0::DOUBLE AS center, 0.01::DOUBLE + d.i * ((0.05::DOUBLE - 0.01::DOUBLE) / 14) AS duration FROM range(300) c(i), range(15) d(i)),
hit AS (SELECT target, f, ci, di, count(*) AS n_in, sum(flux) AS sum_in FROM folded, trial WHERE least(abs(p - center), 1 - abs(p - center)) <= duration / 2 + 1e-12 GROUP BY ALL),
s AS (SELECT *, sum_in / n_in AS mi, (total - sum_in) / (n - n_in) AS mo, squares / n - (total / n) ** 2 AS v FROM hit JOIN tot USING (target, f) WHERE n_in >= 5 AND n - n_in >= 5),
b AS (SELECT * FROM s WHERE mo > mi AND v > 0 QUALIFY row_number() OVER (PARTITION BY target, f ORDER BY round(squares - n_in * mi * mi - (n - n_in) * mo * mo, 4), ci, di) = 1)
SELECT target, {_r('1 / f')} AS period, round((mo - mi) ** 2 * n_in / v, 4) AS power, round(mo - mi, 4) AS depth, round((mo - mi) / sqrt(v), 4) AS snr, {_r('baseline * f')} AS transits FROM b JOIN span USING (target) WHERE baseline * f >= 3""")
def box_search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.search_periods(light_curves(spark, sf_dir), 1 / (0.25 + 4.5 * 0.02), 4.0, 0.02)
    return rounded(found, "period", "transits").select("target", "period", *[F.round(c, 4).alias(c) for c in ("power", "depth", "snr")], "transits")


@query()
def box_search_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.search_periods(light_curves(spark, sf_dir), 2.0, 8.0), "period", "power", "depth", "snr")


@query(f"""WITH {_LC}, {_FOLDED}, c AS (SELECT target, i AS ci, i * top / 199 AS center FROM (SELECT target, max(p) AS top FROM folded GROUP BY 1), range(200) r(i)),
s AS (SELECT target, ci, any_value(center) AS center, count(*) FILTER (WHERE abs(p - center) < 0.025) AS n, avg(flux) FILTER (WHERE abs(p - center) < 0.025) AS mi,
  avg(flux) FILTER (WHERE abs(p - center) >= 0.025) AS mo, stddev_pop(flux) FILTER (WHERE abs(p - center) >= 0.025) AS d FROM folded JOIN c USING (target) GROUP BY ALL)
SELECT target, round((mo - mi) / d, 6) + 0.0 AS score, {_r('center')} AS center FROM s WHERE n >= 5 AND d > 0
QUALIFY row_number() OVER (PARTITION BY target ORDER BY round((mo - mi) / d, 6) DESC, ci) = 1""")
def box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.box_score(lcs.fold(light_curves(spark, sf_dir), PERIOD)), "score", "center")


@query(f"WITH {_LC} SELECT target, {_r('(median(flux) - min(flux)) / stddev_pop(flux)')} AS score FROM lc GROUP BY 1")
def transit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boxes.transit_score(light_curves(spark, sf_dir)), "score")


@query(f"""WITH {_LC}, {_FOLDED}, base AS (SELECT target, count(*) AS n, sum(flux) AS total, 0 AS squares, count(*) FILTER (WHERE least(floor(p * 50), 49) BETWEEN 10 AND 14) AS k,
  sum(flux) FILTER (WHERE least(floor(p * 50), 49) BETWEEN 10 AND 14) AS si FROM folded GROUP BY 1), s AS ({_two_levels('k', 'si')})
SELECT target, {_r('mo - mi')} AS depth, n_in AS inside_count, n - n_in AS outside_count, round((n_in * (mo - mi)) ** 2 / ((n_in / n::DOUBLE) * (1 - n_in / n::DOUBLE)), 3) AS sr
FROM s WHERE n_in >= 5 AND n - n_in >= 5 AND mo > mi""")
def box_count_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from dipper.functions.phase import phase_bin

    folded = lcs.fold(light_curves(spark, sf_dir), PERIOD)
    binned = folded.groupBy("target", phase_bin(F.col("phase"), 50).alias("bin")).agg(F.sum("flux").alias("f"), F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("target").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    prefix = binned.select("target", (F.col("bin") + 1).alias("k"), F.sum("f").over(by).alias("flux_sum"), F.sum("c").over(by).alias("count"))
    rows = boxes.count_statistic(prefix, 10, 15).select("target", "depth", "inside_count", "outside_count", "sr")
    return rounded(rows, "depth").withColumn("sr", F.round("sr", 3))


# --- photometry ---


@query(f"WITH {_PIXELS} SELECT target, row, col, {_r('value')} AS value FROM image")
def mean_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(photometry.mean_image(pixels(spark, sf_dir)), "value")


@query(f"WITH {_PIXELS} SELECT target, row, col, {_r('value')} AS value FROM seed")
def brightest_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(photometry.brightest_pixel(photometry.mean_image(pixels(spark, sf_dir))), "value")


@query(f"WITH {_PIXELS} SELECT target, {_r('median(value)')} AS background FROM image GROUP BY 1")
def background_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(photometry.global_background(photometry.mean_image(pixels(spark, sf_dir))), "background")


@query(f"WITH {_PIXELS} SELECT target, {_r('background')} AS background FROM background")
def background_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = photometry.mean_image(pixels(spark, sf_dir))
    return rounded(photometry.local_background(image, photometry.brightest_pixel(image)), "background")


@query(f"WITH RECURSIVE {_PIXELS}, {_APERTURE} SELECT target, sigma, row, col FROM mask")
def aperture_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photometry.optimize_apertures(pixels(spark, sf_dir), SIGMAS)[1].select("target", "sigma", "row", "col")


_GROWTH = """
grow AS (
  SELECT target, sigma, threshold, [row * 100 + col] AS seen, row, col, 1 AS seq FROM seed JOIN level USING (target) WHERE value >= threshold
  UNION ALL
  SELECT target, sigma, threshold, list_append(seen, code), (code // 100)::INTEGER, (code % 100)::INTEGER, seq + 1 FROM (
    SELECT g.target, g.sigma, g.threshold, g.seen, g.seq, i.row * 100 + i.col AS code, row_number() OVER (PARTITION BY g.target, g.sigma ORDER BY i.value DESC, i.row, i.col) AS place
    FROM grow g JOIN image i ON i.target = g.target AND i.value >= g.threshold AND NOT list_contains(g.seen, i.row * 100 + i.col)
      AND len(list_filter(g.seen, lambda x: abs(x // 100 - i.row) <= 1 AND abs(x % 100 - i.col) <= 1)) > 0
    WHERE g.seq < 12) WHERE place = 1)"""


@query(f"WITH RECURSIVE {_PIXELS}, {_APERTURE.split('mask AS')[0].rstrip().rstrip(',')}, {_GROWTH} SELECT target, sigma, row, col, seq FROM grow")
def aperture_first_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve pixels of each aperture, in the order in which it grows."""
    return photometry.first_pixels(photometry.optimize_apertures(pixels(spark, sf_dir), SIGMAS)[1], 12).select("target", "sigma", "row", "col", "seq")


@query(f"WITH RECURSIVE {_PIXELS}, {_APERTURE} SELECT target, sigma, cadence, {_r('flux')} AS flux FROM flux")
def aperture_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    image = photometry.mean_image(px)
    background = photometry.local_background(image, photometry.brightest_pixel(image))
    return rounded(photometry.aperture_flux(px, photometry.optimize_apertures(px, SIGMAS)[1], background), "flux")


@query(f"""WITH RECURSIVE {_PIXELS}, {_APERTURE},
every AS (SELECT l.target, l.sigma, c.cadence, coalesce(f.flux, 0) AS flux FROM level l JOIN (SELECT DISTINCT target, cadence FROM pixels) c USING (target) LEFT JOIN flux f ON f.target = l.target AND f.sigma = l.sigma AND f.cadence = c.cadence),
scaled AS (SELECT target, sigma, CASE WHEN m = 0 THEN 1 ELSE flux / m END AS flux FROM every JOIN (SELECT target, sigma, median(flux) AS m FROM every GROUP BY ALL) USING (target, sigma)),
stat AS (SELECT target, sigma, any_value(signal) AS signal, stddev_pop(flux) AS noise, sqrt(avg((flux - signal) ** 2)) AS rms
         FROM scaled JOIN (SELECT target, sigma, median(flux) AS signal FROM scaled GROUP BY ALL) USING (target, sigma) GROUP BY ALL),
size AS (SELECT target, sigma, count(*) AS pixels FROM mask GROUP BY ALL),
trial AS (SELECT target, sigma, coalesce(pixels, 0) AS pixels, coalesce(signal, 0) AS signal, coalesce(noise, 0) AS noise, coalesce(rms, 0) AS rms, coalesce(CASE WHEN noise = 0 THEN 0 ELSE signal / noise END, 0) AS snr
          FROM level LEFT JOIN size USING (target, sigma) LEFT JOIN stat USING (target, sigma))
SELECT target, sigma, pixels, {_r('signal')} AS signal, {_r('snr')} AS snr, round(CASE WHEN pixels = 0 THEN 0 ELSE snr / sqrt(pixels) END, 6) + 0.0 AS score,
  row_number() OVER (PARTITION BY target ORDER BY round(CASE WHEN pixels = 0 THEN 0 ELSE snr / sqrt(pixels) END, 6) DESC, sigma) = 1 AS is_best FROM trial""")
def aperture_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = photometry.optimize_apertures(pixels(spark, sf_dir), SIGMAS)[0].select("target", "sigma", "pixels", "signal", "snr", "score", "is_best")
    return rounded(trials, "signal", "snr", "score")


# --- sources and sinks ---


@query(f"WITH {_LC} SELECT target, t, flux, quality FROM lc WHERE isfinite(t) AND isfinite(flux)")
def fits_light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All light curves, written as FITS tables by tasks and read again."""
    folder = store.new_folder(spark, "fits")
    fits.write_fits(light_curves(spark, sf_dir), folder)
    return fits.read_fits(spark, folder).select("target", "t", "flux", "quality")


@query(f"WITH {_LC} SELECT t, flux FROM lc WHERE quality IN (0, 2) AND flux > 10 AND target <> 'click'")
def fits_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light curves written by the format with a commit, and read by it: two columns, filters taken, tables split by rows."""
    folder = f"{store.new_folder(spark, 'fits')}/curves"
    fits.register(spark)
    names = {"time": "BJD", "flux": "SAP_FLUX", "flags": "SAP_QUALITY"}
    light_curves(spark, sf_dir).select("target", "t", "flux", "quality").repartition("target").write.format("fits").options(**names).mode("append").save(folder)
    rows = spark.read.format("fits").option("splitBytes", 40_000).schema("target string, t double, flux double, quality int").load(folder)
    return rows.where("quality in (0, 2) and flux > 10 and target <> 'click'").select("t", "flux")


@query(f"WITH {_LC} SELECT 'TIC ' || target AS object, count(*)::BIGINT AS n_rows, 2::BIGINT AS n_hdus, 'TIME D, FLUX D, QUALITY J' AS fields FROM lc GROUP BY 1")
def fits_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of these files say."""
    folder = store.new_folder(spark, "fits")
    fits.write_fits(light_curves(spark, sf_dir), folder)
    card = lambda k: F.max(F.col("cards")[k])
    field = lambda i: F.concat_ws(" ", card(f"TTYPE{i}"), F.translate(card(f"TFORM{i}"), "1", ""))
    files = fits.read_headers(spark, folder).groupBy("path").agg(card("OBJECT").alias("object"), card("NAXIS2").cast("long").alias("rows"), F.count(F.lit(1)).alias("hdus"), F.concat_ws(", ", *map(field, (1, 2, 3))).alias("fields"))
    return files.groupBy("object").agg(F.sum("rows").alias("n_rows"), F.max("hdus").alias("n_hdus"), F.max("fields").alias("fields"))


@query(f"WITH {_PIXELS} SELECT target, cadence, row, col, px FROM pixels")
def fits_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames, written as target pixel files and read again."""
    folder = store.new_folder(spark, "fits")
    fits.write_frames(pixels(spark, sf_dir), folder)
    frames = fits.read_frames(spark, folder).select("target", F.col("t").cast("long").alias("cadence"), "flux")
    return photometry.explode_frames(frames)


_FINITE = f"WITH {_LC} SELECT target, t, flux, quality FROM lc WHERE isfinite(t) AND isfinite(flux)"


@query(_FINITE)
def fits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that land in two rounds, taken by the format as a stream that goes on where it stopped."""
    folder, out = f"{store.new_folder(spark, 'fits')}/curves", store.new_folder(spark, "streamed")
    fits.register(spark)
    lc = light_curves(spark, sf_dir).select("target", "t", "flux", "quality").repartition("target")
    for odd in (0, 1):
        lc.where(F.col("quality") % 2 == odd).write.format("fits").mode("append").save(folder)
        stream = spark.readStream.format("fits").option("log", f"{out}/seen").option("maxFiles", 1000).load(folder)
        landing.process(stream, lambda rows: rows, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("target", "t", "flux", "quality")


@query(_FINITE)
def fits_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all accepted endings and others land in a folder; a stream takes them to the result."""
    folder, out = store.new_folder(spark, "landing"), store.new_folder(spark, "landed")
    lc = light_curves(spark, sf_dir)
    for i, ending in enumerate(fits.ENDINGS):
        fits.write_fits(lc.where(F.col("quality") == i), folder, ending.upper() if i == 2 else ending)
    fits.write_fits(lc, folder, ".dat")
    landing.process(landing.read_landing(spark, folder), lambda rows: rows, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("target", "t", "flux", "quality")


def _uniform_sql(rows: str, names: tuple[str, ...] = ("v", "w")) -> str:
    """(id, target, t) rows with a number in (0, 1) for each name; a chain of steps, as nested ones would double with each."""
    each = lambda form: ", ".join(f"{form.format(n)} AS {n}" for n in names)
    steps = f"SELECT target, t, {', '.join(f'(id * 69069 + {(42 * 1009 + i) * 7919 + 1}) % 2147483648 AS {n}' for i, n in enumerate(names, 1))} FROM {rows}"
    for _ in range(3):
        steps = f"SELECT target, t, {each('xor({0}, {0} >> 15)')} FROM (SELECT target, t, {each('({0} * 1103515245 + 12345) % 2147483648')} FROM ({steps}))"
    return f"SELECT target, t, {each('({0} + 0.5::DOUBLE) / 2147483648')} FROM ({steps})"


@query(f"""WITH own AS (SELECT event_id AS id, event_type AS target, (epoch_us(ts) - 1704067200000000) / 8.64e10::DOUBLE AS t FROM events), u AS ({_uniform_sql("own")})
SELECT target, t, {_r('1 + 0.002::DOUBLE * sqrt(-2 * ln(v)) * cos(2 * pi() * w) - CASE WHEN t % 5.0::DOUBLE < 0.15::DOUBLE THEN 0.01::DOUBLE ELSE 0 END')} AS flux, 0 AS quality FROM u""")
def synthetic_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known boxes in noise at the times of all events."""
    return rounded(synthetic.on_times(event_times(spark, sf_dir)), "flux")


@query(f"{_CHAIN} SELECT target, peak_rank, {_r('period')} AS period, {_r('sde')} AS sde, is_harmonic, status FROM vetted")
def candidates_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, written as CSV and read again."""
    folder = store.new_folder(spark, "csv")
    rows = rounded(_vetted(spark, sf_dir).select("target", "peak_rank", "period", "sde", "is_harmonic", "status"), "period", "sde")
    report.write_candidates_csv(rows, f"{folder}/candidates")
    return spark.read.option("header", True).schema("target string, peak_rank int, period double, sde double, is_harmonic boolean, status string").csv(f"{folder}/candidates")


@query(f"""{_CHAIN}, b AS (SELECT * FROM vetted WHERE status = 'PASSED' QUALIFY row_number() OVER (PARTITION BY target ORDER BY peak_rank) = 1)
SELECT l.target AS "TIC_ID", CASE WHEN b.target IS NOT NULL THEN 'VETTED CANDIDATE' ELSE 'NO CANDIDATE / FALSE POSITIVE' END AS "Status", printf('%.5f', coalesce(period, 0)) AS "Period_days",
  printf('%.1f', coalesce(abs(depth) * 1e6, 0)::DOUBLE) AS "Depth_ppm", printf('%.2f', coalesce(duration_days * 24, 0)::DOUBLE) AS "Duration_hrs", printf('%.2f', coalesce(sde, 0)::DOUBLE) AS "SDE", 'N/A' AS "FAP",
  printf('%.2f', coalesce(odd_even_diff_sigma, 0)::DOUBLE) AS "OddEvenSigma", printf('%.3f', coalesce(secondary_ratio, 0)::DOUBLE) AS "SecondaryRatio"
FROM (SELECT DISTINCT target FROM lc) l LEFT JOIN b USING (target)""")
def batch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary file, written and read again."""
    folder = store.new_folder(spark, "csv")
    targets = light_curves(spark, sf_dir).select("target").distinct()
    report.write_batch_csv(report.batch_report(targets, vetting.best_passed(_vetted(spark, sf_dir))), f"{folder}/batch")
    return spark.read.option("header", True).csv(f"{folder}/batch")


_DOCUMENT = "target string, light_curve struct<time:array<double>,flux:array<double>>, periodogram struct<periods:array<double>,sde:array<double>,sr:array<double>>, candidates array<struct<peak_rank:int,status:string>>, best_candidate struct<period:double>, detection boolean"


@query(f"""{_CHAIN}, b AS (SELECT * FROM vetted WHERE status = 'PASSED' QUALIFY row_number() OVER (PARTITION BY target ORDER BY peak_rank) = 1),
c AS (SELECT target, count(*)::INTEGER AS n FROM vetted GROUP BY 1), l AS (SELECT target, count(*)::INTEGER AS n, min(t) AS t, max(flux) AS top FROM lc GROUP BY 1), s AS (SELECT target, count(*)::INTEGER AS n, max(sde) AS top FROM sde GROUP BY 1)
SELECT l.target, l.n AS n_points, {_r('l.t')} AS first_time, {_r('l.top')} AS top_flux, s.n AS n_periods, {_r('s.top')} AS top_sde, coalesce(c.n, 0) AS n_candidates, {_r('b.period')} AS best_period, b.target IS NOT NULL AS detection
FROM l JOIN s USING (target) LEFT JOIN c USING (target) LEFT JOIN b USING (target)""")
def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's JSON document, written as a text and read again, by what its fields hold."""
    folder = store.new_folder(spark, "json")
    documents = report.result_documents(light_curves(spark, sf_dir), bls.with_sde(_power_of(spark, sf_dir)), _vetted(spark, sf_dir))
    report.write_json(documents, f"{folder}/results")
    d = spark.read.option("recursiveFileLookup", True).text(f"{folder}/results").select(F.from_json("value", _DOCUMENT).alias("d")).select("d.*")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    rows = d.select("target", size("light_curve.time").alias("n_points"), F.array_min("light_curve.time").alias("first_time"), F.array_max("light_curve.flux").alias("top_flux"), size("periodogram.periods").alias("n_periods"), F.array_max("periodogram.sde").alias("top_sde"), F.when(F.col("candidates").isNull(), 0).otherwise(F.size("candidates")).alias("n_candidates"), F.col("best_candidate.period").alias("best_period"), "detection")
    return rounded(rows, "first_time", "top_flux", "top_sde", "best_period")


# --- whole flows ---


def _smooth_sql(rows: str, out: str) -> str:
    """Cubic smoothing of (target, segment, k, y, n, w) by orthogonal polynomials: each point takes the fit of the whole window nearest to it."""
    return f"""{out}_at AS (SELECT *, w // 2 AS m, least(greatest(k, w // 2), n - 1 - w // 2) AS c FROM {rows}),
{out}_sums AS (SELECT a.target, a.segment, a.c, a.m, sum(b.y) AS s0, sum((b.k - a.c) * b.y) AS s1, sum((3 * (b.k - a.c) ** 2 - a.m * (a.m + 1)) * b.y) AS s2,
    sum((5 * (b.k - a.c) ** 3 - (3 * a.m * a.m + 3 * a.m - 1) * (b.k - a.c)) * b.y) AS s3,
    count(*) AS q0, sum((b.k - a.c) ** 2) AS q1, sum((3 * (b.k - a.c) ** 2 - a.m * (a.m + 1)) ** 2) AS q2, sum((5 * (b.k - a.c) ** 3 - (3 * a.m * a.m + 3 * a.m - 1) * (b.k - a.c)) ** 2) AS q3
  FROM (SELECT DISTINCT target, segment, c, m FROM {out}_at) a JOIN {rows} b ON b.target = a.target AND b.segment = a.segment AND b.k BETWEEN a.c - a.m AND a.c + a.m GROUP BY ALL),
{out} AS (SELECT a.target, a.segment, a.i, s0 / q0 + (k - c) * s1 / q1 + (3 * (k - c) ** 2 - a.m * (a.m + 1)) * s2 / q2 + coalesce((5 * (k - c) ** 3 - (3 * a.m * a.m + 3 * a.m - 1) * (k - c)) * s3 / nullif(q3, 0), 0) AS smooth
  FROM {out}_at a JOIN {out}_sums USING (target, segment, c))"""


_ODD_WINDOW = "CASE WHEN n <= 151 THEN n - 1 - n % 2 ELSE 151 END"
_DETREND = f"""
gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY target ORDER BY t, flux) > 0.5 THEN 1 ELSE 0 END AS new FROM lc WHERE NOT isnan(flux)),
segs AS (SELECT *, sum(new) OVER (PARTITION BY target ORDER BY t, flux ROWS UNBOUNDED PRECEDING) AS segment FROM gaps),
runs AS (SELECT *, row_number() OVER (PARTITION BY target, segment ORDER BY t, flux) - 1 AS i, count(*) OVER (PARTITION BY target, segment) AS n FROM segs),
sized AS (SELECT *, CASE WHEN {_ODD_WINDOW} <= 3 THEN 5 ELSE {_ODD_WINDOW} END AS w FROM runs),
bad AS (SELECT target, arg_min(n || ' points are fewer than a window of ' || w, segment) AS error FROM sized WHERE n < w GROUP BY target),
pts AS (SELECT target, segment, t, flux, i, n, w FROM sized WHERE target NOT IN (SELECT target FROM bad)),
one_in AS (SELECT target, segment, i, i AS k, flux AS y, n, w FROM pts),
{_smooth_sql("one_in", "one")},
rest AS (SELECT p.*, flux - smooth AS rest, stddev_pop(flux - smooth) OVER (PARTITION BY target, segment) AS dev FROM pts p JOIN one USING (target, segment, i)),
good AS (SELECT *, rest > -3 * dev AS ok, sum((rest > -3 * dev)::INTEGER) OVER (PARTITION BY target, segment) AS n_ok FROM rest),
kept AS (SELECT *, ok OR n_ok < w AS keep FROM good),
two_in AS (SELECT target, segment, i, row_number() OVER (PARTITION BY target, segment ORDER BY i) - 1 AS k, flux AS y, count(*) OVER (PARTITION BY target, segment) AS n, w FROM kept WHERE keep),
{_smooth_sql("two_in", "two")},
sides AS (SELECT p.*, smooth, max(CASE WHEN smooth IS NOT NULL THEN i END) OVER (PARTITION BY target, segment ORDER BY i) AS i0, min(CASE WHEN smooth IS NOT NULL THEN i END) OVER (PARTITION BY target, segment ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1
  FROM pts p LEFT JOIN two USING (target, segment, i)),
trends AS (SELECT s.target, s.t, s.flux, CASE WHEN s.smooth IS NOT NULL THEN s.smooth WHEN i0 IS NULL THEN b.smooth WHEN i1 IS NULL THEN a.smooth ELSE a.smooth + (b.smooth - a.smooth) * (s.i - i0) / (i1 - i0) END AS trend
  FROM sides s LEFT JOIN two a ON a.target = s.target AND a.segment = s.segment AND a.i = s.i0 LEFT JOIN two b ON b.target = s.target AND b.segment = s.segment AND b.i = s.i1),
flat0 AS (SELECT target, t, flux / trend AS flux, trend FROM trends)"""


def _clipped_sql(rounds: int, sigma: float) -> str:
    return ", ".join(f"flat{i + 1} AS (SELECT l.* FROM flat{i} l JOIN (SELECT target, median(flux) AS m, stddev_pop(flux) AS s FROM flat{i} GROUP BY 1) USING (target) WHERE flux - m <= {sigma} * s)" for i in range(rounds))


@query(f"""WITH {_LC}, {_DETREND}, {_clipped_sql(5, 5.0)}
SELECT target, t, {_r('flux')} AS flux, {_r('trend')} AS trend, NULL::VARCHAR AS error FROM flat5 UNION ALL SELECT target, NULL, NULL, NULL, error FROM bad""")
def lc_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipeline.clean(light_curves(spark, sf_dir)), "flux", "trend")


@query(f"""WITH {_LC}, {_DETREND} SELECT target, count(*) AS n, {_r('avg(trend)')} AS mean_trend, {_r('stddev_pop(flux)')} AS noise FROM flat0 GROUP BY 1""")
def lc_detrend_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = detrending.detrend(lcs.filter_nan(light_curves(spark, sf_dir))).where("error is null")
    return rounded(flat.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("trend").alias("mean_trend"), F.stddev_pop("flux").alias("noise")), "mean_trend", "noise")


_INSIDE = f"(t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE >= 0.2::DOUBLE - 0.01::DOUBLE AND (t % {PERIOD}::DOUBLE) / {PERIOD}::DOUBLE < 0.2::DOUBLE + 0.1::DOUBLE + 0.01::DOUBLE"


@query(f"""WITH {_LC.replace("lc AS", "every AS", 1)}, lc AS (SELECT * FROM every WHERE NOT ({_INSIDE})), {_DETREND},
bridged AS (SELECT target, t, flux, trend FROM trends UNION ALL SELECT target, t, flux, NULL FROM every WHERE ({_INSIDE}) AND NOT isnan(flux) AND target IN (SELECT target FROM trends)),
near AS (SELECT *, max(CASE WHEN trend IS NOT NULL THEN t END) OVER (PARTITION BY target ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0,
                min(CASE WHEN trend IS NOT NULL THEN t END) OVER (PARTITION BY target ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM bridged),
whole AS (SELECT n.target, n.t, n.flux, CASE WHEN n.trend IS NOT NULL THEN n.trend WHEN t0 IS NULL THEN b.trend WHEN t1 IS NULL THEN a.trend ELSE a.trend + (b.trend - a.trend) * (n.t - t0) / (t1 - t0) END AS trend
  FROM near n LEFT JOIN trends a ON a.target = n.target AND a.t = t0 LEFT JOIN trends b ON b.target = n.target AND b.t = t1)
SELECT target, t, {_r('flux / trend')} AS flux, {_r('trend')} AS trend, NULL::VARCHAR AS error FROM whole UNION ALL SELECT target, NULL, NULL, NULL, error FROM bad""")
def lc_detrend_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detrending that leaves a given box out of the trend."""
    lc = lcs.filter_nan(light_curves(spark, sf_dir))
    boxes_of = lc.select("target").distinct().select("target", F.lit(PERIOD).alias("period"), F.lit(0.2).alias("phase_start"), F.lit(0.1).alias("phase_width"))
    return rounded(detrending.detrend_around(lc, boxes_of, pairs=True), "flux", "trend")


_IN_BOX = """CASE WHEN a + w + 0.01::DOUBLE > 1 THEN p >= a - 0.01::DOUBLE OR p < a + w + 0.01::DOUBLE - 1 WHEN a - 0.01::DOUBLE < 0 THEN p >= a - 0.01::DOUBLE + 1 OR p < a + w + 0.01::DOUBLE
  ELSE p >= a - 0.01::DOUBLE AND p < a + w + 0.01::DOUBLE END"""


@query(f"""WITH {_LC.replace("lc AS", "every AS", 1)},
plain AS (WITH lc AS (SELECT * FROM every), {_DETREND} SELECT target, t, flux, NULL::VARCHAR AS error FROM flat0 UNION ALL SELECT target, NULL, NULL, error FROM bad),
xw AS (SELECT target, t, flux - avg(flux) OVER o AS x, 1.0::DOUBLE / count(*) OVER o AS w FROM plain WHERE error IS NULL WINDOW o AS (PARTITION BY target)),
found AS (WITH {_list_search(200, 0.05, 0.3)} SELECT target, period, start / 200::DOUBLE AS a, width / 200::DOUBLE AS w FROM pick WHERE sr >= 1e-6 QUALIFY row_number() OVER (PARTITION BY target ORDER BY sr DESC, pid) = 1),
boxed AS (SELECT target, t, flux, coalesce({_IN_BOX}, false) AS inside FROM (SELECT e.target, t, flux, a, w, (t % period) / period AS p FROM every e LEFT JOIN found USING (target)
  WHERE NOT isnan(flux) AND target NOT IN (SELECT target FROM plain WHERE error IS NOT NULL))),
marked AS (SELECT target, t, flux, inside AND sum((NOT inside)::INTEGER) OVER (PARTITION BY target) >= 151 AS inside FROM boxed),
lc AS (SELECT target, t, flux FROM marked WHERE NOT inside), {_DETREND},
bridged AS (SELECT target, t, flux, trend FROM trends UNION ALL SELECT target, t, flux, NULL FROM marked WHERE inside AND target IN (SELECT target FROM trends)),
near AS (SELECT *, max(CASE WHEN trend IS NOT NULL THEN t END) OVER (PARTITION BY target ORDER BY t ROWS UNBOUNDED PRECEDING) AS t0,
                min(CASE WHEN trend IS NOT NULL THEN t END) OVER (PARTITION BY target ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM bridged),
whole AS (SELECT n.target, n.t, n.flux, CASE WHEN n.trend IS NOT NULL THEN n.trend WHEN t0 IS NULL THEN b.trend WHEN t1 IS NULL THEN a.trend ELSE a.trend + (b.trend - a.trend) * (n.t - t0) / (t1 - t0) END AS trend
  FROM near n LEFT JOIN trends a ON a.target = n.target AND a.t = t0 LEFT JOIN trends b ON b.target = n.target AND b.t = t1),
whole0 AS (SELECT target, t, flux / trend AS flux, trend FROM whole), {_clipped_sql(5, 5.0).replace("flat", "whole")}
SELECT target, t, {_r('flux')} AS flux, {_r('trend')} AS trend, NULL::VARCHAR AS error FROM whole5 UNION ALL SELECT target, NULL, NULL, NULL, error FROM bad
UNION ALL SELECT target, NULL, NULL, NULL, error FROM plain WHERE error IS NOT NULL""")
def lc_masked_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow of ``lc_masked_detrend`` (trend, search, trend without the box found, clipping) on the periods of ``bls_search_list``."""
    periods = spark.range(N_PERIODS).select(F.col("id").alias("pid"), bls.explicit_period(F.col("id")).alias("period"))
    return rounded(pipeline.clean(light_curves(spark, sf_dir), masked=True, periods=periods, pairs=True), "flux", "trend")


@query()
def lc_masked_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipeline.clean(light_curves(spark, sf_dir), masked=True), "flux", "trend")


@query()
def transit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.batch_csv_lines(pipeline.run(light_curves(spark, sf_dir))["report"])
