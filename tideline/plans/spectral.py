"""Queries over spectra: densities at bins, fits, exponents over time, coupling, filters' gains and scalar formulas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import dsp
from tideline.functions import expressions as X
from tideline.operators import channels, pairs, scans, spectra, stats, windows
from tideline.plans.base import SIG, TIMED, Book, near, r, signal, table, timed

BOOK = Book()
query, QUERIES, SQL = BOOK.query, BOOK.QUERIES, BOOK.SQL
FS, SIZE = 8.0, 32


def _frames(size: int, hop: int, less: int = 0) -> str:
    """SQL of frames (ch, frame, k, x) over sig."""
    return f"""{SIG}, len AS (SELECT ch, count(*) AS n FROM sig GROUP BY ch), fr AS (SELECT s.ch, f.frame, s.i - f.frame * {hop} AS k, s.x FROM sig s JOIN
 (SELECT ch, unnest(range(CAST(floor((n - {size}) / {hop}.0) AS BIGINT) + {1 - less})) AS frame FROM len WHERE n >= {size}) f ON s.ch = f.ch AND s.i >= f.frame * {hop} AND s.i < f.frame * {hop} + {size})"""


def _psd(size: int, hop: int, bins: range, fs: float, keys: str = "ch", less: int = 0) -> str:
    """SQL of Welch's density as psd(ch, k, freq, power) by the definition of the discrete transform."""
    scale = float(sum(dsp.hann(size) ** 2) * fs)
    cosine = f"cos(2 * pi() * b.k * w.k / {size}.0)"
    return f"""{_frames(size, hop, less)}, w AS (SELECT ch, frame, k, (x - avg(x) OVER (PARTITION BY ch, frame)) * 0.5 * (1 - cos(2 * pi() * k / {size - 1}.0)) AS y FROM fr),
 one AS (SELECT w.ch, w.frame, b.k, sum(y * {cosine}) AS c, sum(y * {cosine.replace('cos(', 'sin(', 1)}) AS s FROM w, (SELECT unnest(range({bins.start}, {bins.stop})) AS k) b GROUP BY 1, 2, 3),
 psd AS (SELECT {keys}, k, k * {fs} / {size}.0 AS freq, avg((CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END) * (c * c + s * s) / {scale!r}::DOUBLE) AS power FROM one GROUP BY {keys}, k)"""


PSD = "WITH " + _psd(SIZE, SIZE // 2, range(0, 17), FS)


def psd(spark, sf_dir) -> DataFrame:
    long = windows.frames(signal(spark, sf_dir), SIZE, SIZE).select("ch").distinct()
    return spectra.welch(signal(spark, sf_dir).join(long, "ch", "left_semi"), FS, SIZE, SIZE // 2)


@query(PSD + " SELECT ch, CAST(k AS INTEGER) AS k, round(freq, 6) AS freq, round(log10(power), 5) + 0.0 AS level FROM psd WHERE k > 0")
def welch_density(spark, sf_dir) -> DataFrame:
    return psd(spark, sf_dir).where("k > 0").select("ch", "k", r("freq").alias("freq"), r(F.log10("power"), 5).alias("level"))


@query(PSD + " SELECT ch, CAST(k AS INTEGER) AS k, round(freq, 6) AS freq, round(log10(power), 5) + 0.0 AS level FROM psd WHERE k IN (1, 4, 16)")
def density_at_bins(spark, sf_dir) -> DataFrame:
    return spectra.dft(signal(spark, sf_dir), SIZE, SIZE // 2, [1, 4, 16], FS).select("ch", "k", r("freq").alias("freq"), r(F.log10("power"), 5).alias("level"))


@query(PSD + " SELECT ch, round(-regr_slope(log10(power), log10(freq)), 4) + 0.0 AS chi, round(regr_intercept(log10(power), log10(freq)), 4) + 0.0 AS off, round(regr_r2(log10(power), log10(freq)), 4) + 0.0 AS r2, count(*) AS bins FROM psd WHERE freq >= 0.5 AND freq <= 3.5 AND power > 0 GROUP BY ch")
def exponent_fixed(spark, sf_dir) -> DataFrame:
    return spectra.fit_fixed(psd(spark, sf_dir), 0.5, 3.5).select("ch", r("chi", 4).alias("chi"), r("offset", 4).alias("off"), r("r2", 4).alias("r2"), "bins")


_GRID = ", ".join(f"({n}, {c!r}::DOUBLE, {e!r}::DOUBLE)" for n, (c, e) in enumerate(spectra.knee_grid()))


@query(PSD + f""", grid(n, chi, e) AS (VALUES {_GRID}), band AS (SELECT ch, freq, log10(power) AS y FROM psd WHERE freq >= 0.5 AND freq <= 3.5 AND power > 0),
 sh AS (SELECT b.ch, g.n, g.chi, pow(pow(10, g.e), g.chi) AS knee, y, log10(pow(pow(10, g.e), g.chi) + pow(freq, g.chi)) AS s FROM band b, grid g),
 fit AS (SELECT ch, n, chi, knee, avg(y + s) AS o, var_pop(y) AS t, var_pop(y + s) AS res FROM sh GROUP BY 1, 2, 3, 4), best AS (SELECT ch, max(1 - res / t) AS r2 FROM fit GROUP BY ch) SELECT ch, round(r2, 5) + 0.0 AS r2 FROM best""")
def exponent_with_knee(spark, sf_dir) -> DataFrame:
    return spectra.fit_knee(psd(spark, sf_dir), 0.5, 3.5).select("ch", r("r2", 5).alias("r2"))


@query("WITH " + _psd(16, 2, range(1, 9), FS, "ch, frame", 1) + " SELECT ch, frame, round(frame * 0.25::DOUBLE + 1.0::DOUBLE, 4) AS t, round(-regr_slope(log10(power), log10(freq)), 4) + 0.0 AS chi FROM psd WHERE freq >= 0.5 AND freq <= 3.5 AND power > 0 GROUP BY ch, frame HAVING count(*) >= 4")
def exponent_over_time(spark, sf_dir) -> DataFrame:
    return spectra.exponent_over_time(signal(spark, sf_dir), FS, 2.0, 0.25, 0.5, 3.5).where(~F.isnan("chi")).select("ch", "frame", r("t", 4).alias("t"), r("chi", 4).alias("chi"))


@query(f"""WITH {SIG}, w AS (SELECT ch, i, x, 0.5 * (1 - cos(2 * pi() * i / count(*) OVER (PARTITION BY ch))) AS w FROM sig)
 SELECT ch, CASE WHEN count(*) >= 8 THEN round(2 * sqrt(pow(sum(w * x * cos(2 * pi() * 0.1 * i)), 2) + pow(sum(w * x * sin(2 * pi() * 0.1 * i)), 2)) / sum(w), 4) END AS depth FROM w GROUP BY ch""")
def modulation_depth(spark, sf_dir) -> DataFrame:
    return spectra.modulation_depth(signal(spark, sf_dir).withColumnRenamed("i", "frame"), "x", 0.1, 1.0).select("ch", r("depth", 4).alias("depth"))


_LAGS = {d: (3 - abs(d), f"lag(power, {-d}) OVER (PARTITION BY ch ORDER BY k)" if d else "power") for d in range(-2, 3)}


@query(PSD + f""", s AS (SELECT ch, k, ({' + '.join(f'coalesce({w} * {e}, 0)' for w, e in _LAGS.values())}) / ({' + '.join(f'CASE WHEN {e} IS NOT NULL THEN {w} ELSE 0 END' for w, e in _LAGS.values())}) AS p FROM psd)
 SELECT ch, CAST(k AS INTEGER) AS k, round(log10(p), 5) + 0.0 AS level FROM s WHERE k > 0""")
def smoothed_bins(spark, sf_dir) -> DataFrame:
    return spectra.smoothed_bins(psd(spark, sf_dir)).where("k > 0").select("ch", "k", r(F.log10("power"), 5).alias("level"))


def _area(lo: float, hi: float) -> str:
    return f"sum(CASE WHEN freq >= {lo} AND f < {hi} THEN (power + p) / 2 * (f - freq) ELSE 0 END)"


@query(PSD + f""", n AS (SELECT *, lead(power) OVER (PARTITION BY ch ORDER BY freq) AS p, lead(freq) OVER (PARTITION BY ch ORDER BY freq) AS f FROM psd)
 SELECT ch, round({_area(0.5, 1.5)} / {_area(0.25, 4)}, 6) AS low_share, round({_area(1.5, 3)} / {_area(0.25, 4)}, 6) AS high_share FROM n GROUP BY ch""")
def band_power(spark, sf_dir) -> DataFrame:
    return spectra.band_power(psd(spark, sf_dir), {"low": (0.5, 1.5), "high": (1.5, 3.0)}, (0.25, 4.0)).select("ch", r("low_share").alias("low_share"), r("high_share").alias("high_share"))


@query(PSD + """, n AS (SELECT *, lead(power) OVER w AS p, lead(freq) OVER w AS f FROM psd WHERE k > 0 WINDOW w AS (PARTITION BY ch ORDER BY freq)), a AS (SELECT unnest([0.1, 0.6, 1.3, 9.0])::DOUBLE AS q),
 c AS (SELECT n.*, q, least(4.0, greatest(0.25, q)) AS g FROM n, a)
 SELECT ch, q AS f, round(ln(power) * (1 - coalesce((g - freq) / (f - freq), 0)) + ln(coalesce(p, power)) * coalesce((g - freq) / (f - freq), 0), 4) + 0.0 AS level FROM c WHERE (freq <= g AND g < f) OR (freq = g AND f IS NULL)""")
def interpolated_power(spark, sf_dir) -> DataFrame:
    return spectra.interpolated_power(psd(spark, sf_dir).where("k > 0"), [0.1, 0.6, 1.3, 9.0]).select("ch", "f", r(F.log("power"), 4).alias("level"))


@query(PSD + """, l AS (SELECT ch, -regr_slope(log10(power), log10(freq)) AS chi, regr_intercept(log10(power), log10(freq)) AS o FROM psd WHERE freq >= 0.25 AND freq <= 4 AND power > 0 AND NOT freq BETWEEN 1 AND 2 GROUP BY ch),
 v AS (SELECT psd.ch, freq, log10(power) - (o - chi * log10(freq)) AS p FROM psd JOIN l USING (ch) WHERE freq >= 1 AND freq <= 2 AND power > 0) SELECT ch, round(max(p), 4) + 0.0 AS prominence FROM v GROUP BY ch""")
def peak_prominence(spark, sf_dir) -> DataFrame:
    return spectra.peak_prominence(psd(spark, sf_dir), 1.0, 2.0, (0.25, 4.0)).select("ch", r("prominence", 4).alias("prominence"))


@query(PSD + ", b AS (SELECT ch, power / sum(power) OVER (PARTITION BY ch) AS s FROM psd WHERE freq >= 0.5 AND freq <= 3.5 AND power > 0) SELECT ch, round(sum(-s * ln(s)) / ln(count(*)), 5) AS entropy, round(max(s), 5) AS largest FROM b GROUP BY ch")
def spectral_entropy(spark, sf_dir) -> DataFrame:
    return spectra.spectral_entropy(psd(spark, sf_dir), 0.5, 3.5).select("ch", r("entropy", 5).alias("entropy"), r("largest", 5).alias("largest"))


@query(PSD + " SELECT ch, round(10 * log10(max(CASE WHEN abs(freq - 2) <= 0.25 THEN power END) / quantile_cont(CASE WHEN abs(freq - 2) > 0.25 AND abs(freq - 2) <= 1 THEN power END, 0.5)), 3) + 0.0 AS db FROM psd GROUP BY ch")
def line_excess(spark, sf_dir) -> DataFrame:
    return spectra.line_excess(psd(spark, sf_dir), 2.0, 0.25, 1.0).select("ch", r("db", 3).alias("db"))


@query(f"WITH {TIMED} SELECT ch, round(2 * sqrt(pow(avg(x * cos(phase)), 2) + pow(avg(x * sin(phase)), 2)) / avg(x), 6) AS depth FROM timed GROUP BY ch")
def envelope_coupling(spark, sf_dir) -> DataFrame:
    return spectra.envelope_coupling(timed(spark, sf_dir)).select("ch", r("depth").alias("depth"))


@query(f"WITH {TIMED} SELECT ch, round(2 * sqrt(pow(avg(x * cos(phase)), 2) + pow(avg(x * sin(phase)), 2)), 5) AS amplitude FROM timed GROUP BY ch")
def locked_amplitude(spark, sf_dir) -> DataFrame:
    return spectra.locked_amplitude(timed(spark, sf_dir)).select("ch", r("amplitude", 5).alias("amplitude"))


def _gain_sql(f: str) -> str:
    parts = []
    for b0, b1, b2, a1, a2 in dsp.sections(256.0, 0.5, 40.0):
        w = f"({2 * math.pi / 256.0!r}::DOUBLE * {f})"
        side = lambda c0, c1, c2: f"sqrt(pow({c0!r}::DOUBLE + {c1!r}::DOUBLE * cos({w}) + {c2!r}::DOUBLE * cos(2 * {w}), 2) + pow({c1!r}::DOUBLE * sin({w}) + {c2!r}::DOUBLE * sin(2 * {w}), 2))"  # noqa: B023, E731
        parts.append(f"{side(b0, b1, b2)} / {side(1.0, a1, a2)}")
    return f"pow({' * '.join(f'({p})' for p in parts)}, 2)"


@query(f"WITH g AS (SELECT unnest(range(1, 200)) AS n) SELECT CAST(n AS BIGINT) AS n, round({_gain_sql('(n * 0.5)')}, 6) AS gain FROM g")
def filter_chain_gain(spark, sf_dir) -> DataFrame:
    return spark.range(1, 200).select(F.col("id").alias("n"), r(X.chain_gain(F.col("id") * 0.5, 0.5, 40.0, 256.0)).alias("gain"))


_B = dsp.lowpass(8.0, 256.0, dsp.butterworth_qs(2)[0])


@query(f"""WITH RECURSIVE {SIG}, f AS (SELECT ch, i, x, {_B[0]!r}::DOUBLE * x AS y, {_B[1]!r}::DOUBLE * x - {_B[3]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * x) AS z1, {_B[2]!r}::DOUBLE * x - {_B[4]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * x) AS z2 FROM sig WHERE i = 0
 UNION ALL SELECT s.ch, s.i, s.x, {_B[0]!r}::DOUBLE * s.x + f.z1, {_B[1]!r}::DOUBLE * s.x - {_B[3]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * s.x + f.z1) + f.z2, {_B[2]!r}::DOUBLE * s.x - {_B[4]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * s.x + f.z1)
 FROM f JOIN sig s ON s.ch = f.ch AND s.i = f.i + 1) SELECT ch, i, round(y, 6) AS y FROM f""")
def biquad_filter(spark, sf_dir) -> DataFrame:
    """A causal second-order low-pass over each whole record."""
    return scans.filtered(signal(spark, sf_dir), [_B]).select("ch", "i", r("x").alias("y"))


@query()
def zero_phase_filter(spark, sf_dir) -> DataFrame:
    return spectra.filtered(signal(spark, sf_dir), lambda x: dsp.cascade(x, dsp.sections(FS, 0.25, 2.0))).select("ch", "i", r("x", 5).alias("y"))


@query()
def hybrid_spectrum(spark, sf_dir) -> DataFrame:
    return spectra.hybrid(signal(spark, sf_dir), FS, SIZE).select("ch", r("freq").alias("freq"), r("power", 5).alias("power"))


@query()
def full_record_periodogram(spark, sf_dir) -> DataFrame:
    return spectra.periodogram(signal(spark, sf_dir), FS).select("ch", "k", r("freq").alias("freq"), r("power", 5).alias("power"))


@query(f"WITH {TIMED} SELECT event_id, round(1.4 + 0.3 * cos(phase - 0.5), 6) AS chi, round(exp(0.2 * x / 100 - 0.04), 6) AS gain, round(pow(10, x / 200), 6) AS db, round(atan2(sin(phase - x), cos(phase - x)), 6) + 0.0 AS err, least(359, greatest(0, CAST(floor((atan2(sin(phase + 0.0005), cos(phase + 0.0005)) + pi()) / (2 * pi()) * 360) AS INTEGER))) AS bucket, CAST(floor(x + 0.5) AS BIGINT) AS half_up FROM timed")
def phase_expressions(spark, sf_dir) -> DataFrame:
    x, p = F.col("x"), F.col("phase")
    return timed(spark, sf_dir).select("event_id", r(X.modulated_exponent(F.lit(1.4), F.lit(0.3), p, F.lit(0.5))).alias("chi"), r(X.power_preserving_gain(F.lit(0.2), x / 100)).alias("gain"), r(X.db_gain(x / 10)).alias("db"), r(X.angle_error(p, x)).alias("err"), X.phase_bucket(p + 0.0005).alias("bucket"), X.half_up(x).alias("half_up"))


_TERMS = " + ".join(f"pow(m, {2 * k}) / {float(math.factorial(k)) ** 2!r}::DOUBLE" for k in range(0, 30))


@query(f"WITH {TIMED}, m AS (SELECT event_id, phase, x / 250 AS m FROM timed) SELECT event_id, round(({_TERMS}), 6) AS i0, round(exp(m * cos(phase - 1)) / sqrt({_TERMS}), 6) AS gain FROM m")
def amplitude_modulation(spark, sf_dir) -> DataFrame:
    m = timed(spark, sf_dir).withColumn("m", F.col("x") / 250)
    return m.select("event_id", r(X.bessel_i0(F.col("m") * 2)).alias("i0"), r(X.amplitude_modulation(F.col("m"), F.col("phase"), F.lit(1.0))).alias("gain"))


_U = "least(1, greatest(0, %s))"


def _cos01(a: str, b: str, t: str) -> str:
    return f"({a} + ({b} - {a}) * (0.5 - 0.5 * cos(pi() * {_U % t})))"


@query(f"""WITH {TIMED}, b AS (SELECT event_id, (event_id % 17) * 0.25 AS t, 1.0 + x / 500 AS dep FROM timed)
 SELECT event_id, round(CASE WHEN t < 1.5 THEN {_cos01('(-0.75)', 'dep', 't / 1.5')} WHEN t < 1.7 THEN dep WHEN t < 3.7 THEN {_cos01('dep', '(-dep)', '(t - 1.5 - 0.2) / 2.0')} ELSE -dep END, 6) AS height,
 round(CASE WHEN t < 1.6 THEN pi() * (t / 1.6 - 1) ELSE pi() * (t - 1.6) / (4.25 - 1.6) END, 6) + 0.0 AS phase FROM b""")
def breath_belt(spark, sf_dir) -> DataFrame:
    b = timed(spark, sf_dir).select("event_id", ((F.col("event_id") % 17) * 0.25).alias("t"), (1.0 + F.col("x") / 500).alias("dep"))
    one = lambda v: F.lit(float(v))
    return b.select("event_id", r(X.belt(F.col("t"), one(1.5), one(0.2), one(2.0), one(0.75), F.col("dep"))).alias("height"), r(X.breath_phase(F.col("t"), one(1.5), one(0.2), one(4.25))).alias("phase"))


@query(f"""WITH {TIMED}, b AS (SELECT event_id, (event_id % 40) * 0.05 AS t, x FROM timed), u AS (SELECT *, t / 1.2 AS u, t / 1.8 AS v FROM b)
 SELECT event_id, round(CASE WHEN u >= 0 AND u < 1 THEN (0.5 - 0.5 * cos(2 * pi() * u)) * sin(2 * pi() * (13.0 * t - 0.5 * t * u / 2) + 0.3) ELSE 0 END, 6) + 0.0 AS spindle,
 round(CASE WHEN v >= 0 AND v < 1 THEN -sin(2 * pi() * CASE WHEN v < 0.4 THEN v / 0.4 / 2 ELSE 0.5 + (v - 0.4) / 0.6 / 2 END) ELSE 0 END, 6) + 0.0 AS slow,
 round(CASE WHEN abs((t - 0.5) / 0.1) <= 4 THEN exp(-0.5 * pow((t - 0.5) / 0.1, 2)) ELSE 0 END, 6) AS bump FROM u""")
def event_waveforms(spark, sf_dir) -> DataFrame:
    t = (F.col("event_id") % 40) * 0.05
    one = lambda v: F.lit(float(v))
    return timed(spark, sf_dir).select("event_id", r(X.spindle_wave(t, one(1.2), one(13.0), one(0.5), one(0.3))).alias("spindle"), r(X.slow_wave(t, one(1.8), one(0.4))).alias("slow"), r(X.gaussian(t, one(0.5), one(0.1))).alias("bump"))


@query("SELECT p_partkey, round(pow(p_size, 1.0 / 1.7), 6) AS knee, round(ln(p_size / 1.0) / ln(50.0), 6) AS unit, round(1.0 * pow(50.0, p_size / 50.0), 5) AS back, round(pow(p_size / 50.0, 2) * (3 - 2 * (p_size / 50.0)), 6) AS smooth FROM part")
def axis_expressions(spark, sf_dir) -> DataFrame:
    s = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", r(X.knee_frequency(s, F.lit(1.7))).alias("knee"), r(X.to_unit(s, 1.0, 50.0)).alias("unit"), r(X.from_unit(s / 50, 1.0, 50.0), 5).alias("back"), r(X.smoothstep(s / 50)).alias("smooth"))


@query("""WITH g AS (SELECT i, log10(1.0) + (log10(45.0) - log10(1.0)) * i / 399.0 AS x FROM (SELECT unnest(range(400)) AS i)), s AS (SELECT n_nationkey, 0.5 + 0.1 * n_nationkey AS chi FROM nation)
 SELECT n_nationkey, round(-regr_slope(-log10(2.0 + pow(10, x * chi)), x), 5) AS slope FROM s, g GROUP BY n_nationkey""")
def model_slope(spark, sf_dir) -> DataFrame:
    chi = 0.5 + 0.1 * F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", r(stats.analytic_slope(chi, F.lit(2.0), 1.0, 45.0), 5).alias("slope"))


_COVARIANCES = "v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT a.label, a.k AS a, b.k AS b, covar_pop(a.x, b.x) AS c FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3)"


@query(f"WITH {_COVARIANCES} SELECT label, round(pow(sum(CASE WHEN a = b THEN c ELSE 0 END), 2) / sum(c * c), 5) AS rank FROM c GROUP BY label")
def effective_rank(spark, sf_dir) -> DataFrame:
    return channels.effective_rank(pairs.covariances(table(spark, sf_dir, "embeddings"), "embedding", ["label"]), ["label"]).select("label", r("rank", 5).alias("rank"))


@query(f"WITH {SIG}, few AS (SELECT * FROM sig) SELECT a.ch AS a, b.ch AS b, round(corr(a.x, b.x), 5) + 0.0 AS r, count(*) AS n FROM few a JOIN few b ON a.i = b.i AND a.ch < b.ch GROUP BY 1, 2")
def pair_correlations(spark, sf_dir) -> DataFrame:
    return pairs.correlations(signal(spark, sf_dir)).select("a", "b", near("r", 5).alias("r"), "n")


@query(f"""WITH {_frames(16, 8)}, w AS (SELECT ch, frame, k, (x - avg(x) OVER (PARTITION BY ch, frame)) * 0.5 * (1 - cos(2 * pi() * k / 15.0)) AS y FROM fr),
 z AS (SELECT w.ch, w.frame, b.k, sum(y * cos(2 * pi() * b.k * w.k / 16.0)) AS re, -sum(y * sin(2 * pi() * b.k * w.k / 16.0)) AS im FROM w, (SELECT unnest([2, 3, 4]) AS k) b GROUP BY 1, 2, 3),
 p AS (SELECT a.ch AS a, b.ch AS b, a.k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, a.re * a.re + a.im * a.im AS pa, b.re * b.re + b.im * b.im AS pb FROM z a JOIN z b ON a.frame = b.frame AND a.k = b.k AND a.ch < b.ch)
 SELECT a, b, CAST(k AS INTEGER) AS k, round(sqrt(pow(sum(re), 2) + pow(sum(im), 2)) / sqrt(sum(pa) * sum(pb)), 5) AS coherence,
 round(CASE WHEN pow(sum(abs(im)), 2) - sum(im * im) <= 0 THEN 0 ELSE least(1, greatest(0, (pow(sum(im), 2) - sum(im * im)) / (pow(sum(abs(im)), 2) - sum(im * im)))) END, 5) AS dwpli FROM p GROUP BY 1, 2, 3""")
def connectivity(spark, sf_dir) -> DataFrame:
    return pairs.connectivity(signal(spark, sf_dir), FS, 16, 1.0, 2.0).select("a", "b", "k", near("coherence", 5).alias("coherence"), near("dwpli", 5).alias("dwpli"))


@query()
def recovered_lag(spark, sf_dir) -> DataFrame:
    return pairs.recovered_lag(signal(spark, sf_dir), FS, 16, 0.5, 3.0).select("a", "b", near("lag_s", 5).alias("lag_s"))


@query(f"""WITH {SIG}, ph AS (SELECT ch, i, 2 * pi() * x / 100 AS phase, count(*) OVER (PARTITION BY ch) AS n FROM sig), s AS (SELECT unnest(range(0, 10)) AS shift),
 e AS (SELECT a.ch AS a, b.ch AS b, s.shift, sqrt(pow(sum(cos(a.phase - b.phase)), 2) + pow(sum(sin(a.phase - b.phase)), 2)) / count(*) AS v FROM ph a CROSS JOIN s JOIN ph b ON a.ch < b.ch AND b.i = (a.i + CAST(floor(s.shift * a.n / 10.0) AS BIGINT)) % a.n GROUP BY 1, 2, 3),
 o AS (SELECT a, b, v AS own FROM e WHERE shift = 0) SELECT e.a, e.b, round(max(own), 5) AS plv, round((sum(CASE WHEN shift > 0 AND v >= own THEN 1 ELSE 0 END) + 1) / 10.0, 4) AS p FROM e JOIN o ON e.a = o.a AND e.b = o.b GROUP BY 1, 2""")
def phase_locking(spark, sf_dir) -> DataFrame:
    ph = signal(spark, sf_dir).select("ch", "i", (2 * math.pi * F.col("x") / 100).alias("x"))
    return pairs.phase_locking(ph, 9).select("a", "b", near("plv", 5).alias("plv"), near("p", 4).alias("p"))


@query()
def lempel_ziv(spark, sf_dir) -> DataFrame:
    s = windows.binarized(signal(spark, sf_dir)).select("ch", "i", F.col("s").alias("x"))
    return channels.complexity(spectra.records(s)).select("ch", "n", "ones", "raw", r("ratio").alias("ratio"))


@query()
def lempel_ziv_welch(spark, sf_dir) -> DataFrame:
    s = windows.binarized(signal(spark, sf_dir)).select("ch", "i", F.col("s").alias("x"))
    return channels.complexity(spectra.records(s), "lzw").select("ch", "n", "ones", "raw", r("ratio").alias("ratio"))
