"""Queries over long recordings: filters by chunks, overviews, spatial summaries, beats, complexity, stage epochs, provenance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import dsp
from tideline.operators import beats, channels, coupling, overview, samples, scans, spatial, spectra, windows
from tideline.plans import spectral
from tideline.plans.base import SIG, TIMED, Book, r, signal, table, timed
from tideline.sources import edf, montage, params

BOOK = Book()
query, QUERIES, SQL = BOOK.query, BOOK.QUERIES, BOOK.SQL
#: Sampling rate at which events are read as samples, and its multiple for beats.
FS, FAST = 8.0, 64.0
STAGES = {"signup": "wake", "view": "n1", "click": "n2", "purchase": "rem"}
#: Bins and frames of the spectra whose likeness is summed up.
FRAME, BANDED = 16, range(1, 5)


@query()
def band_passed(spark, sf_dir) -> DataFrame:
    """Fourth-order band-pass of whole records, forth and back, with reflected ends."""
    return scans.filtered_whole(signal(spark, sf_dir), dsp.butterworth_bandpass(4, 0.3, 3.5, FS)).select("ch", "i", r("x", 5).alias("x"))


@query(f"""WITH {SIG}, p0 AS (SELECT ch, i // 2 AS k, round(x, 6) AS lo, round(x, 6) AS hi, 1 AS n FROM sig WHERE i % 2 = 0),
 p1 AS (SELECT ch, k // 4 AS k, min(lo) AS lo, max(hi) AS hi, sum(n) AS n FROM p0 GROUP BY 1, 2), p2 AS (SELECT ch, k // 4 AS k, min(lo) AS lo, max(hi) AS hi, sum(n) AS n FROM p1 GROUP BY 1, 2)
 SELECT 0 AS level, ch, k, lo, hi, CAST(n AS BIGINT) AS n FROM p0 UNION ALL SELECT 1, ch, k, lo, hi, CAST(n AS BIGINT) FROM p1 UNION ALL SELECT 2, ch, k, lo, hi, CAST(n AS BIGINT) FROM p2""")
def overview_extremes(spark, sf_dir) -> DataFrame:
    """Every second sample and two levels of extremes above."""
    return overview.pyramid(signal(spark, sf_dir), 2, levels=3).select("level", "ch", "k", r("lo").alias("lo"), r("hi").alias("hi"), "n")


@query()
def overview_arms(spark, sf_dir) -> DataFrame:
    """Both arms of the overview at half the rate, under views of 120, 300 and 600 seconds on 64 pixels."""
    arms = overview.arms(signal(spark, sf_dir), FS, 1.5, 0.1)
    built, out = overview.pyramid(arms, overview.stride_of(FS, 4.0), keys=("arm", "ch")), None
    for seconds in (120.0, 300.0, 600.0):
        seen = overview.view(built, 4.0, 0.0, seconds, 64, keys=("arm", "ch")).withColumn("seconds", F.lit(seconds))
        out = seen if out is None else out.unionByName(seen)
    return out.select("arm", "ch", "seconds", "pixel", r("lo", 5).alias("lo"), r("hi", 5).alias("hi"))


_TURN = 2 * math.pi / FRAME


@query(f"""WITH {SIG}, whole AS (SELECT ch, count(*) // {FRAME} AS frames FROM sig GROUP BY ch), f AS (SELECT sig.ch, i // {FRAME} AS frame, i % {FRAME} AS k, x FROM sig JOIN whole USING (ch) WHERE i // {FRAME} < frames),
 z AS (SELECT ch, frame * {FRAME} + b AS k, sum(x * cos({_TURN!r}::DOUBLE * k * b)) AS re, sum(x * sin({_TURN!r}::DOUBLE * k * b)) AS im FROM f, (SELECT unnest(range({BANDED.start}, {BANDED.stop})) AS b) GROUP BY ch, frame, b),
 c AS (SELECT a.ch AS a, b.ch AS b, sum(a.re * b.re + a.im * b.im) AS c FROM z a JOIN z b ON a.k = b.k AND a.ch <= b.ch GROUP BY 1, 2),
 t AS (SELECT count(*) FILTER (a = b) AS channels, sum(CASE WHEN a = b THEN c ELSE 0 END) AS trace, sum(CASE WHEN a = b THEN c * c ELSE 2 * c * c END) AS square FROM c),
 m AS (SELECT quantile_cont(abs(c.c) / sqrt(x.c * y.c), 0.5) AS correlation FROM c JOIN c x ON x.a = c.a AND x.b = c.a JOIN c y ON y.a = c.b AND y.b = c.b WHERE c.a < c.b AND x.c * y.c > 0)
 SELECT channels, round(trace * trace / square, 5) AS rank, round(correlation, 5) AS correlation FROM t, m""")
def spatial_summary(spark, sf_dir) -> DataFrame:
    """How alike the channels' spectra are in a band: effective rank and typical correlation over all pairs."""
    cut = windows.frames(signal(spark, sf_dir), FRAME, FRAME)
    sums = [f(F.col("x") * g(F.col("k") * (_TURN * b))).alias(f"{n}{b}") for b in BANDED for f, g, n in ((F.sum, F.cos, "c"), (F.sum, F.sin, "s"))]
    bins = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.col(f"c{b}").alias("re"), F.col(f"s{b}").alias("im")) for b in BANDED])).alias("z")
    spectra = cut.groupBy("ch", "frame").agg(*sums).select("ch", "frame", bins).select("ch", (F.col("frame") * FRAME + F.col("z.b")).alias("k"), "z.re", "z.im")
    return spatial.spatial_summary(spectra).select("channels", r("rank", 5).alias("rank"), r("correlation", 5).alias("correlation"))


@query()
def beat_peaks(spark, sf_dir) -> DataFrame:
    """Beats by the energy of the QRS band."""
    return beats.qrs_peaks(signal(spark, sf_dir), FAST).select("ch", "i", r("height", 4).alias("height"), r("prominence", 4).alias("prominence"))


@query(f"""WITH {TIMED}, b AS (SELECT ch, row_number() OVER (PARTITION BY ch ORDER BY t, event_id) - 1 AS i, x AS rate, phase FROM timed), m AS (SELECT ch, avg(rate) AS mean, count(*) AS beats FROM b GROUP BY ch),
 e AS (SELECT ch, i, rate - mean AS ac, mean, beats, phase, unnest(range(-1, 50)) AS rep FROM b JOIN m USING (ch)),
 a AS (SELECT *, CASE WHEN rep < 0 THEN phase ELSE CAST(CAST('0x' || substr(md5(concat_ws(':', 0, ch, rep, i)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE * {2 * math.pi!r}::DOUBLE END AS ang FROM e),
 d AS (SELECT ch, beats, rep, 2 * sqrt(pow(avg(ac * cos(ang)), 2) + pow(avg(ac * sin(ang)), 2)) / any_value(mean) AS d FROM a GROUP BY 1, 2, 3)
 SELECT ch, beats, round(max(CASE WHEN rep < 0 THEN d END), 6) AS depth, round(quantile_cont(CASE WHEN rep >= 0 THEN d END, 0.95), 6) AS p95 FROM d GROUP BY 1, 2""")
def phase_shuffled_null(spark, sf_dir) -> DataFrame:
    """Events as beats: how their value swings with the day's phase, against 50 draws of random phases."""
    from pyspark.sql.window import Window

    place = (F.row_number().over(Window.partitionBy("ch").orderBy("t", "event_id")) - 1).cast("bigint")
    own = timed(spark, sf_dir).select("ch", place.alias("i"), F.col("x").alias("rate"), "phase")
    return beats.shuffled_phase_null(own, 50).select("ch", "beats", r("depth").alias("depth"), r("p95").alias("p95"))


@query()
def interleaved_complexity(spark, sf_dir) -> DataFrame:
    """Runs of 21 users as channels: one record of all channels, sample by sample, against shuffles of the same length and density."""
    s = windows.binarized(signal(spark, sf_dir)).select(F.floor(F.col("ch") / 21).alias("run"), (F.col("ch") % 21).alias("place"), "i", "s")
    return channels.complexity(channels.interleaved(s), "lzw").select(F.col("ch").alias("run"), "n", "ones", "raw", r("ratio").alias("ratio"))


@query(f"""WITH {TIMED}, a AS (SELECT ch, t % 86400 AS onset, floor(floor(x) / 30) AS whole, CASE type WHEN 'signup' THEN 'wake' WHEN 'view' THEN 'n1' WHEN 'click' THEN 'n2' WHEN 'purchase' THEN 'rem' END AS state FROM timed),
 e AS (SELECT ch, state, onset + 30 * unnest(range(CAST(whole AS BIGINT))) AS moment FROM a WHERE state IS NOT NULL AND whole > 0)
 SELECT CAST(ch AS VARCHAR) AS file, state, CAST(count(*) AS BIGINT) AS epochs, CAST(min(moment) * 4 AS BIGINT) AS first, CAST(max(moment) * 4 AS BIGINT) AS last FROM e GROUP BY 1, 2""")
def staged_epochs(spark, sf_dir) -> DataFrame:
    """Events as annotations of a user's day: whole epochs of 30 seconds inside them, by state."""
    notes = timed(spark, sf_dir).select(F.col("ch").cast("string").alias("file"), (F.col("t") % 86400).cast("double").alias("onset"), F.col("x").alias("duration"), F.col("type").alias("description"))
    return edf.epochs(notes, STAGES, 4.0).groupBy("file", "state").agg(F.count("*").alias("epochs"), F.min("first").alias("first"), F.max("first").alias("last"))


@query("""SELECT l_orderkey AS metric, bool_or(p_size <= 3 OR p_size % 10 = 7) AS provisional FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def metric_provenance(spark, sf_dir) -> DataFrame:
    """Orders as metrics that rest on the parts in them; by their size some parts are invented numbers and some pending ones."""
    closure = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("metric"), F.col("l_partkey").alias("key"))
    registry = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") <= 3, "invented").otherwise("measured").alias("standing"), F.when(F.col("p_size") % 10 == 7, "pending").otherwise("scalar").alias("kind"))
    return params.provisional_metrics(closure, registry)


def phases(spark, sf_dir, period: float = 20.0) -> DataFrame:
    """(ch, i, phase): a slow phase that turns once in `period` samples."""
    return signal(spark, sf_dir).select("ch", "i", (F.col("i") * (2 * math.pi / period)).alias("phase"))


@query()
def band_amplitude_coupling(spark, sf_dir) -> DataFrame:
    """Band, envelope and first harmonic in one go."""
    fits = coupling.band_amplitude_harmonic(signal(spark, sf_dir), phases(spark, sf_dir), 0.5, 2.0, FS)
    return fits.select("ch", r("depth", 5).alias("depth"), r("max_phase", 4).alias("max_phase"), r("amplitude", 4).alias("amplitude"))


_CHI = "WITH " + spectral._psd(16, 2, range(1, 9), FS, "ch, frame", 1) + ", chi AS (SELECT ch, frame, -regr_slope(log10(power), log10(freq)) AS chi, count(*) AS bins FROM psd WHERE freq >= 0.5 AND freq <= 3.5 AND power > 0 GROUP BY ch, frame)"


@query(_CHI + f""", p AS (SELECT chi.ch, chi, least(n - 1, frame * 2 + 8) * {2 * math.pi / 20.0!r}::DOUBLE AS phase FROM chi JOIN len ON len.ch = chi.ch WHERE bins >= 4),
 g AS (SELECT ch, count(*) AS n, var_pop(cos(phase)) AS cc, var_pop(sin(phase)) AS ss, covar_pop(cos(phase), sin(phase)) AS cs, covar_pop(cos(phase), chi) AS cy, covar_pop(sin(phase), chi) AS sy, avg(chi) AS m, avg(cos(phase)) AS mc, avg(sin(phase)) AS ms FROM p GROUP BY ch),
 b AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS bc, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS bs FROM g WHERE n >= 12)
 SELECT ch, round(m - bc * mc - bs * ms, 4) + 0.0 AS mean, round(bc, 4) + 0.0 AS cosine, round(bs, 4) + 0.0 AS sine, round(sqrt(bc * bc + bs * bs), 4) AS amplitude FROM b""")
def exponent_harmonic(spark, sf_dir) -> DataFrame:
    """The exponent over time against a slow phase at the windows' centres, of channels of 12 windows or more."""
    long = signal(spark, sf_dir).groupBy("ch").agg(F.count("*").alias("n")).where(F.floor((F.col("n") - 16) / 2) >= 12).select("ch")
    fit = coupling.exponent_harmonic(signal(spark, sf_dir).join(long, "ch", "left_semi"), phases(spark, sf_dir), FS, 2.0, 0.25, 0.5, 3.5)
    return fit.select("ch", *[r(c, 4).alias(c) for c in ("mean", "cosine", "sine", "amplitude")])


_RUNS = SIG.replace("sig AS", "all_sig AS") + ", sig AS (SELECT a.ch // 3 AS ch, a.i, a.x - (b.x + c.x) / 2 AS x FROM all_sig a JOIN all_sig b ON b.ch = a.ch + 1 AND b.i = a.i JOIN all_sig c ON c.ch = a.ch + 2 AND c.i = a.i WHERE a.ch % 3 = 0)"


@query(_CHI.replace(SIG, _RUNS) + f""", hw AS (SELECT ch, frame, CASE WHEN bins >= 4 THEN chi END AS chi, 0.5 * (1 - cos(2 * pi() * frame / count(*) OVER (PARTITION BY ch))) AS w, {2 * math.pi * 0.5 * 0.25!r}::DOUBLE * frame AS turn FROM chi)
 SELECT ch AS run, count(*) AS frames, CASE WHEN count(chi) >= 8 THEN round(2 * sqrt(pow(sum(w * chi * cos(turn)), 2) + pow(sum(w * chi * sin(turn)), 2)) / sum(CASE WHEN chi IS NOT NULL THEN w END), 4) END AS depth FROM hw GROUP BY ch""")
def exponent_job(spark, sf_dir) -> DataFrame:
    """Three users are a run: one is referenced to the mean of the others, then its exponent over time and how far that is modulated."""
    names = F.element_at(F.array(F.lit("C3"), F.lit("A1"), F.lit("A2")), (F.col("ch") % 3 + 1).cast("int"))
    s = signal(spark, sf_dir).select(F.floor(F.col("ch") / 3).alias("run_id"), names.alias("channel"), "i", "x")
    whole = s.groupBy("run_id", "i").agg(F.count("*").alias("n")).where("n = 3").select("run_id", "i")
    got = coupling.exponent_job(s.join(whole, ["run_id", "i"]), "C3", FS, [0.5])
    return got.select(F.col("run_id").alias("run"), "frames", r("depth", 4).alias("depth"))


@query()
def spectral_peaks(spark, sf_dir) -> DataFrame:
    """Each channel's spectrum as background and peaks."""
    fits = spectra.peak_fits(spectral.psd(spark, sf_dir), 0.25, 4.0).where("exponent is not null")
    return fits.select("ch", r("offset", 4).alias("offset"), r("exponent", 4).alias("exponent"), r("r2", 4).alias("r2"), F.size("peaks").alias("peaks"))


@query()
def exponent_estimators(spark, sf_dir) -> DataFrame:
    """Five estimates of each channel's exponent."""
    return spectra.exponents(spectral.psd(spark, sf_dir), (2.0, 4.0), (0.5, 4.0), (0.5, 1.5), (2.0, 3.5)).select("ch", "estimator", r("chi", 4).alias("chi"))


@query()
def alpha_metrics(spark, sf_dir) -> DataFrame:
    """The shape of a band's envelope."""
    got = coupling.alpha_metrics(signal(spark, sf_dir), 0.75, 1.75, FS, 8)
    return got.select("ch", r("level", 4).alias("level"), r("bimodality", 4).alias("bimodality"), "lag")


_PLACES = "montage(channel, x, y, place) AS (VALUES " + ", ".join(f"('{c}', {x}::DOUBLE, {y}::DOUBLE, {i})" for i, (c, x, y) in enumerate(montage.PLACES) if c in montage.SCALP) + ")"


@query(f"""WITH {SIG}, {_PLACES}, n AS (SELECT a.channel, b.channel AS other, row_number() OVER (PARTITION BY a.channel ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.place) AS k FROM montage a JOIN montage b ON a.channel <> b.channel),
 s AS (SELECT ch // 19 AS run, i, channel, sig.x FROM sig JOIN montage ON place = ch % 19)
 SELECT a.run, a.i, a.channel, round(max(a.x) - avg(b.x), 5) + 0.0 AS x FROM s a JOIN n ON n.channel = a.channel AND n.k <= 4 JOIN s b ON b.run = a.run AND b.i = a.i AND b.channel = n.other GROUP BY 1, 2, 3""")
def laplacian_of_a_montage(spark, sf_dir) -> DataFrame:
    """Nineteen users are a montage: every channel less the mean of its four nearest."""
    names = F.element_at(F.array(*[F.lit(c) for c in montage.SCALP]), (F.col("ch") % 19 + 1).cast("int"))
    s = signal(spark, sf_dir).select(F.floor(F.col("ch") / 19).alias("run"), "i", names.alias("channel"), "x")
    near = samples.nearest(montage.table(spark).where(F.col("channel").isin(*montage.SCALP)), 4)
    return samples.rereferenced(s, "laplacian", ["run", "i"], near).select("run", "i", "channel", r("x", 5).alias("x"))
