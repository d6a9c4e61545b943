"""How a band's amplitude and the background's exponent follow a slow phase, from samples to readout."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import dsp
from tideline.operators import samples as S
from tideline.operators import readouts, scans, spectra, stats
from tideline.operators.beats import haloed
from tideline.sources import epochs
from tideline.sources.written import written


def band_limited(samples: DataFrame, lo: float, hi: float, fs: float, order: int = 4, size: int = scans.CHUNK) -> DataFrame:
    """Samples of a band, every section forth and back over time chunks."""
    return scans.unchunked(scans.filtered_in_turn(scans.chunks(samples, size), dsp.sections(fs, lo, hi, order), both_ways=True), size)


def envelope(samples: DataFrame, half: int, size: int = scans.CHUNK) -> DataFrame:
    """(ch, i, x): running RMS over i - half .. i + half, truncated at the record's ends, in time chunks."""
    kind = samples.schema["ch"].dataType.simpleString()

    def levels(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for ch, chunk, first, xs in zip(batch["ch"], batch["chunk"], batch["first"], batch["xs"], strict=True):
                x, lead = np.asarray(xs, float), chunk * size - first
                total, n = np.r_[0.0, np.cumsum(x * x)], len(x)
                at = np.arange(lead, min(n, lead + size))
                a, b = np.maximum(0, at - half), np.minimum(n, at + half + 1)
                yield ch, at + first, np.sqrt((total[b] - total[a]) / (b - a))

    return haloed(samples, size, half + 1).mapInPandas(lambda batches: scans.sent(levels(batches)), f"ch {kind}, i long, x double")


def band_amplitude_harmonic(samples: DataFrame, phases: DataFrame, lo: float, hi: float, fs: float, order: int = 4, size: int = scans.CHUNK) -> DataFrame:
    """(ch, depth, max_phase, amplitude): the band is taken first, then its envelope, and of that the first harmonic of the phase (ch, i, phase).

    depth is 2 |mean of envelope times e^(i phase)| over the mean envelope: d for 1 + d cos(phase). Without an envelope all are null.
    """
    half = round(fs / max(hi - lo, 1.0)) >> 1
    own = envelope(band_limited(samples, lo, hi, fs, order, size), half, size).join(phases.select("ch", "i", "phase"), ["ch", "i"])
    re, im, mean = F.avg(F.col("x") * F.cos("phase")), F.avg(F.col("x") * F.sin("phase")), F.avg("x")
    sums = own.groupBy("ch").agg(re.alias("re"), im.alias("im"), mean.alias("mean"))
    some = lambda v: F.when(F.col("mean") > 0, v)
    return sums.select("ch", some(2 * F.hypot("re", "im") / F.col("mean")).alias("depth"), some(F.atan2("im", "re")).alias("max_phase"), some(F.col("mean")).alias("amplitude"))


def periodic_vector(fits: DataFrame) -> DataFrame:
    """(ch, mean, cosine, sine, amplitude, phase) of band amplitude harmonics."""
    return fits.select("ch", F.col("amplitude").alias("mean"), (F.col("depth") * F.cos("max_phase")).alias("cosine"), (F.col("depth") * F.sin("max_phase")).alias("sine"), F.col("depth").alias("amplitude"), F.col("max_phase").alias("phase"))


def exponent_harmonic(samples: DataFrame, phases: DataFrame, fs: float, window_s: float, hop_s: float, lo: float, hi: float) -> DataFrame:
    """(ch, mean, cosine, sine, amplitude, phase): the exponent over time against the phase (ch, i, phase) at each window's centre, by mean, cosine and sine.

    A centre behind the last phase has that one; windows without an exponent take no part.
    """
    kind = samples.schema["ch"].dataType.simpleString()
    chi = spectra.exponent_over_time(samples, fs, window_s, hop_s, lo, hi, kind).where(~F.isnan("chi"))
    last = phases.groupBy("ch").agg(F.max("i").alias("_last"))
    at = F.least(F.col("_last"), F.col("frame") * round(hop_s * fs) + round(window_s * fs / 2))
    met = chi.join(last, "ch").select("ch", "chi", at.alias("i")).join(phases.select("ch", "i", "phase"), ["ch", "i"])
    fit = stats.harmonic3(met, ["ch"], "phase", "chi")
    return fit.select("ch", F.col("intercept").alias("mean"), "cosine", "sine", F.hypot("cosine", "sine").alias("amplitude"), F.atan2("sine", "cosine").alias("phase"))


def vector_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What one arm's harmonic has over another's, as vectors: amplitude and phase are those of the difference."""
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("mean", "cosine", "sine")])
    cut = a.join(other, keys).select(*keys, *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in ("mean", "cosine", "sine")])
    return cut.select(*keys, "mean", "cosine", "sine", F.hypot("cosine", "sine").alias("amplitude"), F.atan2("sine", "cosine").alias("phase"))


def exponent_job(signal: DataFrame, channel: str, fs: float, rates: list[float], mode: str = "linked-mastoid", window_s: float = 2.0, hop_s: float = 0.25, lo: float = 0.5, hi: float = 3.5) -> DataFrame:
    """(run_id, frames, rate, depth): samples (run_id, channel, i, x) referenced, one channel's exponent over time, and its modulation at each rate."""
    kind = signal.schema["run_id"].dataType.simpleString()
    own = S.rereferenced(signal, mode, ["run_id", "i"]).where(F.col("channel") == channel).select(F.col("run_id").alias("ch"), "i", "x")
    chi = spectra.exponent_over_time(own, fs, window_s, hop_s, lo, hi, kind)
    frames, out = chi.groupBy("ch").agg(F.count("*").alias("frames")), None
    for rate in rates:
        one = spectra.modulation_depth(chi, "chi", rate, hop_s).withColumn("rate", F.lit(rate))
        out = one if out is None else out.unionByName(one)
    return frames.join(out, "ch").select(F.col("ch").alias("run_id"), "frames", "rate", "depth")


def exponent_job_of_epochs(table: DataFrame, channel: str, rates: list[float], **how) -> DataFrame:
    """The same from stored epochs, which must follow each other without gaps and agree on channels and rate."""
    broken = epochs.gaps(table).limit(1).collect()
    if broken:
        raise ValueError(f"run {broken[0]['run_id']}: epoch {broken[0]['epoch']} doesn't continue the one before")
    rate = table.select("fs").distinct().limit(2).collect()
    if len(rate) != 1:
        raise ValueError("epochs must have one sampling rate")
    return exponent_job(epochs.samples(table), channel, rate[0]["fs"], rates, **how)


def alpha_metrics(samples: DataFrame, lo: float, hi: float, fs: float, longest: int, order: int = 4, size: int = scans.CHUNK) -> DataFrame:
    """(ch, level, bimodality, lag): of the band's envelope its mean, how bimodal it is, and the first lag at which its autocorrelation has fallen to 1 / e."""
    own = written(envelope(band_limited(samples, lo, hi, fs, order, size), round(fs / max(hi - lo, 1.0)) >> 1, size))
    level = own.groupBy("ch").agg(F.avg("x").alias("level"))
    return level.join(readouts.envelope_shape(own).select("ch", "bimodality"), "ch", "left").join(readouts.folding_lag(own, longest), "ch", "left")
