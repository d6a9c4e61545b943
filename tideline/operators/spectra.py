"""Spectra and what is fitted to them. Transforms run in NumPy, a frame or a record a row; fits stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import dsp, peaks
from tideline.operators import scans
from tideline.operators.windows import frames
from tideline.sources.written import written

#: Frames of a stretch, and rows that kernels' results are sent in.
FRAMES, ROWS = 256, 1 << 15


def records(samples: DataFrame) -> DataFrame:
    """(ch, xs): a record's samples in order, one row a channel, which is the unit that recursions and transforms need whole."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return samples.groupBy("ch").agg(pairs.alias("_p")).select("ch", F.transform("_p", lambda p: p["x"]).alias("xs"))


def per_record(table: DataFrame, kernel, schema: str, channel: str) -> DataFrame:
    """kernel(array) gives columns, or values that stand in all its rows; a row of the table becomes the kernel's rows under its channel. About ROWS of them are sent at once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            own, chs, size = [], [], 0
            for ch, xs in zip(batch["ch"], batch["xs"], strict=True):
                got = {n: np.asarray(v) for n, v in kernel(np.asarray(xs, float)).items()}
                own.append(got)
                rows = next((len(v) for v in got.values() if v.ndim), 1)
                chs.append((ch, rows))
                size += rows
                if size >= ROWS:
                    yield joined(chs, own)
                    own, chs, size = [], [], 0
            if own:
                yield joined(chs, own)

    def joined(chs, own):
        import numpy as np
        import pandas as pd

        rows = [n for _, n in chs]
        columns = {n: np.concatenate([g[n] if g[n].ndim else np.repeat(g[n], r) for g, r in zip(own, rows, strict=True)]) for n in own[0]}
        return pd.DataFrame({"ch": np.repeat(np.array([c for c, _ in chs]), rows), **columns})

    return table.select("ch", "xs").mapInPandas(run, f"ch {channel}, {schema}")


def welch(samples: DataFrame, fs: float, nperseg: int, noverlap: int, channel: str = "long") -> DataFrame:
    """(ch, k, freq, power): mean over frames of the windowed, mean-free, one-sided periodogram; symmetric Hann. A record
    shorter than a frame gives one frame of its own length.

    Frames are dealt in stretches, whose sums are added up, so that no row holds a whole record.
    """

    def kernel(x):
        import numpy as np

        if not len(x):
            return {"k": [], "freq": [], "total": [], "frames": []}
        power, size = dsp.frame_powers(x, fs, nperseg, noverlap), min(nperseg, len(x))
        k = np.arange(power.shape[1])
        return {"k": k, "freq": k * fs / size, "total": power.sum(0), "frames": len(power)}

    # A later stretch than the first that is shorter than a frame has the end of the record, and no frame.
    hop = nperseg - noverlap
    whole = scans.framed(samples, nperseg, hop).where((F.col("block") == 0) | (F.size("xs") >= nperseg))
    sums = per_record(whole, kernel, "k int, freq double, total double, frames long", channel)
    return sums.groupBy("ch", "k", "freq").agg((F.sum("total") / F.sum("frames")).alias("power"))


def periodogram(samples: DataFrame, fs: float, channel: str = "long") -> DataFrame:
    """The whole record, zero-padded to a power of two, under one symmetric Hann window."""
    return per_record(records(samples), lambda x: dict(zip(("k", "freq", "power"), dsp.periodogram(x, fs), strict=True)), "k int, freq double, power double", channel)


def hybrid(samples: DataFrame, fs: float, nperseg: int, channel: str = "long") -> DataFrame:
    """A long-window spectrum below 0.5 Hz and the standard one above 1 Hz, blended in log power between."""
    return per_record(records(samples), lambda x: dict(zip(("freq", "power"), dsp.hybrid(x, fs, nperseg), strict=True)), "freq double, power double", channel)


def symmetric_hann(k: Column, n: Column | int) -> Column:
    return F.lit(0.5) * (1 - F.cos(F.lit(2 * math.pi) * k / (F.lit(n) - 1)))


def dft(samples: DataFrame, size: int, hop: int, bins: list[int], fs: float) -> DataFrame:
    """Welch's power at a few bins without leaving the JVM: frames meet the bins' sines and cosines, one aggregate each."""
    cut = frames(samples, size, hop)
    mean = cut.groupBy("ch", "frame").agg(F.avg("x").alias("_m"))
    # Bins ride along in each row, so frames are read once.
    win = cut.join(mean, ["ch", "frame"]).withColumn("y", (F.col("x") - F.col("_m")) * symmetric_hann(F.col("k"), size))
    turn = lambda b: F.lit(2 * math.pi * b / size) * F.col("k")
    sums = [f(F.col("y") * g(turn(b))).alias(f"{n}{b}") for b in bins for f, g, n in ((F.sum, F.cos, "c"), (F.sum, F.sin, "s"))]
    whole = win.groupBy("ch", "frame").agg(*sums)
    scale = sum(0.25 * (1 - math.cos(2 * math.pi * i / (size - 1))) ** 2 for i in range(size)) * fs
    side = lambda b: 1.0 if b in (0, size / 2) else 2.0
    power = [F.avg(side(b) * (F.col(f"c{b}") * F.col(f"c{b}") + F.col(f"s{b}") * F.col(f"s{b}")) / scale).alias(f"p{b}") for b in bins]
    wide = whole.groupBy("ch").agg(*power)
    return wide.select("ch", F.explode(F.array(*[F.struct(F.lit(b).alias("k"), F.lit(b * fs / size).alias("freq"), F.col(f"p{b}").alias("power")) for b in bins])).alias("_b")).select("ch", "_b.*")


def in_band(lo: float, hi: float) -> Column:
    """Closed band of bins with power."""
    return (F.col("freq") >= lo) & (F.col("freq") <= hi) & (F.col("power") > 0)


def fit_fixed(psd: DataFrame, lo: float, hi: float, keys: list[str] | None = None) -> DataFrame:
    """Straight line through log power on log frequency: exponent chi = -slope, offset, r2 (0 for constant power), bins."""
    x, y = F.log10("freq"), F.log10("power")
    fit = psd.where(in_band(lo, hi) & (F.col("freq") > 0)).groupBy(*(keys or ["ch"])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.count("*").alias("bins"))
    return fit.select(*(keys or ["ch"]), (-F.col("slope")).alias("chi"), "offset", F.when(F.col("syy") == 0, 0.0).otherwise(F.col("r2")).alias("r2"), "bins")


def knee_grid() -> list[tuple[float, float]]:
    """(chi, log10 knee frequency) in search order; values come by repeated addition."""
    out, chi = [], 0.1
    while chi <= 4.0 + 1e-9:
        e = -1.0
        while e <= 2.0 + 1e-9:
            out.append((chi, e))
            e += 0.1
        chi += 0.05
    return out


def fit_knee(psd: DataFrame, lo: float, hi: float, channel: str = "long") -> DataFrame:
    """(ch, chi, knee, offset, r2) of log10 P = b - log10(k + f^chi) over a grid, the first strictly best r2.

    A spectrum's bins are few, so each channel's are one row, and the grid is searched inside it.
    """
    rows = psd.where(in_band(lo, hi)).groupBy("ch").agg(F.array_sort(F.collect_list(F.struct("freq", "power"))).alias("_b"))
    flat = rows.select("ch", F.flatten(F.transform("_b", lambda b: F.array(b["freq"], b["power"]))).alias("xs"))
    grid = tuple(knee_grid())
    return per_record(flat, lambda x: dsp.fit_knee(x[::2], x[1::2], grid), "chi double, knee double, offset double, r2 double", channel)


def exponent_over_time(samples: DataFrame, fs: float, window_s: float, hop_s: float, lo: float, hi: float, channel: str = "long") -> DataFrame:
    """(ch, frame, t, chi): line fits of sliding windows; the last whole window is left out, and under four bins chi is NaN."""

    size, hop = round(window_s * fs), round(hop_s * fs)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for ch, block, xs in zip(batch["ch"], batch["block"], batch["xs"], strict=True):
                chi = dsp.exponent_over_time(np.asarray(xs, float), fs, window_s, hop_s, lo, hi, last=True)
                frame = np.arange(len(chi)) + block * FRAMES
                yield pd.DataFrame({"ch": ch, "frame": frame, "t": frame * hop_s + window_s / 2, "chi": chi})

    fits = scans.framed(samples, size, hop, FRAMES).mapInPandas(run, f"ch {channel}, frame long, t double, chi double")
    n = samples.groupBy("ch").agg(F.floor((F.count("*") - size) / hop).alias("_frames"))
    return fits.join(n, "ch").where(F.col("frame") < F.col("_frames")).select("ch", "frame", "t", F.coalesce("chi", F.lit(float("nan"))).alias("chi"))


def modulation_depth(series: DataFrame, value: str, rate: float, step: float) -> DataFrame:
    """Amplitude of a series at one rate under a periodic Hann window: 2 |sum w v e^iwt| / sum w over its finite values; NaN under eight."""
    n = F.count("*").over(Window.partitionBy("ch"))
    w = F.lit(0.5) * (1 - F.cos(F.lit(2 * math.pi) * F.col("frame") / n))
    fine = F.col(value).isNotNull() & ~F.isnan(value)
    ok = series.withColumns({"_w": F.when(fine, w), "_v": F.when(fine, F.col(value))})
    turn = F.lit(2 * math.pi * rate * step) * F.col("frame")
    got = ok.groupBy("ch").agg(F.sum(F.col("_w") * F.col("_v") * F.cos(turn)).alias("c"), F.sum(F.col("_w") * F.col("_v") * F.sin(turn)).alias("s"), F.sum("_w").alias("w"), F.count("_v").alias("n"))
    return got.select("ch", F.when(F.col("n") >= 8, 2 * F.hypot("c", "s") / F.col("w")).otherwise(F.lit(float("nan"))).alias("depth"))


def smoothed_bins(psd: DataFrame, radius: int = 2) -> DataFrame:
    """Power under a triangular kernel over neighbouring bins, renormalised at the edges."""
    w = Window.partitionBy("ch").orderBy("k")
    parts = [(radius + 1 - abs(d), F.lag("power", -d).over(w) if d else F.col("power")) for d in range(-radius, radius + 1)]
    top = sum((F.coalesce(p * weight, F.lit(0.0)) for weight, p in parts), F.lit(0.0))
    bottom = sum((F.when(p.isNotNull(), float(weight)).otherwise(0.0) for weight, p in parts), F.lit(0.0))
    return psd.withColumn("power", top / bottom)


def band_power(psd: DataFrame, bands: dict[str, tuple[float, float]], total: tuple[float, float]) -> DataFrame:
    """Trapezoid over [lo, hi) of each band, and its share of the total band."""
    w = Window.partitionBy("ch").orderBy("freq")

    def area(lo: float, hi: float) -> Column:
        inside = (F.col("freq") >= lo) & (F.col("_f") < hi)
        return F.sum(F.when(inside, (F.col("power") + F.col("_p")) / 2 * (F.col("_f") - F.col("freq"))).otherwise(0.0))

    got = psd.withColumns({"_p": F.lead("power").over(w), "_f": F.lead("freq").over(w)}).groupBy("ch").agg(area(*total).alias("_total"), *[area(*b).alias(n) for n, b in bands.items()])
    return got.select("ch", *bands, *[(F.col(n) / F.col("_total")).alias(f"{n}_share") for n in bands])


def interpolated_power(psd: DataFrame, at: list[float]) -> DataFrame:
    """Power at given frequencies, linear in frequency and log in power, clamped to the spectrum's ends."""
    w = Window.partitionBy("ch").orderBy("freq")
    ends = Window.partitionBy("ch")
    pairs = psd.withColumns({"_f": F.lead("freq").over(w), "_p": F.lead("power").over(w), "_lo": F.min("freq").over(ends), "_hi": F.max("freq").over(ends)})
    asked = pairs.withColumn("f", F.explode(F.array(*[F.lit(float(a)) for a in at])))
    held = asked.withColumn("g", F.least("_hi", F.greatest("_lo", "f"))).where("(freq <= g and g < _f) or (g = freq and _f is null)")
    u = F.when(F.col("_f").isNull(), 0.0).otherwise((F.col("g") - F.col("freq")) / (F.col("_f") - F.col("freq")))
    return held.select("ch", "f", F.exp(F.log("power") * (1 - u) + F.log(F.coalesce("_p", "power")) * u).alias("power"))


def peak_prominence(psd: DataFrame, lo: float, hi: float, fit: tuple[float, float]) -> DataFrame:
    """The bin in [lo, hi] that stands highest over the line fitted to the bins of `fit` outside it."""
    outside = psd.where(~F.col("freq").between(lo, hi))
    line = fit_fixed(outside, *fit).select("ch", "chi", "offset")
    over = psd.where(in_band(lo, hi)).join(line, "ch").withColumn("prominence", F.log10("power") - (F.col("offset") - F.col("chi") * F.log10("freq")))
    w = Window.partitionBy("ch").orderBy(F.desc("prominence"), "freq")
    return over.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("ch", "freq", "prominence")


def spectral_entropy(psd: DataFrame, lo: float, hi: float) -> DataFrame:
    """Entropy of the band's power shares over its largest possible value, and the largest share."""
    band = psd.where(in_band(lo, hi))
    share = F.col("power") / F.sum("power").over(Window.partitionBy("ch"))
    got = band.withColumn("_s", share).groupBy("ch").agg(F.sum(-F.col("_s") * F.log("_s")).alias("h"), F.count("*").alias("n"), F.max("_s").alias("largest"))
    return got.select("ch", F.when(F.col("n") > 1, F.col("h") / F.log("n")).alias("entropy"), "largest")


def line_excess(psd: DataFrame, line: float, within: float, ring: float) -> DataFrame:
    """Largest power within `within` of a line over the median of the ring around it, in dB."""
    far = F.abs(F.col("freq") - line)
    got = psd.groupBy("ch").agg(F.max(F.when(far <= within, F.col("power"))).alias("top"), F.percentile(F.when((far > within) & (far <= ring), F.col("power")), 0.5).alias("mid"))
    return got.where("top > 0 and mid > 0").select("ch", (10 * F.log10(F.col("top") / F.col("mid"))).alias("db"))


def envelope_coupling(envelope: DataFrame) -> DataFrame:
    """First circular harmonic of an envelope (ch, x, phase): depth 2 |mean(x e^i phase)| / mean x, and its angle."""
    got = envelope.groupBy("ch").agg(F.avg(F.col("x") * F.cos("phase")).alias("c"), F.avg(F.col("x") * F.sin("phase")).alias("s"), F.avg("x").alias("m"))
    return got.select("ch", (2 * F.hypot("c", "s") / F.col("m")).alias("depth"), F.atan2("s", "c").alias("angle"))


def locked_amplitude(samples: DataFrame) -> DataFrame:
    """2 |mean(x e^i phase)| of samples (ch, x, phase)."""
    got = samples.groupBy("ch").agg(F.avg(F.col("x") * F.cos("phase")).alias("c"), F.avg(F.col("x") * F.sin("phase")).alias("s"))
    return got.select("ch", (2 * F.hypot("c", "s")).alias("amplitude"))


def filtered(samples: DataFrame, kernel, channel: str = "long") -> DataFrame:
    """(ch, i, x): a record passed whole through a NumPy kernel; a record is filtered before any epoch is chosen."""
    return per_record(records(samples), lambda x: {"i": range(len(x)), "x": kernel(x)}, "i long, x double", channel)


def peak_fits(psd: DataFrame, lo: float, hi: float, knee: bool = False, limits: peaks.Limits = peaks.Limits(), keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """(keys, offset, knee, exponent, r2, error, peaks): background and Gaussian peaks of every spectrum (keys, freq, power) between two frequencies.

    A row a spectrum, fitted in Arrow batches. Spectra that can't be fitted have nulls and no peaks.
    """
    inside = psd.where(F.col("freq").between(lo, hi))
    rows = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("freq", "power"))).alias("_p"))
    flat = rows.select(*keys, F.transform("_p", lambda p: p["freq"]).alias("_f"), F.transform("_p", lambda p: p["power"]).alias("_w"))
    kinds = ", ".join(f"{k} {psd.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            got = peaks.fit_all(batch["_f"], batch["_w"], knee, limits)
            out = {k: batch[k] for k in keys} | {n: [g[n] for g in got] for n in ("offset", "knee", "exponent", "r2", "error")}
            yield pd.DataFrame(out | {"peaks": [[dict(zip(("centre", "height", "width"), p, strict=True)) for p in g["peaks"]] for g in got]})

    return flat.mapInPandas(run, f"{kinds}, offset double, knee double, exponent double, r2 double, error double, peaks array<struct<centre: double, height: double, width: double>>")


def exponents(psd: DataFrame, narrow: tuple[float, float], wide: tuple[float, float], low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """(ch, estimator, chi): the exponent by two bands' sums, by lines over a narrow and a wide band, and by fits with peaks over the same.

    Estimators over the wide band differ in whether peaks bend them; channels that an estimator can't judge lack its row.
    """
    psd = written(psd)  # five estimators read it
    total = lambda b: F.sum(F.when(F.col("freq").between(*b), F.col("power")))
    span = 0.5 * math.log10(high[0] * high[1] / (low[0] * low[1]))
    bands = psd.groupBy("ch").agg(total(low).alias("l"), total(high).alias("h")).where("l > 0 and h > 0").select("ch", F.lit("two_bands").alias("estimator"), ((F.log10("l") - F.log10("h")) / span).alias("chi"))
    out = bands
    for name, band in (("narrow", narrow), ("wide", wide)):
        x, y = F.log10("freq"), F.log10("power")
        line = psd.where(in_band(*band)).groupBy("ch").agg(F.regr_slope(y, x).alias("s"), F.count("*").alias("n")).where("n >= 4")
        out = out.unionByName(line.select("ch", F.lit(f"line_{name}").alias("estimator"), (-F.col("s")).alias("chi")))
        fits = peak_fits(psd, *band).where("exponent is not null")
        out = out.unionByName(fits.select("ch", F.lit(f"peaks_{name}").alias("estimator"), F.col("exponent").alias("chi")))
    return out


def summed_band_power(psd: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Power times the bins' width, summed over the bins of each closed band; the bin at 0 never counts."""
    width = psd.groupBy("ch").agg(F.min(F.when(F.col("freq") > 0, F.col("freq"))).alias("_df"))
    inside = lambda lo, hi: (F.col("freq") > 0) & (F.col("freq") >= F.ceil(F.lit(lo) / F.col("_df")) * F.col("_df") - 1e-9) & (F.col("freq") <= F.floor(F.lit(hi) / F.col("_df")) * F.col("_df") + 1e-9)
    return psd.join(width, "ch").groupBy("ch").agg(*[F.sum(F.when(inside(*b), F.col("power") * F.col("_df")).otherwise(0.0)).alias(n) for n, b in bands.items()])


def exponent_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, difference) of exponents (keys, chi, mode, lo, hi); exponents of different modes or bands can't be compared, and are an error."""
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("chi", "mode", "lo", "hi")])
    same = F.col("mode").eqNullSafe(F.col("_mode")) & F.col("lo").eqNullSafe(F.col("_lo")) & F.col("hi").eqNullSafe(F.col("_hi"))
    refused = F.raise_error(F.lit("exponents of different modes or bands can't be compared")).cast("double")
    return a.join(other, keys).select(*keys, F.when(same, F.col("chi") - F.col("_chi")).otherwise(refused).alias("difference"))
