"""Measures of the research probes: shape, features of breaths and beats, arm differences, event counts, boundary steps, maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.windows import by, extrema


def derivation(samples: DataFrame, keys: list[str], plus: str, minus: str) -> DataFrame:
    """One channel minus another at each sample; samples without either are left out."""
    got = samples.where(F.col("channel").isin(plus, minus)).groupBy(*keys).agg(F.max(F.when(F.col("channel") == plus, F.col("x"))).alias("p"), F.max(F.when(F.col("channel") == minus, F.col("x"))).alias("m"))
    return got.where("p is not null and m is not null").select(*keys, (F.col("p") - F.col("m")).alias("x"))


def anterior(montage: DataFrame) -> DataFrame:
    """(channel, position): y scaled to 0..1 over the montage."""
    whole = Window.partitionBy()
    lo, hi = F.min("y").over(whole), F.max("y").over(whole)
    return montage.select("channel", ((F.col("y") - lo) / (hi - lo)).alias("position"))


def travel_delay(montage: DataFrame, seconds: float, fs: float) -> DataFrame:
    """Samples by which a wave reaches each channel after the most anterior one."""
    return anterior(montage).select("channel", F.floor((1 - F.col("position")) * seconds * fs + 0.5).cast("bigint").alias("delay"))


def top_channels(weights: DataFrame, least: float = 0.25) -> DataFrame:
    """(generator, channels): those with more weight than `least`, the strongest first, names breaking ties."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "channel")))
    return weights.where(F.col("w") > least).groupBy("generator").agg(ordered.alias("_c")).select("generator", F.transform("_c", lambda c: c["channel"]).alias("channels"))


def scheduled(gaps: DataFrame, duration: float) -> DataFrame:
    """Onsets by summing gaps (ch, i, gap), as far as the duration goes."""
    return gaps.withColumn("onset", F.sum("gap").over(by().rowsBetween(Window.unboundedPreceding, 0))).where(F.col("onset") < duration)


def mains(samples: DataFrame, rate: float, fs: float, gain: Column, phase: Column) -> DataFrame:
    """A sinusoid of each channel's own gain and phase added."""
    return samples.withColumn("x", F.col("x") + gain * F.sin(F.lit(2 * math.pi * rate / fs) * F.col("i") + phase))


def common_drift(samples: DataFrame, own: Column, common: Column, references: tuple[str, ...]) -> DataFrame:
    """Each electrode's own drift, and one that only the references share."""
    return samples.withColumn("x", F.col("x") + own + F.when(F.col("channel").isin(*references), common).otherwise(0.0))


def cycle_shape(samples: DataFrame) -> DataFrame:
    """(ch, cycles, rise, peak_share): of trough, peak, trough in a row, the rise's mean share and how often the peak is the larger extremum."""
    e = extrema(samples)
    w = by()
    named = e.select("ch", "i", "x", "kind", *[f("i").over(w).alias(f"{n}_i") for n, f in (("b", F.lag), ("a", F.lead))], *[f("kind").over(w).alias(f"{n}_k") for n, f in (("b", F.lag), ("a", F.lead))], F.lag("x").over(w).alias("b_x"))
    whole = named.where("kind = 'peak' and b_k = 'trough' and a_k = 'trough'")
    return whole.groupBy("ch").agg(F.count("*").alias("cycles"), F.avg((F.col("i") - F.col("b_i")) / (F.col("a_i") - F.col("b_i"))).alias("rise"), F.avg(F.when(F.abs("x") > F.abs("b_x"), 1.0).otherwise(0.0)).alias("peak_share"))


def harmonic_ratios(psd: DataFrame, fundamental: float, line: DataFrame) -> DataFrame:
    """Power at 2f and 3f over a fitted line (ch, chi, offset), as shares of that at f."""
    over = psd.join(line, "ch").withColumn("e", F.col("power") - F.pow(F.lit(10.0), F.col("offset") - F.col("chi") * F.log10("freq")))
    at = lambda k: F.max(F.when(F.col("freq") == k * fundamental, F.col("e")))
    got = over.where("freq > 0").groupBy("ch").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    return got.where("a > 0").select("ch", (F.col("b") / F.col("a")).alias("second"), (F.col("c") / F.col("a")).alias("third"))


def two_band_exponent(psd: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Exponent from the mean power of two bands at their geometric centres."""
    mean = lambda b: F.avg(F.when(F.col("freq").between(*b), F.col("power")))
    span = 0.5 * math.log10(high[0] * high[1] / (low[0] * low[1]))
    got = psd.groupBy("ch").agg(mean(low).alias("l"), mean(high).alias("h"))
    return got.where("l > 0 and h > 0").select("ch", ((F.log10("l") - F.log10("h")) / span).alias("chi"))


def circular_shift(samples: DataFrame, shift: Column) -> DataFrame:
    """Each record turned round by a number of samples."""
    n = samples.groupBy("ch").agg(F.count("*").alias("_n"))
    return samples.join(n, "ch").withColumn("i", F.pmod(F.col("i") + shift, F.col("_n"))).drop("_n")


def aligned(samples: DataFrame) -> DataFrame:
    """|mean(x e^i phase)| of mean-free x."""
    m = samples.join(samples.groupBy("ch").agg(F.avg("x").alias("_m")), "ch")
    d = F.col("x") - F.col("_m")
    return m.groupBy("ch").agg(F.hypot(F.avg(d * F.cos("phase")), F.avg(d * F.sin("phase"))).alias("mi"))


def breath_features(belt: DataFrame, fs: float) -> DataFrame:
    """(ch, breath, interval, half_range, inhale): breaths start where the phase falls; inhale is the share of time to 99 % of the rise."""
    wraps = F.sum(F.when(F.col("phase") < F.lag("phase").over(by()), 1).otherwise(0)).over(by().rowsBetween(Window.unboundedPreceding, 0))
    b = belt.withColumn("breath", F.coalesce(wraps, F.lit(0)))
    size = b.groupBy("ch", "breath").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("i").alias("first"))
    top = b.join(size, ["ch", "breath"]).where(F.col("x") >= F.col("lo") + 0.99 * (F.col("hi") - F.col("lo"))).groupBy("ch", "breath").agg(F.min("i").alias("up"))
    return size.join(top, ["ch", "breath"]).select("ch", "breath", (F.col("n") / fs).alias("interval"), ((F.col("hi") - F.col("lo")) / 2).alias("half_range"), ((F.col("up") - F.col("first")) / F.col("n")).alias("inhale"))


def infra_share(psd: DataFrame, low: tuple[float, float], carrier: tuple[float, float]) -> DataFrame:
    """Power in a low band over that in the carrier band, each bin weighed by its distance to the bin before."""
    w = Window.partitionBy("ch").orderBy("freq")
    step = psd.withColumn("_d", F.col("freq") - F.lag("freq").over(w))
    area = lambda b: F.sum(F.when(F.col("freq").between(*b), F.col("power") * F.coalesce("_d", F.lit(0.0))))
    got = step.groupBy("ch").agg(area(low).alias("l"), area(carrier).alias("c"))
    return got.where("c > 0").select("ch", (F.col("l") / F.col("c")).alias("ratio"))


def log_slope(samples: DataFrame, trim: int, eps: float = 1e-12) -> DataFrame:
    """Slope of log y on x, so many samples left out at both ends. y is held at `eps`; without one, the log of 0 is minus infinity and its channel's slope NaN."""
    n = samples.groupBy("ch").agg(F.count("*").alias("_n"))
    inner = samples.join(n, "ch").where((F.col("i") >= trim) & (F.col("i") < F.col("_n") - trim))
    level = F.log(F.greatest(F.col("y"), F.lit(eps))) if eps else F.when(F.col("y") == 0, F.lit(-math.inf)).otherwise(F.log("y"))
    return inner.groupBy("ch").agg(F.regr_slope(level, F.col("x")).alias("slope"))


def half_rms_ratio(samples: DataFrame) -> DataFrame:
    """RMS of the second half over the first's."""
    n = samples.groupBy("ch").agg(F.count("*").alias("_n"))
    half = F.floor(F.col("_n") / 2)
    sq = F.col("x") * F.col("x")
    got = samples.join(n, "ch").groupBy("ch").agg(F.sqrt(F.avg(F.when(F.col("i") < half, sq))).alias("a"), F.sqrt(F.avg(F.when(F.col("i") >= half, sq))).alias("b"))
    return got.where("a > 0").select("ch", (F.col("b") / F.col("a")).alias("ratio"))


def uncentred_correlation(samples: DataFrame, lag: int) -> DataFrame:
    """sum x[i] x[i + lag] over the root of both parts' powers."""
    p = samples.withColumn("p", F.lag("x", lag).over(by())).where("p is not null")
    return p.groupBy("ch").agg((F.sum(F.col("x") * F.col("p")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("p") * F.col("p")))).alias("r"))


def arm_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Largest |a - b| and the difference's RMS over samples that both arms have."""
    d = F.col("x") - F.col("_y")
    return a.join(b.withColumnRenamed("x", "_y"), keys).agg(F.max(F.abs(d)).alias("largest"), F.sqrt(F.avg(d * d)).alias("rms"), F.count("*").alias("n"))


def same_counts(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """Events of each kind in two arms, none counting as 0, and whether they agree."""
    n = lambda df, name: df.groupBy(kind).agg(F.count("*").alias(name))
    got = n(a, "a").join(n(b, "b"), kind, "full_outer").fillna(0, ["a", "b"])
    return got.withColumn("same", F.col("a") == F.col("b"))


def boundary_steps(samples: DataFrame, edges: DataFrame, within: int) -> DataFrame:
    """Largest jump within so many samples of an edge (ch, i), and the 99.9th percentile of all other jumps."""
    jump = samples.select("ch", "i", F.abs(F.col("x") - F.lag("x").over(by())).alias("d")).where("d is not null")
    near = edges.select("ch", F.explode(F.sequence(F.col("i") - within, F.col("i") + within)).alias("i")).distinct()
    marked = jump.join(near.withColumn("_near", F.lit(True)), ["ch", "i"], "left")
    return marked.groupBy("ch").agg(F.max(F.when(F.col("_near"), F.col("d"))).alias("at_edges"), F.percentile(F.when(F.col("_near").isNull(), F.col("d")), 0.999).alias("elsewhere"))


def hypnogram(spans: DataFrame, epoch: float, least: float) -> DataFrame:
    """(ch, epoch, stage): each epoch's stage from intervals (onset, duration, stage, id); the last written wins, and only whole epochs count."""
    first, last = F.ceil(F.col("onset") / epoch), F.floor((F.col("onset") + F.col("duration")) / epoch) - 1
    each = spans.where(F.col("duration") >= least).withColumns({"_a": first, "_b": last}).where("_a <= _b").select("ch", "id", "stage", F.explode(F.sequence("_a", "_b")).alias("epoch"))
    return each.groupBy("ch", "epoch").agg(F.max_by("stage", "id").alias("stage"))


def events_per_minute(events: DataFrame, keys: list[str], minutes: float) -> DataFrame:
    """Rate of each kind, and the medians of duration and amplitude."""
    return events.groupBy(*keys).agg((F.count("*") / minutes).alias("rate"), F.percentile("duration", 0.5).alias("duration"), F.percentile("amplitude", 0.5).alias("amplitude"))


def evidence(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rules as flags, and whether all hold."""
    flags = table.withColumns(rules)
    whole = F.lit(True)
    for name in rules:
        whole = whole & F.col(name)
    return flags.withColumn("eligible", whole)


def grid_best(scores: DataFrame, keys: list[str], error: str, order: list[str]) -> DataFrame:
    """The grid point with the smallest error, the first in order among equals; failed points (null, NaN) are passed over."""
    w = Window.partitionBy(*keys).orderBy(error, *order)
    ok = scores.where(F.col(error).isNotNull() & ~F.isnan(error))
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
