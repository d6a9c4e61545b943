"""Readouts that join other measures: gains of references, shapes of envelopes, beats, nulls and provenance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators import samples
from tideline.sources import montage

# The states a run can be in.
STATES = ("wake_eo", "wake_ec", "n1", "n2", "n3", "rem")


def referenced_gain(weights: DataFrame, mode: str, neighbours: DataFrame | None = None) -> DataFrame:
    """(generator, channel, x): a generator's weight at each channel once referenced; referencing is linear, so it acts on weights as on samples."""
    w = weights.select("generator", "channel", F.col("w").alias("x"))
    return samples.rereferenced(w, mode, ["generator"], neighbours).select("generator", "channel", "x")


def reference_matrix(channels: DataFrame, mode: str, neighbours: DataFrame | None = None) -> DataFrame:
    """(channel, other, c): the reference as a matrix, found by referencing each channel's unit. A montage has a fixed, small size."""
    units = channels.select("channel").join(F.broadcast(channels.select(F.col("channel").alias("other"))), F.lit(True))
    units = units.withColumn("x", F.when(F.col("channel") == F.col("other"), 1.0).otherwise(0.0))
    return samples.rereferenced(units, mode, ["other"], neighbours).select("channel", "other", F.col("x").alias("c"))


def envelope_shape(envelope: DataFrame) -> DataFrame:
    """(ch, bimodality): (skewness^2 + 1) / kurtosis of population moments; null for a constant record."""
    m = envelope.groupBy("ch").agg(F.avg("x").alias("m"))
    d = F.col("x") - F.col("m")
    got = envelope.join(m, "ch").groupBy("ch").agg(*[F.avg(F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])
    return got.select("ch", F.when(F.col("m2") > 0, (F.col("m3") * F.col("m3") / F.pow("m2", F.lit(3.0)) + 1) / (F.col("m4") / (F.col("m2") * F.col("m2")))).alias("bimodality"))


def folding_lag(signal: DataFrame, longest: int) -> DataFrame:
    """(ch, lag): the first lag, up to `longest` samples, at which the autocorrelation has fallen to 1 / e; null if at none.

    Each sample meets its later partners by lag windows, one sort of a channel."""
    w = Window.partitionBy("ch").orderBy("i")
    centred = signal.withColumn("_x", F.col("x") - F.avg("x").over(Window.partitionBy("ch")))
    wide = centred.select("ch", "_x", *[F.lead("_x", k).over(w).alias(f"_l{k}") for k in range(1, longest + 1)])
    sums = wide.groupBy("ch").agg(F.sum(F.col("_x") * F.col("_x")).alias("_v"), *[F.sum(F.col("_x") * F.coalesce(f"_l{k}", F.lit(0.0))).alias(f"_s{k}") for k in range(1, longest + 1)])
    lags = F.array(*[F.when(F.col(f"_s{k}") <= F.col("_v") / math.e, F.lit(k)) for k in range(1, longest + 1)])
    return sums.select("ch", F.when(F.col("_v") > 0, F.array_min(F.array_compact(lags))).alias("lag"))


def phase_at(beats: DataFrame, phases: DataFrame) -> DataFrame:
    """(ch, i, phase): the breathing phase (ch, i, phase) at each beat (ch, i)."""
    return beats.select("ch", "i").join(phases.select("ch", "i", "phase"), ["ch", "i"])


def beat_phase_fit(beats: DataFrame, phases: DataFrame) -> DataFrame:
    """(ch, beats, depth, angle): interval before each beat against the phase at it, by the first harmonic about the mean."""
    w = Window.partitionBy("ch").orderBy("i")
    at = phase_at(beats, phases).join(beats.select("ch", "i", "t"), ["ch", "i"]).withColumn("rr", F.col("t") - F.lag("t").over(w)).where("rr is not null")
    m = at.withColumn("_d", F.col("rr") - F.avg("rr").over(Window.partitionBy("ch")))
    c, s = (2 * F.avg(F.col("_d") * f("phase")) for f in (F.cos, F.sin))
    return m.groupBy("ch").agg(F.count("*").alias("beats"), F.hypot(c, s).alias("depth"), F.atan2(s, c).alias("angle"))


def shifted_null(events: DataFrame, shifts: int, keys: list[str]) -> DataFrame:
    """(keys, r, null_max): resultant length of events' phases, and its largest among `shifts` turns that grow with each event's rank.

    A turn by k cycles over a key's events keeps their spacing but breaks their link to the phase."""
    w = Window.partitionBy(*keys).orderBy("phase", "event")
    ranked = events.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    each = ranked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(shifts))))
    turned = F.col("phase") + 2 * math.pi * F.col("_k") * F.col("_r") / F.col("_n")
    r = each.groupBy(*keys, "_k").agg(F.hypot(F.avg(F.cos(turned)), F.avg(F.sin(turned))).alias("v"))
    return r.groupBy(*keys).agg(F.max(F.when(F.col("_k") == 0, F.col("v"))).alias("r"), F.max(F.when(F.col("_k") > 0, F.col("v"))).alias("null_max"))


def coupling_readout(fitted: DataFrame, injected: DataFrame, keys: list[str]) -> DataFrame:
    """Recovered over injected depth, and the angle between them; null where nothing was injected."""
    met = fitted.join(injected, keys)
    ratio = F.when(F.col("injected_depth") != 0, F.col("depth") / F.col("injected_depth"))
    off = F.atan2(F.sin(F.col("angle") - F.col("injected_angle")), F.cos(F.col("angle") - F.col("injected_angle")))
    return met.select(*keys, ratio.alias("recovered"), F.when(F.col("injected_depth") != 0, off).alias("off"))


def rms_spread(signal: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, mid, hi): the smallest, median and largest channel RMS."""
    each = signal.groupBy(*keys, "ch").agg(samples.rms(F.col("x")).alias("_rms"))
    return each.groupBy(*keys).agg(F.min("_rms").alias("lo"), F.percentile("_rms", 0.5).alias("mid"), F.max("_rms").alias("hi"))


def peak_electrode(weights: DataFrame) -> DataFrame:
    """(generator, channel): the channel of the largest absolute weight, the first of the montage among equals."""
    return samples.first_largest(weights.withColumn("_w", F.abs("w")), ["generator"], F.col("_w"), F.col("place")).select("generator", "channel")


def patch_covariance(places: DataFrame, length: float) -> DataFrame:
    """(a, b, c): exp(-distance / length) of all channel pairs a <= b of a montage."""
    b = places.select(F.col("channel").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    met = places.select(F.col("channel").alias("a"), "x", "y").join(F.broadcast(b), F.col("a") <= F.col("b"))
    return met.select("a", "b", F.exp(-F.hypot(F.col("x") - F.col("xb"), F.col("y") - F.col("yb")) / length).alias("c"))


def patch_modes(spark, places: DataFrame, length: float, share: float = 0.95) -> DataFrame:
    """(mode, channel, w): eigenvectors of the patch covariance, scaled by the root of their values, until `share` of the trace is met.

    Of a montage's size (64 channels at most), so the matrix is solved on the driver; each mode's largest weight is positive."""
    import numpy as np

    rows = patch_covariance(places, length).collect()
    names = sorted({r["a"] for r in rows})
    if len(names) > 64:
        raise ValueError("modes are for matrices of a montage's size")
    m = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = names.index(r["a"]), names.index(r["b"])
        m[i, j] = m[j, i] = r["c"]
    values, vectors = np.linalg.eigh(m)
    order, out, met = np.argsort(-values), [], 0.0
    for k, v in enumerate(order):
        w = vectors[:, v] * math.sqrt(max(0.0, values[v]))
        w = w * (1 if w[np.argmax(np.abs(w))] >= 0 else -1)
        out += [(k, c, float(x)) for c, x in zip(names, w, strict=True)]
        met += values[v] / np.trace(m)
        if met >= share:
            break
    return spark.createDataFrame(out, "mode int, channel string, w double")


def is_state(name: Column) -> Column:
    return F.coalesce(name.isin(*STATES), F.lit(False))


def is_provisional(provenance: Column, open_marks: tuple[str, ...] = ("provisional", "placeholder", "stub")) -> Column:
    """Whether a provenance text says that it isn't final; none says so too."""
    low = F.lower(F.coalesce(provenance, F.lit(open_marks[0])))
    out = F.lit(False)
    for m in open_marks:
        out = out | low.contains(m)
    return out


def midpoint(lo: Column, hi: Column) -> Column:
    """What is picked from an interval where one value is needed."""
    return (lo + hi) / 2


def peak_to_rms(peak_to_peak: Column) -> Column:
    """RMS of a sine of that peak-to-peak size."""
    return peak_to_peak / (2 * math.sqrt(2))


def circular_inputs(gates: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """(gate, key): gates whose parameters were fitted on what they judge: a gate's own key among the keys that its parameters came from."""
    return gates.join(fitted_on, ["gate", "key"], "left_semi").select("gate", "key").distinct()


def scalp_places(spark) -> DataFrame:
    return montage.table(spark).where(F.col("channel").isin(*montage.SCALP))

