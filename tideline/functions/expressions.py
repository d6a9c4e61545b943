"""Column expressions: modulation, phase, gain, shape and rounding rules. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def half_up(x: Column) -> Column:
    """Rounding halves towards plus infinity, as floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def wrapped(angle: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def angle_error(a: Column, b: Column) -> Column:
    return wrapped(a - b)


def phase_ramp(i: Column, rate: float, fs: float) -> Column:
    return F.lit(TAU * rate) * i / F.lit(fs)


def phase_bucket(phase: Column, buckets: int = 360) -> Column:
    """The bucket of a phase, 0 at -pi."""
    at = F.floor((wrapped(phase) + F.lit(math.pi)) / F.lit(TAU) * buckets)
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), at)).cast("int")


def db_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def knee_frequency(knee: Column, chi: Column) -> Column:
    """knee^(1/chi); NaN where the knee isn't positive."""
    return F.when(knee > 0, F.pow(knee, F.lit(1.0) / chi)).otherwise(F.lit(float("nan")))


def modulated_exponent(chi: Column, depth: Column, phase: Column, preferred: Column) -> Column:
    return chi + depth * F.cos(phase - preferred)


def bessel_i0(x: Column, terms: int = 40) -> Column:
    """Modified Bessel function of order 0 by its series, sum of ((x/2)^k / k!)^2."""
    step = lambda s, k: F.struct((s["t"] * (x / 2 / k) * (x / 2 / k)).alias("t"), (s["s"] + s["t"] * (x / 2 / k) * (x / 2 / k)).alias("s"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["s"])


def amplitude_modulation(depth: Column, phase: Column, preferred: Column) -> Column:
    """exp(m cos(phase - preferred)) / sqrt(I0(2m)): its square has mean one over a turn."""
    return F.exp(depth * F.cos(phase - preferred)) / F.sqrt(bessel_i0(depth * 2))


def power_preserving_gain(depth: Column, z: Column) -> Column:
    """exp(d z - d^2): mean square one for a normal driver."""
    return F.exp(depth * z - depth * depth)


def raised_cosine(a: Column, b: Column, t: Column) -> Column:
    """From a to b as t goes from 0 to 1, clamped outside."""
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return a + (b - a) * (F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(math.pi) * u))


def belt(t: Column, inhale: Column, inhale_pause: Column, exhale: Column, start: Column, depth: Column) -> Column:
    """Belt height at time t of a breath: up from -start (the breath before's depth), held, down to -depth, held."""
    return (
        F.when(t < inhale, raised_cosine(-start, depth, t / inhale))
        .when(t < inhale + inhale_pause, depth)
        .when(t < inhale + inhale_pause + exhale, raised_cosine(depth, -depth, (t - inhale - inhale_pause) / exhale))
        .otherwise(-depth)
    )


def breath_phase(t: Column, inhale: Column, inhale_pause: Column, duration: Column) -> Column:
    """-pi at onset, 0 in the middle of the inspiratory pause, pi at the end; linear between."""
    peak = inhale + inhale_pause / 2
    return F.when(t < peak, F.lit(math.pi) * (t / peak - 1)).otherwise(F.lit(math.pi) * (t - peak) / (duration - peak))


def gaussian(t: Column, center: Column, width: Column) -> Column:
    """A bump of height 1 with support to four widths."""
    z = (t - center) / width
    return F.when(F.abs(z) <= 4, F.exp(F.lit(-0.5) * z * z)).otherwise(F.lit(0.0))


def spindle_wave(t: Column, duration: Column, rate: Column, chirp: Column, phase: Column) -> Column:
    """A raised-cosine burst whose rate falls by `chirp` Hz over its duration."""
    u = t / duration
    shape = F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(TAU) * u)
    turn = F.lit(TAU) * (rate * t - chirp * t * u / 2) + phase
    return F.when((u >= 0) & (u < 1), shape * F.sin(turn)).otherwise(F.lit(0.0))


def complex_wave(t: Column, width: Column) -> Column:
    """A sharp negative and a slower positive bump."""
    return gaussian(t, width * 4, width * 2) * 0.6 - gaussian(t, width, width * 0.5)


def slow_wave(t: Column, period: Column, ratio: Column) -> Column:
    """One turn of -sin whose first half takes `ratio` of the period."""
    u = t / period
    warped = F.when(u < ratio, u / ratio / 2).otherwise(F.lit(0.5) + (u - ratio) / (F.lit(1.0) - ratio) / 2)
    return F.when((u >= 0) & (u < 1), -F.sin(F.lit(TAU) * warped)).otherwise(F.lit(0.0))


def smoothstep(u: Column) -> Column:
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), u))
    return v * v * (F.lit(3.0) - 2 * v)


def to_unit(f: Column, lo: float, hi: float) -> Column:
    """A frequency's place on a logarithmic axis from lo to hi."""
    return F.log(f / F.lit(lo)) / F.lit(math.log(hi / lo))


def from_unit(u: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) * F.pow(F.lit(hi / lo), u)


def exclusive_quantile(values: Column, p: float) -> Column:
    """Quantile of a sorted array at (n + 1) p, linear between neighbours, clamped to the ends; NaN below four values."""
    n = F.size(values)
    h = (n + 1) * F.lit(float(p))
    k = F.floor(h).cast("int")
    at = lambda j: F.get(values, F.least(n - 1, F.greatest(F.lit(0), j - 1)))
    return F.when(n >= 4, at(k) + (h - k) * (at(k + 1) - at(k))).otherwise(F.lit(float("nan")))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def highpass_gain(f: Column, cut: float, fs: float, q: float) -> Column:
    return _biquad_gain(f, fs, highpass(cut, fs, q))


def lowpass_gain(f: Column, cut: float, fs: float, q: float) -> Column:
    return _biquad_gain(f, fs, lowpass(cut, fs, q))


def lowpass(cut: float, fs: float, q: float) -> tuple[float, float, float, float, float]:
    """Second-order low-pass: b0, b1, b2, a1, a2."""
    w = TAU * cut / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return ((1 - c) / 2 / (1 + alpha), (1 - c) / (1 + alpha), (1 - c) / 2 / (1 + alpha), -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha))


def highpass(cut: float, fs: float, q: float) -> tuple[float, float, float, float, float]:
    w = TAU * cut / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return ((1 + c) / 2 / (1 + alpha), -(1 + c) / (1 + alpha), (1 + c) / 2 / (1 + alpha), -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha))


def butterworth_qs(order: int) -> list[float]:
    if order < 2 or order % 2:
        raise ValueError("the order must be even")
    return [1 / (2 * math.cos(math.pi * (2 * k + 1) / (2 * order))) for k in range(order // 2)]


def _biquad_gain(f: Column, fs: float, section: tuple[float, float, float, float, float]) -> Column:
    b0, b1, b2, a1, a2 = section
    w = F.lit(TAU / fs) * f
    c1, s1, c2, s2 = F.cos(w), F.sin(w), F.cos(2 * w), F.sin(2 * w)
    above = F.hypot(F.lit(b0) + b1 * c1 + b2 * c2, b1 * s1 + b2 * s2)
    return above / F.hypot(F.lit(1.0) + a1 * c1 + a2 * c2, a1 * s1 + a2 * s2)


def chain_gain(f: Column, low_cut: float | None, high_cut: float | None, fs: float, order: int = 4, zero_phase: bool = True) -> Column:
    """Gain of a high-pass at low_cut and a low-pass at high_cut, either of them off if None; squared if run both ways."""
    whole = F.lit(1.0)
    for q in butterworth_qs(order):
        if low_cut is not None:
            whole = whole * highpass_gain(f, low_cut, fs, q)
        if high_cut is not None and high_cut < fs / 2:
            whole = whole * lowpass_gain(f, high_cut, fs, q)
    return whole * whole if zero_phase else whole
