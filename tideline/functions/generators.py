"""Seeded generators of whole records: aperiodic background, oscillations, envelopes, events. One record is one call."""

from __future__ import annotations

import math

import numpy as np

from tideline.functions import dsp
from tideline.functions.rng import Stream
from tideline.sources import montage


def aperiodic_block(n: int, chi: float, knee: float, fs: float, g) -> np.ndarray:
    """Random phases under amplitude sqrt(1 / (knee + f^chi)); no mean and nothing at Nyquist. n is a power of two."""
    f = np.arange(n // 2 + 1) * fs / n
    amplitude = np.zeros(len(f))
    amplitude[1:-1] = np.sqrt(1 / (knee + f[1:-1] ** chi))
    return np.fft.irfft(amplitude * np.exp(2j * np.pi * g.random(len(f))), n) * n


def aperiodic(n: int, chi: float, knee: float, fs: float, seed: int, name: str = "aperiodic", block: int | None = None) -> np.ndarray:
    """One transform for the whole record, cut to length; or blocks that overlap by a quarter at equal power."""
    g = Stream(seed, name).generator()
    if block is None:
        return aperiodic_block(1 << max(3, (n - 1).bit_length()), chi, knee, fs, g)[:n]
    lap = block // 4
    hop, ramp = block - lap, np.sin(np.pi / 2 * (np.arange(lap) + 0.5) / lap)
    out = np.zeros(n + block)
    for s in range(0, n, hop):
        part = aperiodic_block(block, chi, knee, fs, g)
        if s:
            part[:lap] *= ramp
        part[-lap:] *= ramp[::-1]
        out[s : s + block] += part
    return out[:n]


def scaled(x: np.ndarray, rms: float, first: int) -> np.ndarray:
    """Gain so that the first samples have the RMS."""
    level = math.sqrt((x[:first] ** 2).mean())
    return x * (rms / level) if level else x


def damped_oscillator(n: int, rate: float, bandwidth: float, fs: float, seed: int, name: str = "ar2", other: float | None = None, dwell_s: float = 1.0) -> np.ndarray:
    """x[n] = 2 r cos w x[n-1] - r^2 x[n-2] + noise, r = exp(-pi B / fs); with `other`, the bandwidth switches after exponential stays."""
    s = Stream(seed, name)
    out, a, b, band, left = np.empty(n), 0.0, 0.0, bandwidth, s.exponential(1 / dwell_s) * fs
    for i in range(n):
        if other is not None and left <= 0:
            band = other if band == bandwidth else bandwidth
            left = s.exponential(1 / dwell_s) * fs
        r = math.exp(-math.pi * band / fs)
        a, b = 2 * r * math.cos(2 * math.pi * rate / fs) * a - r * r * b + s.normal(), a
        out[i] = a
        left -= 1
    return out


def envelope(n: int, depth: float, rate: float, fs: float, seed: int, name: str = "envelope", unit_power: bool = False) -> np.ndarray:
    """1 + d tanh(z) of low-passed, standardised noise; on demand scaled to a mean square of one."""
    z = dsp.cascade(Stream(seed, name).generator().standard_normal(n), dsp.sections(fs, None, rate, 2))
    z = (z - z.mean()) / (z.std() or 1.0)
    out = 1 + depth * np.tanh(z)
    return out / math.sqrt((out**2).mean()) if unit_power else out


def burst_envelope(n: int, rate_hz: float, median_s: float, sigma: float, fs: float, seed: int, name: str = "bursts") -> np.ndarray:
    """Raised-cosine bursts at Poisson onsets with lognormal lengths; where they overlap the larger counts."""
    s, out = Stream(seed, name), np.zeros(n)
    for onset in onsets(n / fs, rate_hz, s):
        size, at = max(2, round(median_s * math.exp(sigma * s.normal()) * fs)), int(onset * fs)
        bump = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        end = min(n, at + size)
        out[at:end] = np.maximum(out[at:end], bump[: end - at])
    return out


def onsets(duration: float, rate: float, s: Stream) -> list[float]:
    """A Poisson process by exponential gaps."""
    out, t = [], s.exponential(rate)
    while t < duration:
        out.append(t)
        t += s.exponential(rate)
    return out


def oscillation(n: int, lo: float, hi: float, rms: float, fs: float, seed: int, name: str, bursts: bool = False) -> np.ndarray:
    """White noise through a zero-phase band-pass, under an envelope, at an RMS."""
    x = dsp.cascade(Stream(seed, name).generator().standard_normal(n), dsp.sections(fs, lo, hi))
    x = x * (burst_envelope(n, 0.5, 0.6, 0.4, fs, seed, name + "/bursts") if bursts else envelope(n, 0.5, 0.3, fs, seed, name + "/envelope"))
    return scaled(x, rms, n)


def reshaped(x: np.ndarray, rise: float, triangle: float) -> np.ndarray:
    """The signal drawn again from its phase and envelope: rising for a share of each turn, blended with a triangle."""
    size = 1 << (len(x).bit_length() - 1)
    z = dsp.analytic(x[:size])
    u = np.angle(z) / (2 * np.pi) % 1.0
    warped = np.where(u < rise, u / rise / 2, 0.5 + (u - rise) / (1 - rise) / 2)
    wave = (1 - triangle) * np.cos(2 * np.pi * warped) + triangle * (4 * np.abs(warped - 0.5) - 1)
    return np.r_[np.abs(z) * wave, x[size:]]


def von_mises_phase(mean: float, kappa: float, s: Stream) -> float:
    """By rejection under a uniform envelope."""
    while True:
        phi = s.uniform(-math.pi, math.pi)
        if s.next_float() < math.exp(kappa * (math.cos(phi - mean) - 1)):
            return phi


def marker_time(phase: np.ndarray, fs: float, mean: float, kappa: float, s: Stream, lo: int, hi: int, tries: int = 10_000) -> float | None:
    """A time in [lo, hi) samples whose phase falls to a von Mises draw: candidates by 360 phase buckets, and after many
    misses a draw weighted by density; None if the span is empty."""
    if hi <= lo:
        return None
    bucket = np.minimum(359, np.maximum(0, np.floor((np.arctan2(np.sin(phase[lo:hi]), np.cos(phase[lo:hi])) + np.pi) / (2 * np.pi) * 360))).astype(int)
    places = {b: np.flatnonzero(bucket == b) + lo for b in np.unique(bucket).tolist()}
    for _ in range(tries):
        wanted = min(359, int((von_mises_phase(mean, kappa, s) + math.pi) / (2 * math.pi) * 360))
        if wanted in places:
            return float(places[wanted][int(s.next_float() * len(places[wanted]))]) / fs
    weight = np.cumsum(np.exp(kappa * (np.cos(phase[lo:hi] - mean) - 1)))
    return float(lo + np.searchsorted(weight, s.next_float() * weight[-1])) / fs


def spindle(duration: float, rate: float, chirp: float, fs: float, phase: float = 0.0) -> np.ndarray:
    t = np.arange(round(duration * fs)) / fs
    return (0.5 - 0.5 * np.cos(2 * np.pi * t / duration)) * np.sin(2 * np.pi * (rate * t - chirp * t * t / duration / 2) + phase)


def k_complex(fs: float, width: float = 0.15) -> np.ndarray:
    t = np.arange(round(12 * width * fs)) / fs
    return 0.6 * np.exp(-0.5 * ((t - 4 * width) / (2 * width)) ** 2) - np.exp(-0.5 * ((t - width) / (0.5 * width)) ** 2)


def slow_oscillation(period: float, ratio: float, fs: float) -> np.ndarray:
    u = np.arange(round(period * fs)) / (period * fs)
    return -np.sin(2 * np.pi * np.where(u < ratio, u / ratio / 2, 0.5 + (u - ratio) / (1 - ratio) / 2))


#: Events of each state: generator, rate per second, amplitude.
SCHEDULE = {"n2": [("kcomplex", 0.03, 80.0), ("spindle", 0.06, 25.0)], "n3": [("slow_osc", 0.4, 250.0), ("spindle", 0.03, 20.0)]}
#: Oscillations of each state: generator, band, amplitude.
OSCILLATIONS = {"wake_eo": [("alpha", (8, 12), 3.0)], "wake_ec": [("alpha", (8, 12), 14.0)], "n1": [("theta", (4, 7), 6.0)], "n2": [("theta", (4, 7), 6.0)], "n3": [("delta", (0.5, 2), 12.0), ("theta", (4, 7), 4.0)], "rem": [("theta", (4, 7), 5.0)]}
CHI = {"wake_eo": 0.9, "wake_ec": 0.85, "n1": 1.4, "n2": 1.9, "n3": 3.4, "rem": 2.1}


def graphoelements(state: str, n: int, fs: float, seed: int, phase: np.ndarray | None = None, kappa: float = 0.0) -> tuple[list[dict], dict[str, np.ndarray]]:
    """Events sorted by onset, and each generator's waveform. With kappa > 0, onsets move to preferred breathing phases; their number stays."""
    events, waves = [], {}
    for kind, rate, amplitude in SCHEDULE.get(state, []):
        s = Stream(seed, f"events/{kind}")
        for onset in onsets(n / fs, rate, s):
            fast = kind == "spindle" and s.next_float() < 0.2
            if kind == "spindle":
                wave = spindle(s.uniform(0.5, 1.5), 14.0 if fast else 12.0, 0.5, fs)
                generator = "spindle_fast" if fast else "spindle_slow"
            elif kind == "kcomplex":
                wave, generator = k_complex(fs), kind
            else:
                wave, generator = slow_oscillation(1 / s.uniform(0.6, 1.0), 0.4, fs), kind
            tag = s.next_float()
            if kappa > 0 and phase is not None:
                onset = marker_time(phase, fs, 0.0, kappa, Stream(seed, f"coupling/{kind}/{len(events)}"), 0, n) or onset
            at = int(onset * fs)
            end = min(n, at + len(wave))
            waves.setdefault(generator, np.zeros(n))[at:end] += amplitude * wave[: end - at]
            events.append({"type": generator, "onset": onset, "duration": len(wave) / fs, "amplitude": amplitude, "inclusion_tag": tag, "state": state, "seed": seed, "substream": f"events/{kind}"})
    return sorted(events, key=lambda e: e["onset"]), waves


def compose(state: str, seed: int, seconds: float, fs: float = 256.0, chi: float | None = None, depth: float = 0.0, snr_db: float = 0.0, events: bool = True, kappa: float = 0.0, channels: list[str] | None = None) -> dict:
    """One run: background, tilt by breathing, artifact, infra-slow gain, oscillations, events, sensor noise, mains and drift, in that
    order, at the channels asked for; with its events and the truth it was made from."""
    from tideline.streaming import controllers

    n, names = round(seconds * fs), channels or [p[0] for p in montage.PLACES]
    _, belt, phase, _ = controllers.breathe(controllers.breathing_state(seed), n, fs)
    belt, phase = np.array(belt), np.array(phase)
    ticks = Stream(seed, "infraslow").generator().standard_normal(n // 128 + 2)
    slow = np.interp(np.arange(n) / 128, np.arange(len(ticks)), ticks)
    chi_ = CHI[state] if chi is None else chi
    background = aperiodic(n, chi_, 1.0, fs, seed)
    sources = {g: oscillation(n, lo, hi, a, fs, seed, f"osc/{g}") * 10 ** (snr_db / 20) for g, (lo, hi), a in OSCILLATIONS[state]}
    made, waves = graphoelements(state, n, fs, seed, phase, kappa) if events else ([], {})
    for g, w in waves.items():
        sources[g] = sources.get(g, 0) + w * 10 ** (snr_db / 20)
    out = {}
    for c in names:
        g = Stream(seed, f"channel/{c}").generator()
        x = scaled(montage.weight("background", c) * background + 0.4 * aperiodic(n, chi_, 1.0, fs, seed, f"local/{c}") * background.std() / 100, 10.0, min(n, 7680))
        if depth:
            level = x.std()
            x = dsp.tilted_over_time(x, depth * np.cos(phase), fs, 1.0, 45.0, round(0.75 * fs))
            x = x * (level / (x.std() or 1.0))
        x = x * np.exp(0.1 * slow - 0.01) + 2.0 * belt * montage.weight("artifact", c)
        for name, source in sources.items():
            x = x + montage.weight(name, c) * source
        t = np.arange(n) / fs
        out[c] = x + 0.5 * g.standard_normal(n) + 0.3 * g.random() * np.sin(2 * np.pi * 50 * t + 2 * np.pi * g.random()) + np.cumsum(g.standard_normal(n)) * 0.001
    return {"channels": out, "events": made, "belt": belt, "phase": phase, "truth": {"state": state, "seed": seed, "chi": chi_, "depth": depth, "snr_db": snr_db}}


def runs(table, fs: float = 256.0):
    """A table of runs (run_id, state, seed, seconds, depth, snr_db) as block rows (run_id, channel, place, xs), one run a group."""

    def make(batches):
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                got = compose(r.state, int(r.seed), float(r.seconds), fs, depth=float(r.depth), snr_db=float(r.snr_db))
                names = [p[0] for p in montage.PLACES]
                yield pd.DataFrame({"run_id": r.run_id, "channel": names, "place": range(len(names)), "xs": [got["channels"][c] for c in names]})

    return table.repartition("run_id").mapInPandas(make, "run_id string, channel string, place int, xs array<double>")
