"""NumPy kernels for whole records: filters, transforms, fits and complexity. No Spark here."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tideline.functions.expressions import butterworth_qs, highpass, lowpass


def biquad(x, section):
    """Second-order section in transposed direct form, from rest."""
    b0, b1, b2, a1, a2 = section
    out, s1, s2 = np.empty(len(x)), 0.0, 0.0
    for n, v in enumerate(np.asarray(x, float).tolist()):
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        out[n] = y
    return out


def cascade(x, sections, zero_phase: bool = True):
    """All sections forward; with zero phase, then all of them backward."""
    for s in sections:
        x = biquad(x, s)
        if zero_phase:
            x = biquad(x[::-1], s)[::-1]
    return np.asarray(x, float).copy()


def padded_cascade(x, sections):
    """Forward and backward over an odd reflection of the ends, each section starting in its steady state."""
    x = np.asarray(x, float)
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad or not np.isfinite(x).all():
        raise ValueError("the record is too short or not finite")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b0, b1, b2, a1, a2 in sections:
            settled = y[0] * (b0 + b1 + b2) / (1 + a1 + a2)
            s1, s2 = settled - b0 * y[0], b2 * y[0] - a2 * settled
            out = np.empty(len(y))
            for n, v in enumerate(y.tolist()):
                w = b0 * v + s1
                s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
                out[n] = w
            y = out
        y = y[::-1]
    return y[pad:-pad]


def sections(fs: float, low_cut: float | None, high_cut: float | None, order: int = 4):
    """High-pass sections at low_cut, then low-pass sections at high_cut; None or at least Nyquist is off."""
    out = []
    if low_cut is not None:
        out += [highpass(low_cut, fs, q) for q in butterworth_qs(order)]
    if high_cut is not None and high_cut < fs / 2:
        out += [lowpass(high_cut, fs, q) for q in butterworth_qs(order)]
    return out


def hann(n: int):
    """Symmetric."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1))) if n > 1 else np.ones(n)


def welch(x, fs: float, nperseg: int, noverlap: int):
    """(bin, frequency, density)"""
    power = frame_powers(x, fs, nperseg, noverlap)
    k = np.arange(power.shape[1])
    return k, k * fs / min(nperseg, len(x)), power.mean(0)


def frame_powers(x, fs: float, nperseg: int, noverlap: int):
    """Densities of every frame (frames x bins); a record shorter than a frame is one."""
    size = min(nperseg, len(x))
    hop = max(1, size - min(noverlap, size - 1))
    count = max(1, (len(x) - size) // hop + 1)
    w = hann(size)
    cut = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size)[::hop][:count]
    power = np.abs(np.fft.rfft((cut - cut.mean(1, keepdims=True)) * w)) ** 2 / (fs * (w * w).sum())
    power[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return power


def periodogram(x, fs: float):
    n = len(x)
    size = 1 << max(0, (n - 1).bit_length())
    w = hann(n)
    power = np.abs(np.fft.rfft((x - x.mean()) * w, size)) ** 2 / (fs * (w * w).sum())
    power[1:-1] *= 2
    k = np.arange(len(power))
    return k, k * fs / size, power


def long_segment(n: int, nperseg: int, least: int = 4) -> int:
    """The largest power of two that leaves `least` half-overlapping segments, and no less than the standard one that fits."""
    most = 2 * n // (least + 1)
    return max(min(nperseg, n), 1 << max(0, most.bit_length() - 1))


def hybrid(x, fs: float, nperseg: int = 1024, lo: float = 0.5, hi: float = 1.0, radius: int = 2):
    """(frequency, density)"""
    _, f1, p1 = welch(x, fs, nperseg, nperseg // 2)
    long = long_segment(len(x), nperseg)
    _, f2, p2 = welch(x, fs, long, long // 2)
    kernel = radius + 1.0 - np.abs(np.arange(-radius, radius + 1))
    p2 = np.convolve(p2, kernel, "same") / np.convolve(np.ones(len(p2)), kernel, "same")
    tiny = np.finfo(float).tiny
    low = f2[f2 < hi]
    u = np.clip((low - lo) / (hi - lo), 0, 1)
    u = u * u * (3 - 2 * u)
    other = np.interp(low, f1, np.log(np.maximum(p1, tiny)))
    blended = np.exp(np.log(np.maximum(p2[f2 < hi], tiny)) * (1 - u) + other * u)
    return np.r_[low, f1[f1 >= hi]], np.r_[blended, p1[f1 >= hi]]


def fit_line(f, p):
    x, y = np.log10(f), np.log10(p)
    slope, offset = np.polyfit(x, y, 1)
    return -slope, offset


@lru_cache(maxsize=16)
def _knee_shapes(f: bytes, grid: tuple):
    """Knees of a grid's points and their curves log10(k + f^chi), a row a point."""
    f = np.frombuffer(f)
    knees = np.array([(10**e) ** chi for chi, e in grid])
    return knees, np.stack([np.log10(k + f**chi) for k, (chi, _) in zip(knees, grid, strict=True)])


def fit_knee(f, p, grid):
    """A one-row table of the best grid point, the first of equal ones; all points are judged at once, and spectra of the same bins share the curves."""
    y = np.log10(p)
    total = ((y - y.mean()) ** 2).sum() if len(y) else 0.0
    if len(y) <= 2 or not len(grid):
        return {"chi": [math.nan], "knee": [math.nan], "offset": [math.nan], "r2": [math.nan]}
    knees, shapes = _knee_shapes(np.ascontiguousarray(f, float).tobytes(), tuple(grid))
    offsets = (y + shapes).mean(1)
    r2 = 1 - ((y - offsets[:, None] + shapes) ** 2).sum(1) / total if total else np.zeros(len(knees))
    best = int(np.argmax(np.where(np.isnan(r2), -np.inf, r2)))
    if not r2[best] > -math.inf:
        return {"chi": [math.nan], "knee": [math.nan], "offset": [math.nan], "r2": [math.nan]}
    return {"chi": [grid[best][0]], "knee": [knees[best]], "offset": [offsets[best]], "r2": [r2[best]]}


def exponent_over_time(x, fs: float, window_s: float, hop_s: float, lo: float, hi: float, last: bool = False):
    """Exponents of a record's whole windows, without the last one unless `last`."""
    size, hop = round(window_s * fs), round(hop_s * fs)
    out = []
    for j in range(max(0, (len(x) - size) // hop + last)):
        _, f, p = welch(x[j * hop : j * hop + size], fs, min(512, size), min(256, size // 2))
        ok = (f >= lo) & (f <= hi) & (p > 0) & (f > 0)
        out.append(fit_line(f[ok], p[ok])[0] if ok.sum() >= 4 else math.nan)
    return np.array(out, float)


def analytic(x):
    """The analytic signal by masking negative frequencies."""
    n = len(x)
    mask = np.zeros(n)
    mask[0] = 1
    mask[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        mask[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * mask)


def tilt_design(delta: float, fs: float, lo: float, hi: float, poles: int = 12):
    """First-order (b0, b1, a1) sections that change a spectrum's exponent by delta between lo and hi, gain one at the band's centre."""
    a, b = lo / 10, min(10 * hi, 0.45 * fs)
    ratio = (b / a) ** (1 / (poles - 1))
    out = []
    for i in range(poles):
        pole = a * ratio**i
        zero = pole * ratio ** (delta / 2)
        p, z = (math.tan(math.pi * min(v, 0.49 * fs) / fs) for v in (pole, zero))
        out.append(((1 + z) / (1 + p), (z - 1) / (1 + p), (p - 1) / (1 + p)))
    center = math.sqrt(lo * hi)
    gain = tilt_gain(out, center, fs)
    b0, b1, a1 = out[0]
    out[0] = (b0 / gain, b1 / gain, a1)
    return out


def tilt_gain(sections_, f: float, fs: float) -> float:
    z = np.exp(-2j * math.pi * f / fs)
    return float(np.prod([abs((b0 + b1 * z) / (1 + a1 * z)) for b0, b1, a1 in sections_]))


def tilted(x, sections_):
    y = np.asarray(x, float)
    for b0, b1, a1 in sections_:
        out, s = np.empty(len(y)), 0.0
        for n, v in enumerate(y.tolist()):
            w = b0 * v + s
            s = b1 * v - a1 * w
            out[n] = w
        y = out
    return y


def tilted_over_time(x, delta, fs: float, lo: float, hi: float, block: int, levels: int = 0):
    """Tilt by a change of exponent given for each sample: in blocks that overlap by a quarter under sine and cosine
    weights, or (levels > 0) as a mix of the two nearest of so many fixed tilts."""
    x, delta = np.asarray(x, float), np.asarray(delta, float)
    if levels:
        a, b = float(delta.min()), float(delta.max())
        grid = np.linspace(a, b, levels) if b > a else np.array([a])
        bank = np.stack([tilted(x, tilt_design(d, fs, lo, hi)) for d in grid])
        if len(grid) == 1:
            return bank[0]
        at = (delta - a) / (b - a) * (levels - 1)
        k = np.minimum(at.astype(int), levels - 2)
        u, n = at - k, np.arange(len(x))
        return bank[k, n] * (1 - u) + bank[k + 1, n] * u
    overlap = block // 4
    hop = block - overlap
    out, total = np.zeros(len(x)), np.zeros(len(x))
    for s in range(0, len(x), hop):
        e = min(len(x), s + block)
        w = np.ones(e - s)
        ramp = np.sin(np.pi / 2 * (np.arange(overlap) + 0.5) / max(1, overlap))[: e - s]
        if s:
            w[: len(ramp)] *= ramp
        if e < len(x):
            w[len(w) - len(ramp) :] *= ramp[::-1]
        lead = max(0, s - block)
        out[s:e] += w * tilted(x[lead:e], tilt_design(float(delta[s:e].mean()), fs, lo, hi))[s - lead :]
        total[s:e] += w
    return out / total


def lz76(symbols) -> int:
    """Phrases of the exhaustive history: each is the shortest string that doesn't occur starting before it; the last may be unfinished.

    A suffix automaton of the whole record knows where every string ends first, so a phrase is a walk from the root that
    stops at the string whose first end is its own: time grows with the record's length.
    """
    s = [int(v) for v in symbols]
    steps: list[dict[int, int]] = [{}]
    link, length, ends, last = [-1], [0], [-1], 0
    for i, c in enumerate(s):
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    at, count, n = 0, 0, len(s)
    while at < n:
        node = 0
        while at < n:
            node = steps[node][s[at]]
            at += 1
            if ends[node] == at - 1:  # its first occurrence is this one
                break
        count += 1
    return count


def lzw(symbols) -> int:
    """New dictionary entries, from the entries 0 and 1; the pending phrase doesn't count."""
    table, node, made = {}, None, 0
    for v in symbols:
        v = int(v)
        if node is None:
            node = (v,)
        elif (nxt := table.get((node, v))) is not None:
            node = nxt
        else:
            made += 1
            table[(node, v)] = ("n", made)
            node = (v,)
    return made


def shuffled_complexity(symbols, parse, rng, times: int = 5) -> float:
    """Mean complexity of so many shuffles."""
    s = np.array(symbols)
    return float(np.mean([parse(s[rng.permutation(len(s))]) for _ in range(times)])) if len(s) else 0.0


class Cascade:
    """Second-order sections (b0, b1, b2, a1, a2) in a row as one linear system: state -> A state + B x, y = C state + D x.

    Runs in blocks of BLOCK samples: a block's output is its own response, a product with the impulse response's matrix, plus
    that of the state before it, so Python takes one step a block and section.
    """

    BLOCK = 64

    def __init__(self, sections):
        self.size = 2 * len(sections)
        a, b, c, d = np.zeros((self.size, self.size)), np.zeros(self.size), np.zeros(self.size), 1.0
        for n, (b0, b1, b2, a1, a2) in enumerate(sections):  # the section's input is c . state + d x of those before it
            s = 2 * n
            own = np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[s : s + 2] = own[:, None] * c[None]
            a[s, s], a[s, s + 1], a[s + 1, s] = a[s, s] - a1, a[s, s + 1] + 1, a[s + 1, s] - a2
            b[s : s + 2] = own * d
            c, d = b0 * c, b0 * d
            c[s] += 1
        # Poles near 1 make this form's powers large; as a turn and a decay, a section's state keeps its digits.
        change = np.eye(self.size)
        for n, (*_, a1, a2) in enumerate(sections):
            if a1 * a1 < 4 * a2:
                pole = complex(-a1 / 2, math.sqrt(a2 - a1 * a1 / 4))
                v = np.array([1, pole + a1])
                change[2 * n : 2 * n + 2, 2 * n : 2 * n + 2] = np.stack([v.real, v.imag], 1)
        back = np.linalg.inv(change)
        self.a, self.b, self.c, self.d = back @ a @ change, back @ b, c @ change, d
        a, b, c = self.a, self.b, self.c
        for n, (*_, a1, a2) in enumerate(sections):
            if a1 * a1 < 4 * a2:
                re, im = -a1 / 2, math.sqrt(a2 - a1 * a1 / 4)
                a[2 * n : 2 * n + 2, 2 * n : 2 * n + 2] = [[re, im], [-im, re]]
        powers = [np.eye(self.size)]
        for _ in range(self.BLOCK):
            powers.append(a @ powers[-1])
        self.seen = np.stack([c @ p for p in powers[:-1]])  # a block's outputs by the state before it
        impulse = np.r_[d, self.seen[:-1] @ b]
        at = np.arange(self.BLOCK)[:, None] - np.arange(self.BLOCK)[None]
        self.own = np.where(at >= 0, impulse[np.maximum(at, 0)], 0.0)
        self.reach = np.stack([powers[self.BLOCK - 1 - k] @ b for k in range(self.BLOCK)])  # the state after a block by its inputs
        self.over = powers[self.BLOCK]

    def run(self, x, state=None):
        """(outputs, end state) from a start state, or from rest."""
        n, state = len(x), np.zeros(self.size) if state is None else state
        whole = n // self.BLOCK
        blocks = np.reshape(x[: whole * self.BLOCK], (whole, self.BLOCK))
        inputs, states = blocks @ self.reach, np.empty((whole, self.size))
        for k in range(whole):
            states[k] = state
            state = self.over @ state + inputs[k]
        out = [(blocks @ self.own.T + states @ self.seen.T).ravel()]
        rest = np.asarray(x[whole * self.BLOCK :], float)
        if len(rest):
            out.append(self.own[: len(rest), : len(rest)] @ rest + self.seen[: len(rest)] @ state)
            for v in rest:
                state = self.a @ state + self.b * v
        return np.concatenate(out), state

    def free(self, n: int):
        """Outputs of n samples of silence by the start state (n x states)."""
        out, power = [], np.eye(self.size)
        for _ in range(0, n, self.BLOCK):
            out.append(self.seen @ power)
            power = self.over @ power
        return np.concatenate(out)[:n]

    def settled(self):
        """The state in which an input of 1 has always been there."""
        return np.linalg.solve(np.eye(self.size) - self.a, self.b)


def butterworth_bandpass(order: int, low: float, high: float, fs: float) -> list[tuple]:
    """`order` second-order sections of a Butterworth band-pass: the analogue low-pass's poles moved to the band, then the bilinear transform.

    Zeros lie at 1 and -1, one of each a section, and sections share the gain.
    """
    if not 0 < low < high < fs / 2:
        raise ValueError("the band must lie between 0 and half the sampling rate")
    w = 2 * fs * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2)
    analogue = np.r_[poles + root, poles - root]
    digital = (2 * fs + analogue) / (2 * fs - analogue)
    gain = (width**order * (2 * fs) ** order / np.prod(2 * fs - analogue)).real
    each = np.sign(gain) * abs(gain) ** (1 / order)
    upper = digital[digital.imag > 1e-12]
    real = np.sort(digital[np.abs(digital.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    return [(float(each), 0.0, -float(each), float(a1), float(a2)) for a1, a2 in sorted(pairs, key=lambda p: p[1])]
