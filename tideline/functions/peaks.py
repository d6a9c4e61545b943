"""A spectrum as a smooth background and Gaussian peaks in log power: an own implementation of that published model, in NumPy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Half width at half height of a Gaussian of deviation 1.
HALF = math.sqrt(2 * math.log(2))
#: Values of spectra that are fitted at once.
TOGETHER = 1 << 16


@dataclass(frozen=True)
class Limits:
    """A peak's full width (two deviations) in Hz, how many there may be, their least height in log10 power and in deviations of the flattened spectrum,
    the share of the flattened spectrum that the robust background is fitted to, and rounds of background and peaks."""

    narrow: float = 0.5
    wide: float = 12.0
    most: int = 8
    height: float = 0.0
    deviations: float = 2.0
    share: float = 0.025
    rounds: int = 3


def _moves(hess, grad):
    """Solutions of symmetric systems; the least ones, where a matrix is singular."""
    try:
        return np.linalg.solve(hess, grad[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(hess, rcond=np.finfo(float).eps * grad.shape[1], hermitian=True) @ grad[..., None])[..., 0]


def solve(model, start, lo, hi, steps: int = 60):
    """Least squares of many problems at once by damped Gauss-Newton steps inside bounds, a row of `start`, `lo` and `hi` a problem, each with a damping and an end of its own.

    model(p, rows) gives residuals (rows x n) and their derivatives (rows x n x parameters) of the problems `rows`.
    """
    p = np.clip(np.asarray(start, float), lo, hi)
    lo, hi, damp, rows = np.broadcast_to(lo, p.shape), np.broadcast_to(hi, p.shape), np.full(len(p), 1e-3), np.arange(len(p))
    res, jac = model(p, rows)
    cost = (res * res).sum(1)
    for _ in range(steps):
        if not len(rows):
            break
        grad, hess = np.einsum("rnp,rn->rp", jac, res), jac.transpose(0, 2, 1) @ jac
        diag = np.arange(p.shape[1])
        hess[:, diag, diag] += damp[:, None] * (hess[:, diag, diag] + 1e-12)
        fine = np.isfinite(hess).all((1, 2)) & np.isfinite(grad).all(1)
        hess[~fine], grad[~fine] = np.eye(p.shape[1]), 0.0
        own = p[rows]
        trial = np.clip(own - _moves(hess, grad), lo[rows], hi[rows])
        res_, jac_ = model(trial, rows)
        cost_ = (res_ * res_).sum(1)
        better = np.isfinite(cost_) & (cost_ <= cost)
        done = better & (cost - cost_ <= 1e-12 * (cost + 1e-30))
        p[rows[better]] = trial[better]
        res[better], jac[better], cost[better] = res_[better], jac_[better], cost_[better]
        damp = np.where(better, np.maximum(damp / 5, 1e-12), damp * 5)
        go = ~(done | (~better & (damp > 1e12))) & fine
        rows, res, jac, cost, damp = rows[go], res[go], jac[go], cost[go], damp[go]
    return p


def background(freq, params, knee: bool):
    """Offset - log10(k + f^chi), params (offset, k, chi) of one spectrum or of many; without a knee k is 0."""
    offset, k, chi = (params[..., i, None] for i in range(3))
    return offset - np.log10((k if knee else 0.0) + freq**chi)


def fit_background(freq, level, knee: bool, start=None, part=None):
    """(offset, knee, chi) of log10 power, a row a spectrum; of the bins in `part`, if given."""
    x, w = np.log10(freq), np.ones(level.shape) if part is None else part.astype(float)
    n = w.sum(1)
    away = x - ((w @ x) / n)[:, None]
    spread, middle = (w * away * away).sum(1), (w * level).sum(1) / n
    slope = (w * away * level).sum(1) / spread
    first = middle - slope * (w @ x) / n
    for i in np.flatnonzero(spread <= 1e-24 * n):  # bins of one frequency
        slope[i], first[i] = np.polyfit(x[w[i] > 0], level[i][w[i] > 0], 1)
    if not knee:
        return np.stack([first, np.zeros(len(n)), -slope], 1)

    def model(p, rows):
        power = np.maximum(freq ** p[:, 2:3], 1e-30)
        whole = p[:, 1:2] + power
        d = 1 / (whole * math.log(10))
        own = w[rows]
        return own * (p[:, :1] - np.log10(whole) - level[rows]), own[..., None] * np.stack([np.ones_like(power), -d, -d * power * np.log(freq)], 2)

    best, least = None, None
    for k in [start[:, 1]] if start is not None else [np.full(len(n), v) for v in (0.0, 10.0, 100.0, 1000.0)]:
        p = solve(model, np.stack([first if start is None else start[:, 0], k, -slope if start is None else start[:, 2]], 1), [-np.inf, 0.0, -np.inf], [np.inf, np.inf, np.inf], 200)
        cost = (model(p, np.arange(len(n)))[0] ** 2).sum(1)
        if best is None:
            best, least = p, cost
        else:
            best, least = np.where((cost < least)[:, None], p, best), np.where(cost < least, cost, least)
    return best


def robust_background(freq, level, knee: bool, share: float):
    """Fitted again to the lowest of what the first fit leaves, where peaks have least part."""
    first = fit_background(freq, level, knee)
    flat = np.maximum(level - background(freq, first, knee), 0)
    low = flat <= np.quantile(flat, share, axis=1)[:, None]
    again = np.flatnonzero(low.sum(1) >= (4 if knee else 3))
    if len(again):
        first[again] = fit_background(freq, level[again], knee, first[again] if knee else None, low[again])
    return first


def gaussians(freq, peaks):
    """Sum of peaks (centre, height, deviation)."""
    out = np.zeros_like(freq)
    for c, h, s in peaks:
        out += h * np.exp(-((freq - c) ** 2) / (2 * s * s))
    return out


def find_peaks(freq, flat, limits: Limits) -> list:
    """The peaks of each row: the highest point is taken off as a Gaussian of its half width, again and again, until none stands out."""
    left, found, step, rows, places = flat.copy(), [[] for _ in flat], freq[1] - freq[0], np.arange(len(flat)), np.arange(len(freq))
    for _ in range(limits.most):
        at = left[rows].argmax(1)
        height = left[rows, at]
        out = (height > limits.deviations * left[rows].std(1)) & (height > limits.height)
        rows, at, height = rows[out], at[out], height[out]
        if not len(rows):
            break
        below = left[rows] <= height[:, None] / 2
        before = np.where(below & (places < at[:, None]), places, -1).max(1)
        after = np.where(below & (places > at[:, None]), places, len(freq)).min(1)
        gap = lambda i, some: np.where(some, np.abs(freq[np.clip(i, 0, len(freq) - 1)] - freq[at]), np.inf)  # noqa: B023, E731
        side = np.minimum(gap(before, before >= 0), gap(after, after < len(freq)))
        s = np.clip(np.where(np.isinf(side), step, side) / HALF, limits.narrow / 2, limits.wide / 2)
        left[rows] -= height[:, None] * np.exp(-((freq - freq[at][:, None]) ** 2) / (2 * s * s)[:, None])
        for row, *peak in zip(rows.tolist(), freq[at].tolist(), height.tolist(), s.tolist(), strict=True):
            found[row].append(tuple(peak))
    return [_apart(freq, peaks) for peaks in found]


def _apart(freq, found: list) -> list:
    """Peaks at the edges go, and of two whose middles overlap the lower."""
    kept: list = []
    for p in sorted((p for p in found if freq[0] + p[2] <= p[0] <= freq[-1] - p[2]), key=lambda p: -p[1]):
        if all(abs(p[0] - q[0]) > 0.75 * (p[2] + q[2]) for q in kept):
            kept.append(p)
    return sorted(kept)


def _by_count(peaks: list):
    """Rows of spectra with equally many peaks, some at least, and these peaks (rows x peaks x 3)."""
    counts = np.array([len(p) for p in peaks])
    for n in np.unique(counts[counts > 0]):
        rows = np.flatnonzero(counts == n)
        yield rows, np.array([peaks[i] for i in rows])


def _bells(freq, p):
    """Sum of peaks p (rows x 3 peaks), and its derivatives."""
    c, h, s = (p.reshape(len(p), 1, -1, 3)[..., i] for i in range(3))
    away = freq[:, None] - c
    bell = np.exp(-(away**2) / (2 * s * s))
    return (h * bell).sum(2), np.stack([h * bell * away / (s * s), bell, h * bell * away**2 / s**3], 3).reshape(len(p), len(freq), -1)


def _standing(got) -> list:
    return [sorted((c, h, s) for c, h, s in row if h > 0) for row in got.tolist()]


def refit_peaks(freq, flat, peaks: list, limits: Limits) -> list:
    """All peaks of each spectrum fitted at once, near where they were found."""
    out: list = [[] for _ in peaks]
    for rows, start in _by_count(peaks):
        wide, level = 1.5 * start[..., 2], flat[rows]
        lo = np.stack([np.maximum(freq[0], start[..., 0] - wide), np.zeros(wide.shape), np.full(wide.shape, limits.narrow / 2)], 2)
        hi = np.stack([np.minimum(freq[-1], start[..., 0] + wide), np.full(wide.shape, np.inf), np.full(wide.shape, limits.wide / 2)], 2)

        def model(p, at):
            whole, jac = _bells(freq, p)
            return whole - level[at], jac  # noqa: B023

        got = solve(model, *(v.reshape(len(rows), -1) for v in (start, lo, hi)), 100)
        for row, own in zip(rows, _standing(got.reshape(len(rows), -1, 3)), strict=True):
            out[row] = own
    return out


def refine(freq, level, own, peaks: list, knee: bool, limits: Limits):
    """Backgrounds and peaks fitted together, from where they are."""
    own, out = own.copy(), list(peaks)
    for rows, tops in _by_count(peaks):
        c, wanted = tops[..., 0], level[rows]
        ends = lambda first, parts: np.concatenate([np.tile(first, (len(rows), 1)), np.stack(parts, 2).reshape(len(rows), -1)], 1)  # noqa: B023, E731
        lo = ends([-np.inf, 0.0, -np.inf], [c - limits.wide, np.zeros(c.shape), np.full(c.shape, limits.narrow / 2)])
        hi = ends([np.inf, np.inf if knee else 0.0, np.inf], [c + limits.wide, np.full(c.shape, np.inf), np.full(c.shape, limits.wide / 2)])

        def model(p, at):
            power = np.maximum(freq ** p[:, 2:3], 1e-30)
            whole = p[:, 1:2] + power
            d = 1 / (whole * math.log(10))
            bells, jac = _bells(freq, p[:, 3:])
            base = np.stack([np.ones_like(power), -d if knee else np.zeros_like(power), -d * power * np.log(freq)], 2)
            return p[:, :1] - np.log10(whole) + bells - wanted[at], np.concatenate([base, jac], 2)  # noqa: B023

        got = solve(model, np.concatenate([own[rows], tops.reshape(len(rows), -1)], 1), lo, hi, 200)
        own[rows] = got[:, :3]
        for row, kept in zip(rows, _standing(got[:, 3:].reshape(len(rows), -1, 3)), strict=True):
            out[row] = kept
    return own, out


def _fit_alike(freq, level, knee: bool, limits: Limits) -> list:
    """Fits of spectra with the same bins, in rows of log10 power; None where the background isn't physical."""
    own = robust_background(freq, level, knee, limits.share)
    bells = lambda peaks: np.stack([gaussians(freq, p) for p in peaks])
    peaks: list = [[] for _ in level]
    for _ in range(limits.rounds):  # the background without peaks shows the peaks better, and these the background
        flat = level - background(freq, own, knee)
        peaks = refit_peaks(freq, flat, find_peaks(freq, flat, limits), limits)
        own = fit_background(freq, level - bells(peaks), knee, own if knee else None)
    own, peaks = refine(freq, level, own, peaks, knee, limits)
    whole = background(freq, own, knee) + bells(peaks)
    spread, rest = ((level - level.mean(1, keepdims=True)) ** 2).sum(1), level - whole
    good = np.isfinite(whole).all(1) & ~(own[:, 1] < 0)
    r2 = [float(1 - e @ e / t) if t > 0 else 0.0 for e, t in zip(rest, spread, strict=True)]
    return [{"offset": float(o[0]), "knee": float(o[1]), "exponent": float(o[2]), "r2": r, "error": float(np.abs(e).mean()), "peaks": [(c, h, 2 * s) for c, h, s in p]} if ok else None for o, r, e, p, ok in zip(own, r2, rest, peaks, good, strict=True)]


def fit_all(freqs, powers, knee: bool = False, limits: Limits = Limits()) -> list[dict]:
    """offset, knee, exponent, r2, error (mean absolute, log10) and peaks (centre, height over the background, full width) of each spectrum. All are NaN, and there are
    no peaks, with fewer than 6 usable bins or where the background isn't physical (knee below 0, or nothing finite).

    Spectra with the same usable bins are fitted together, about TOGETHER values at once.
    """
    out = [{"offset": math.nan, "knee": math.nan, "exponent": math.nan, "r2": math.nan, "error": math.nan, "peaks": []} for _ in freqs]
    alike: dict = {}
    for i, (freq, power) in enumerate(zip(freqs, powers, strict=True)):
        freq, power = np.asarray(freq, float), np.asarray(power, float)
        good = np.isfinite(freq) & np.isfinite(power) & (freq > 0) & (power > 0)
        if good.sum() < 6:
            continue
        order = np.argsort(freq[good], kind="stable")
        freq = freq[good][order]
        if freq[1] != freq[0]:
            alike.setdefault(freq.tobytes(), []).append((i, np.log10(power[good][order])))
    for bins, rows in alike.items():
        freq = np.frombuffer(bins)
        many = max(1, TOGETHER // len(freq))
        for at in range(0, len(rows), many):
            some = rows[at : at + many]
            with np.errstate(all="ignore"):
                got = _fit_alike(freq, np.stack([level for _, level in some]), knee, limits)
            for (i, _), one in zip(some, got, strict=True):
                out[i] = one or out[i]
    return out


def fit(freq, power, knee: bool = False, limits: Limits = Limits()) -> dict:
    """The same of one spectrum."""
    return fit_all([freq], [power], knee, limits)[0]
