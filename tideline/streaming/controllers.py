"""Resumable generators: breathing, heart beat and infra-slow drive. A state is a JSON-able dict; chunks joined equal the whole."""

from __future__ import annotations

import math

from tideline.functions.rng import Stream

BREATHING = {"mean_s": 4.2, "cv": 0.08, "depth_cv": 0.12, "ie": 0.55, "pause_s": 0.2, "pause_p": 0.3, "tau_fast_breaths": 3.0, "tau_slow_s": 60.0, "fast": 0.3, "slow": 0.5, "depth_r": 0.4, "fixed": False}
HEART = {"mean_rr_s": 0.95, "floor_s": 0.35, "rsa_s": 0.03, "rsa_phase": 0.6, "sdnn_s": 0.05, "fast": 0.6, "tau_fast_s": 3.0, "tau_slow_s": 40.0}
INFRA = {"lo": 0.008, "hi": 0.05, "exponent": 1.0, "poles": 8, "tick_hz": 2.0}
#: Waves of a beat: phase of the interval, width as a share of it, height.
WAVES = [(-0.18, 0.025, 0.12), (-0.03, 0.008, -0.12), (0.0, 0.009, 1.0), (0.03, 0.009, -0.2), (0.28, 0.05, 0.28)]


def breathing_state(seed: int, name: str = "respiration") -> dict:
    rng = Stream(seed, name)
    return {"version": 1, "rng": rng.save(), "z1": rng.normal() * 0, "z2": 0.0, "left": 0, "at": 0, "breath": None, "made": 0}


def next_breath(state: dict, fs: float, p: dict) -> dict:
    """Draws one breath: lengths in samples, starting height and depth. A fixed-rate run has no variability."""
    rng = Stream.restore(state["rng"])
    rho_f, rho_s = math.exp(-1 / p["tau_fast_breaths"]), math.exp(-p["mean_s"] / p["tau_slow_s"])
    draws = [rng.normal() for _ in range(4)]
    state["z1"] = rho_f * state["z1"] + math.sqrt(1 - rho_f**2) * draws[0]
    state["z2"] = rho_s * state["z2"] + math.sqrt(1 - rho_s**2) * draws[1]
    pauses = [rng.next_float() < p["pause_p"] for _ in range(2)]
    state["rng"] = rng.save()
    rest = max(0.0, 1 - p["fast"] - p["slow"])
    drive = math.sqrt(p["fast"]) * state["z1"] + math.sqrt(p["slow"]) * state["z2"] + math.sqrt(rest) * draws[2]
    deep = p["depth_r"] * state["z1"] + math.sqrt(1 - p["depth_r"] ** 2) * draws[3]
    if p["fixed"]:
        drive, deep, pauses = 0.0, 0.0, [False, False]
    log = lambda cv, z: math.exp(math.sqrt(math.log(1 + cv * cv)) * z - math.log(1 + cv * cv) / 2) if not p["fixed"] else 1.0
    total = max(8, round(p["mean_s"] * log(p["cv"], drive) * fs))
    held = [round(p["pause_s"] * fs) if q else 0 for q in pauses]
    active = max(4, total - sum(held))
    inhale = round(active * p["ie"] / (1 + p["ie"]))
    before = state["breath"]
    made = {"n": total, "inhale": inhale, "inhale_pause": held[0], "exhale": active - inhale, "depth": log(p["depth_cv"], deep)}
    made["start"] = made["depth"] if before is None else before["depth"]
    state["made"] += 1
    return made


def breathe(state: dict, n: int, fs: float = 256, params: dict | None = None) -> tuple[dict, list[float], list[float], list[dict]]:
    """(state, belt, phase, onsets) of the next n samples. The state passed in stays as it was."""
    p, s = BREATHING | (params or {}), {**state, "rng": list(state["rng"])}
    belt, phase, onsets = [], [], []
    for _ in range(n):
        if s["breath"] is None or s["left"] >= s["breath"]["n"]:
            s["breath"], s["left"] = next_breath(s, fs, p), 0
            onsets.append({"onset": s["at"], **s["breath"]})
        b, t = s["breath"], s["left"]
        if t < b["inhale"]:
            belt.append(-b["start"] + (b["depth"] + b["start"]) * (0.5 - 0.5 * math.cos(math.pi * t / max(1, b["inhale"]))))
        elif t < b["inhale"] + b["inhale_pause"]:
            belt.append(b["depth"])
        elif t < b["inhale"] + b["inhale_pause"] + b["exhale"]:
            belt.append(b["depth"] * math.cos(math.pi * (t - b["inhale"] - b["inhale_pause"]) / max(1, b["exhale"])))
        else:
            belt.append(-b["depth"])
        peak = b["inhale"] + b["inhale_pause"] / 2
        phase.append(math.pi * (t / peak - 1) if t < peak else math.pi * (t - peak) / (b["n"] - peak))
        s["left"], s["at"] = t + 1, s["at"] + 1
    return s, belt, phase, onsets


def heart_state(seed: int, params: dict | None = None, name: str = "cardiac") -> dict:
    p, rng = HEART | (params or {}), Stream(seed, name)
    first = rng.uniform(0, p["mean_rr_s"])
    return {"version": 1, "rng": rng.save(), "z1": 0.0, "z2": 0.0, "at": 0, "next": first, "rr": p["mean_rr_s"], "beats": []}


def beat(state: dict, n: int, phase, fs: float = 256, depth: float = 1.0, params: dict | None = None) -> tuple[dict, list[float], list[float]]:
    """(state, ecg, beat times) of the next n samples; `phase` is the breathing phase of each of them.

    An interval is drawn when its beat falls due: mean, the breathing swing, and a slow and a fast residual within what
    variance the swing leaves. A beat's waves before its R peak are drawn from the beat that comes next, so every
    sample depends on the state and the phases up to one interval ahead of it at most, never on where chunks end.
    """
    p, s = HEART | (params or {}), {**state, "rng": list(state["rng"]), "beats": [list(b) for b in state["beats"]]}
    sd = math.sqrt(max(0.0, p["sdnn_s"] ** 2 - p["rsa_s"] ** 2 / 2))
    ecg, times = [], []
    for k in range(n):
        t = s["at"] / fs
        if t >= s["next"]:
            rng = Stream.restore(s["rng"])
            for z, tau in (("z1", p["tau_fast_s"]), ("z2", p["tau_slow_s"])):
                rho = math.exp(-p["mean_rr_s"] / tau)
                s[z] = rho * s[z] + math.sqrt(1 - rho * rho) * rng.normal()
            s["rng"] = rng.save()
            swing = p["rsa_s"] * depth * math.sin(phase[k] - p["rsa_phase"])
            rr = max(p["floor_s"], p["mean_rr_s"] + swing + sd * (math.sqrt(p["fast"]) * s["z1"] + math.sqrt(1 - p["fast"]) * s["z2"]))
            times.append(s["next"])
            s["beats"] = [*s["beats"][-1:], [s["next"], s["rr"], rr]]
            s["rr"], s["next"] = rr, s["next"] + rr
        v = 0.0
        for r, before, after in [*s["beats"], [s["next"], s["rr"], s["rr"]]]:
            for where, width, height in WAVES:
                rr = before if where <= 0 else after
                z = (t - r - where * rr) / (width * rr)
                if abs(z) <= 4:
                    v += height * math.exp(-z * z / 2)
        ecg.append(v)
        s["at"] += 1
    return s, ecg, times


def infra_coefficients(p: dict) -> tuple[list[float], list[float], list[float], float, float]:
    """Decay and weight of each pole, the two low-passes' rates, and from the impulse's energy the factor to unit variance and the correlation from tick to tick."""
    ratio = (p["hi"] / p["lo"]) ** (1 / (p["poles"] - 1))
    f = [p["lo"] * ratio**i for i in range(p["poles"])]
    decay = [math.exp(-2 * math.pi * x / p["tick_hz"]) for x in f]
    weights = [x ** (-p["exponent"] / 2) for x in f]
    norm = math.sqrt(sum(w * w for w in weights))
    weights = [w / norm for w in weights]
    rates = [1 - math.exp(-2 * math.pi * c / p["tick_hz"]) for c in (p["hi"], p["lo"])]
    energy = beside = 0.0
    for j in range(p["poles"]):
        z, low, last = [0.0] * p["poles"], [0.0] * 4, 0.0
        for k in range(int(40 * p["tick_hz"] / p["lo"] / 8)):
            z = [d * v for d, v in zip(decay, z, strict=True)]
            if k == 0:
                z[j] += math.sqrt(1 - decay[j] ** 2)
            out = _infra_out(z, weights, rates, low)
            energy, beside, last = energy + out * out, beside + last * out, out
    return decay, weights, rates, 1 / math.sqrt(energy), beside / energy


def _infra_out(z: list[float], weights: list[float], rates: list[float], low: list[float]) -> float:
    x = sum(w * v for w, v in zip(weights, z, strict=True))
    for i, r in ((0, rates[0]), (2, rates[1])):
        low[i] += r * (x - low[i])
        low[i + 1] += r * (low[i] - low[i + 1])
    return low[1] - low[3]


def infra_state(seed: int, params: dict | None = None, name: str = "infraslow") -> dict:
    """Burnt in for five turns of the slowest rate."""
    p, rng = INFRA | (params or {}), Stream(seed, name)
    s = {"version": 1, "rng": rng.save(), "z": [0.0] * p["poles"], "low": [0.0] * 4, "at": 0, "a": 0.0, "b": 0.0}
    co = infra_coefficients(p)
    for _ in range(int(5 * p["tick_hz"] / p["lo"]) + 2):
        _infra_tick(s, co)
    return s


def _infra_tick(s: dict, co) -> None:
    decay, weights, rates, scale, _ = co
    rng = Stream.restore(s["rng"])
    s["z"] = [d * v + math.sqrt(1 - d * d) * rng.normal() for d, v in zip(decay, s["z"], strict=True)]
    s["rng"] = rng.save()
    s["low"] = list(s["low"])
    s["a"], s["b"] = s["b"], scale * _infra_out(s["z"], weights, rates, s["low"])


def drift(state: dict, n: int, fs: float = 256, params: dict | None = None) -> tuple[dict, list[float]]:
    """(state, drive) of the next n samples: ticks joined by straight lines, scaled so that their mean variance is the ticks'."""
    p, s = INFRA | (params or {}), {**state, "rng": list(state["rng"]), "low": list(state["low"])}
    co, per, out = infra_coefficients(p), round(fs / p["tick_hz"]), []
    scale = math.sqrt(per / sum((1 - u) ** 2 + u * u + 2 * u * (1 - u) * co[4] for u in (k / per for k in range(per))))
    for _ in range(n):
        u = s["at"] % per / per
        if u == 0 and s["at"]:
            _infra_tick(s, co)
        out.append(((1 - u) * s["a"] + u * s["b"]) * scale)
        s["at"] += 1
    return s, out
