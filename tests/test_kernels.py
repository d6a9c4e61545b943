"""NumPy kernels, streams and generators against closed forms and invariants."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.functions import dsp, generators
from tideline.functions.rng import Stream
from tideline.operators import spectra
from tideline.sources import montage
from tideline.streaming import controllers

FS = 256.0


def test_streams_are_pure_functions_of_seed_and_name():
    a, b = Stream(1, "x"), Stream(1, "y")
    first = [a.next_uint32() for _ in range(5)]
    b.next_uint32()
    assert [Stream(1, "x").next_uint32() for _ in range(1)] == first[:1]
    assert Stream(2, "x").next_uint32() != first[0] != b.next_uint32()
    draws = np.array([Stream(7).next_float()] + [(s := Stream(9)).next_float()])
    assert ((draws >= 0) & (draws < 1)).all() and s


def test_a_saved_stream_keeps_the_spare_normal():
    s = Stream(3, "n")
    s.normal()
    t = Stream.restore(json.loads(json.dumps(s.save())))
    assert [s.normal() for _ in range(5)] == [t.normal() for _ in range(5)]
    x = np.array([Stream(5).normal()] + [(u := Stream(5, "m")).normal() for _ in range(1)] + [u.normal() for _ in range(20000)])
    assert abs(x.mean()) < 0.03 and abs(x.std() - 1) < 0.03
    e = [u.exponential(2.0) for _ in range(20000)]
    assert abs(np.mean(e) - 0.5) < 0.02


def test_filters():
    t = np.arange(4096) / FS
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 60 * t)
    low = dsp.cascade(slow + fast, dsp.sections(FS, None, 10.0))
    assert np.abs(low - slow)[500:-500].max() < 0.02
    assert (dsp.cascade(slow, []) == slow).all() and dsp.sections(FS, None, 128.0) == []
    padded = dsp.padded_cascade(np.ones(200) * 5, dsp.sections(FS, None, 10.0))
    assert np.allclose(padded, 5)
    for bad in (np.ones(10), np.r_[np.ones(200), np.nan]):
        with pytest.raises(ValueError):
            dsp.padded_cascade(bad, dsp.sections(FS, None, 10.0))
    with pytest.raises(ValueError):
        dsp.butterworth_qs(3)


def test_filtering_epochs_alone_differs_from_filtering_the_record():
    t = np.arange(150 * 256) / FS
    x = 25 * np.sin(2 * np.pi * t) + 200 * (t > 75)
    s = dsp.sections(FS, 0.5, 40.0)
    whole, joined = dsp.cascade(x, s), dsp.cascade(np.r_[x[30 * 256 : 60 * 256], x[90 * 256 : 120 * 256]], s)
    assert np.abs(np.r_[whole[30 * 256 : 60 * 256], whole[90 * 256 : 120 * 256]] - joined).max() > 10


def test_spectra_know_a_tone_and_white_noise():
    x = 3 * np.cos(2 * np.pi * 16 * np.arange(8192) / FS)
    k, f, p = dsp.welch(x, FS, 1024, 512)
    assert f[np.argmax(p)] == 16 and abs(p.sum() * FS / 1024 - 4.5) < 0.1
    g = np.random.default_rng(1).standard_normal(300 * 256)
    _, f, p = dsp.welch(g, FS, 1024, 512)
    band = (f >= 1) & (f <= 45)
    assert abs(dsp.fit_line(f[band], p[band])[0]) < 0.1
    f2, p2 = dsp.hybrid(g, FS)
    assert (np.diff(f2) > 0).all() and (p2 > 0).all()


@pytest.mark.parametrize("chi,knee", [(1.0, 0.0), (2.0, 0.0), (2.0, 100.0)])
def test_aperiodic_records_have_their_exponent(chi, knee):
    x = generators.aperiodic(60 * 256, chi, knee, FS, 4)
    _, f, p = dsp.welch(x, FS, 1024, 512)
    band = (f >= 1) & (f <= 45)
    best = dsp.fit_knee(f[band], p[band], spectra.knee_grid())
    assert abs(best["chi"][0] - chi) < 0.35 and best["r2"][0] > 0.9
    if not knee:
        assert abs(dsp.fit_line(f[band], p[band])[0] - chi) < 0.15


@pytest.mark.parametrize("delta", [-0.8, 0.8])
def test_tilt_changes_the_exponent_by_its_sign_and_size(delta):
    design = dsp.tilt_design(delta, FS, 1.0, 45.0)
    f = np.geomspace(1.5, 30, 40)
    gain = np.array([dsp.tilt_gain(design, v, FS) for v in f])
    assert abs(dsp.fit_line(f, gain**2)[0] - delta) < 0.15
    assert abs(dsp.tilt_gain(design, math.sqrt(45.0), FS) - 1) < 1e-9
    x = np.random.default_rng(2).standard_normal(2048)
    for levels in (0, 17):
        y = dsp.tilted_over_time(x, np.full(2048, delta), FS, 1.0, 45.0, 192, levels)
        assert np.isfinite(y).all()
        assert np.allclose(dsp.tilted_over_time(x, np.zeros(2048), FS, 1.0, 45.0, 192, levels), x)


def test_envelope_of_a_tone_is_its_amplitude():
    z = dsp.analytic(2 * np.cos(2 * np.pi * 8 * np.arange(1024) / FS))
    assert np.allclose(np.abs(z), 2)


def test_complexity_orders_signals():
    rng = np.random.default_rng(3)
    n = 4096
    box = (np.arange(n) // 256 % 2).tolist()
    noise = rng.integers(0, 2, n).tolist()
    smooth = (dsp.cascade(rng.standard_normal(n), dsp.sections(FS, None, 8.0)) > 0).astype(int).tolist()
    for parse in (dsp.lz76, dsp.lzw):
        assert parse(box) < parse(smooth) < parse(noise)
    assert dsp.lz76([0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1]) == 6
    assert dsp.lz76([]) == 0 and dsp.lzw([]) == 0 and dsp.lz76([0] * 50) == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40))
def test_lz76_is_the_exhaustive_history(bits):
    s, at, count = "".join(map(str, bits)), 0, 0
    while at < len(s):
        size = next((k for k in range(1, len(s) - at + 1) if s[at : at + k] not in s[: at + k - 1]), len(s) - at)
        at, count = at + size, count + 1
    assert dsp.lz76(bits) == count


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=6), st.integers(0, 50))
def test_chunks_joined_equal_the_whole(chunks, seed):
    n = sum(chunks)
    whole, belt, phase, _ = controllers.breathe(controllers.breathing_state(seed), n)
    heart, ecg, beats = controllers.beat(controllers.heart_state(seed), n, phase)
    s, h, at, parts, hearts, found = controllers.breathing_state(seed), controllers.heart_state(seed), 0, [], [], []
    for c in chunks:
        s, b, p, _ = controllers.breathe(json.loads(json.dumps(s)), c)
        h, e, t = controllers.beat(json.loads(json.dumps(h)), c, p)
        parts, hearts, found, at = parts + b, hearts + e, found + t, at + c
    assert parts == belt and hearts == ecg and found == beats and json.dumps([s, h]) == json.dumps([whole, heart])


def test_infra_slow_chunks_and_variance():
    whole, x = controllers.drift(controllers.infra_state(2), 3000)
    s, parts = controllers.infra_state(2), []
    for c in (1, 999, 2000):
        s, y = controllers.drift(json.loads(json.dumps(s)), c)
        parts += y
    assert parts == x and json.dumps(s) == json.dumps(whole)
    _, long = controllers.drift(controllers.infra_state(4), 4 * 4000, fs=4.0)
    assert 0.6 < np.std(long) < 1.6


def test_fixed_breathing_has_no_variability():
    _, _, _, onsets = controllers.breathe(controllers.breathing_state(1), 8000, params={"fixed": True})
    assert len({o["n"] for o in onsets}) == 1 and len({o["depth"] for o in onsets}) == 1


def test_arms_differ_only_in_what_is_switched():
    a, b = (generators.compose("n2", 5, 20, events=e, channels=["Cz"]) for e in (True, False))
    assert len(a["events"]) > 0 and not b["events"]
    phase = a["phase"]
    plain, coupled = (generators.graphoelements("n2", 20 * 256, FS, 5, phase, k)[0] for k in (0.0, 5.0))
    assert len(plain) == len(coupled) and [e["type"] for e in plain].count("kcomplex") == [e["type"] for e in coupled].count("kcomplex")
    same = generators.compose("n2", 5, 20, channels=["Cz"])
    assert (same["channels"]["Cz"] == a["channels"]["Cz"]).all()


def test_generator_parts():
    x = generators.damped_oscillator(8192, 10.0, 1.0, FS, 1)
    _, f, p = dsp.welch(x, FS, 1024, 512)
    assert 9 <= f[np.argmax(p)] <= 11
    assert len(generators.damped_oscillator(500, 10.0, 1.0, FS, 1, other=4.0)) == 500
    e = generators.envelope(4096, 0.5, 0.5, FS, 2, unit_power=True)
    assert abs((e**2).mean() - 1) < 1e-9
    assert generators.burst_envelope(4096, 1.0, 0.5, 0.3, FS, 3).max() <= 1
    assert len(generators.reshaped(x, 0.4, 0.2)) == len(x)
    s = Stream(1, "p")
    angles = [generators.von_mises_phase(1.0, 8.0, s) for _ in range(500)]
    assert abs(np.angle(np.mean(np.exp(1j * np.array(angles)))) - 1) < 0.1
    assert generators.marker_time(np.zeros(10), FS, 0, 1, s, 5, 5) is None
    assert abs(generators.oscillation(4096, 8, 12, 3.0, FS, 1, "a").std() - 3) < 0.1
    assert all(montage.weight(g, c) > 0 for g, c in itertools.product(montage.PATCHES, montage.SCALP))
