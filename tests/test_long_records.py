"""Overviews, spatial summaries, beats and nulls of long records against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scans import by_channel, loop
from tideline.functions import dsp
from tideline.operators import beats, overview, scans, spatial, stats


def table(spark, records):
    return spark.createDataFrame([(c, i, float(v)) for c, xs in records.items() for i, v in enumerate(xs)], "ch long, i long, x double")


def test_medians_of_large_and_odd_groups(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(size=5001), 2: rng.integers(0, 3, 4000), 3: [7.0], 4: [1.0, 2.0], 5: rng.pareto(0.3, 999) * 1e6, 6: [-1.0] * 50 + [5.0] * 50, 7: [0.0] * 10}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, None), (1, float("nan")), (2, float("inf")), (9, None)]
    for buckets, passes in ((1024, 3), (4, 2), (2, 1)):
        got = {r["key"]: (r["n"], r["median"]) for r in stats.medians(spark.createDataFrame(rows, "key long, x double"), buckets, passes).collect()}
        assert got == {k: (len(xs), float(np.median(np.asarray(xs, float)))) for k, xs in groups.items()}


def sine(n, fs, *parts):
    t = np.arange(n) / fs
    return sum(a * np.sin(2 * np.pi * f * t) for f, a in parts)


@pytest.mark.parametrize("size", [97, 1 << 16])
def test_overview_arms_equal_whole_records(spark, size):
    fs = 64.0
    records = {1: sine(900, fs, (0.05, 3.0), (2.0, 1.0), (20.0, 1.0)), 2: np.random.default_rng(1).normal(size=400).cumsum()}
    got = overview.arms(table(spark, records), fs, 4.0, 0.1, size=size)
    for arm, low in (("raw", None), ("high", 0.1)):
        own = by_channel(got.where(F.col("arm") == arm))
        for c, x in records.items():
            assert np.abs(own[c] - dsp.cascade(x, dsp.sections(fs, low, 4.0))).max() < 1e-8


def test_a_pyramid_is_built_from_the_level_below(spark):
    records = {1: np.random.default_rng(3).normal(size=1003), 2: np.arange(17.0)}
    built = overview.pyramid(table(spark, records), 4, levels=3, fan=5)
    got = {(r["ch"], r["level"], r["k"]): (r["lo"], r["hi"], r["n"]) for r in built.collect()}
    want = {}
    for c, x in records.items():
        for level in range(3):
            d, span = x[::4], 5**level
            for k in range(-(-len(d) // span)):
                part = d[k * span : (k + 1) * span]
                want[c, level, k] = (part.min(), part.max(), len(part))
    assert got == want
    assert overview.level_for(100, 2.0, 40, 5, 3) == 1 and overview.level_for(1, 2.0, 40, 5, 3) == 0
    seen = overview.view(built, 2.0, 10.0, 50.0, 10, 5, 3).where("ch = 1").orderBy("pixel").collect()
    d = records[1][::4]
    points = [(k * 5 / 2.0, d[k * 5 : k * 5 + 5]) for k in range(51)]
    for r in seen:
        own = np.concatenate([p for t, p in points if 10 + 5 * r["pixel"] <= t < 15 + 5 * r["pixel"]])
        assert (r["lo"], r["hi"]) == (own.min(), own.max())
    assert len(seen) == 10
    with pytest.raises(ValueError):
        overview.stride_of(256.0, 3.0)
    assert overview.stride_of(256.0, 4.0) == 64


@pytest.mark.parametrize("block,bins", [(128, 4096), (5, 3)])
def test_spatial_summary(spark, block, bins):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(23, 10)) + 1j * rng.normal(size=(23, 10))
    z[7] = 0
    z[11] = 2 * z[3]
    df = spark.createDataFrame([(c, k, float(v.real), float(v.imag)) for c, row in enumerate(z) for k, v in enumerate(row)], "ch long, k long, re double, im double")
    cov = (z @ z.conj().T).real
    r = [abs(cov[a, b]) / math.sqrt(cov[a, a] * cov[b, b]) for a in range(23) for b in range(a + 1, 23) if cov[a, a] * cov[b, b] > 0]
    got = spatial.spatial_summary(df, block, bins).collect()
    assert len(got) == 1 and got[0]["channels"] == 23
    assert got[0]["rank"] == pytest.approx(np.trace(cov) ** 2 / (cov**2).sum()) and got[0]["correlation"] == pytest.approx(np.median(r))
    assert spatial.spatial_summary(df.where("ch = 7"), block, bins).first()["rank"] is None


def plain_peaks(x, height, rise, distance):
    at, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                at.append((i + j) // 2)
            i = j
        i += 1
    at = [p for p in at if x[p] >= height]
    keep = dict.fromkeys(at, True)
    for p in sorted(at, key=lambda p: (-x[p], -p)):
        if keep[p]:
            keep |= {q: False for q in at if q != p and abs(q - p) < distance}
    out = []
    for p in (p for p in at if keep[p]):
        sides = []
        for step in (-1, 1):
            q, low = p, x[p]
            while 0 <= q < len(x) and x[q] <= x[p]:
                low = min(low, x[q])
                q += step
            sides.append(low)
        if x[p] - max(sides) >= rise:
            out.append((p, x[p] - max(sides)))
    return out


def heart(n, fs, seed):
    rng, x, at = np.random.default_rng(seed), np.zeros(n), 60.0
    while at < n - 60:
        t = (np.arange(n) - at) / fs
        x += rng.uniform(0.6, 1.4) * (np.exp(-((t / 0.01) ** 2)) - 0.3 * np.exp(-(((t - 0.03) / 0.015) ** 2))) + 0.15 * np.exp(-(((t - 0.25) / 0.05) ** 2))
        at += fs * rng.uniform(0.35, 1.2)
    return x + 0.02 * rng.normal(size=n) + 0.5 * np.sin(2 * np.pi * 0.2 * np.arange(n) / fs)


@pytest.mark.parametrize("size", [80, 333, 1 << 16])
def test_qrs_peaks_at_any_chunking(spark, size):
    fs = 128.0
    records = {1: heart(3000, fs, 1), 2: heart(900, fs, 2), 3: np.random.default_rng(5).normal(size=600), 4: np.zeros(10)}
    got = {}
    for r in beats.qrs_peaks(table(spark, records), fs, size=size).orderBy("ch", "i").collect():
        got.setdefault(r["ch"], []).append((r["i"], r["prominence"]))
    sections = dsp.butterworth_bandpass(3, 8.0, 25.0, fs)
    settled, level = [], 1.0
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        settled += [level * (gain - b0), level * (b2 - a2 * gain)]
        level *= gain
    for c, x in records.items():
        if len(x) <= 21:
            assert c not in got
            continue
        y = np.r_[2 * x[0] - x[21:0:-1], x, 2 * x[-1] - x[-2:-23:-1]]
        for _ in range(2):
            y = loop(y, sections, np.array(settled) * y[0])[::-1]
        y = y[21:-21]
        e = np.convolve(y * y, np.ones(15) / 15, mode="same")
        centre = np.median(e)
        mad = np.median(np.abs(e - centre))
        want = plain_peaks(e, centre + 8 * mad, 8 * mad, 58)
        assert [i for i, _ in got.get(c, [])] == [i for i, _ in want]
        assert np.allclose([p for _, p in got.get(c, [])], [p for _, p in want], atol=1e-9)
    assert len(got[1]) > 15


def test_prominence_across_many_chunks(spark):
    """A walk's peaks: valleys reach over chunks, hidden records and both ends."""
    rng = np.random.default_rng(8)
    records = {1: rng.normal(size=700).cumsum().round(1), 2: np.tile([0.0, 3.0, 3.0, 1.0, 5.0, 2.0], 60)}
    levels = table(spark, records)
    bounds = spark.createDataFrame([(1, -1e9), (2, -1e9)], "ch long, height double")
    for size in (7, 64, 1000):
        peaks, outlines = beats._summaries(levels, bounds, size)
        done = F.col("left_done") & F.col("right_done")
        whole = peaks.where(done).select("ch", "i", "height", "left", "right").unionByName(beats._carried(peaks.where(~done), outlines, size))
        got = {(r["ch"], r["i"]): round(r["height"] - max(r["left"], r["right"]), 9) for r in whole.collect()}
        assert got == {(c, i): round(p, 9) for c, x in records.items() for i, p in plain_peaks(x, -1e9, -1, 1)}


def test_peaks_in_each_others_way(spark):
    rng = np.random.default_rng(9)
    at = np.unique(rng.integers(0, 600, 150))
    heights = rng.integers(0, 20, len(at))
    df = spark.createDataFrame([(1, int(i), float(h)) for i, h in zip(at, heights)] + [(2, 5, 1.0)], "ch long, i long, height double")
    x = dict(zip(at.tolist(), heights.tolist()))
    keep = dict.fromkeys(x, True)
    for p in sorted(x, key=lambda p: (-x[p], -p)):
        if keep[p]:
            keep |= {q: False for q in x if q != p and abs(q - p) < 9}
    got = sorted((r["ch"], r["i"]) for r in beats.spaced(df, 9).collect())
    assert got == [(1, p) for p in x if keep[p]] + [(2, 5)]


def test_shuffled_phase_null(spark):
    rng = np.random.default_rng(6)
    rows = []
    for ch in (1, 2):
        for i in range(120):
            phase = rng.uniform(0, 2 * np.pi)
            rows.append((ch, i, float(60 + (5 * np.cos(phase) if ch == 1 else 0) + rng.normal()), float(phase)))
    df = spark.createDataFrame(rows, "ch long, i long, rate double, phase double")
    got = {r["ch"]: r for r in beats.shuffled_phase_null(df, 50, seed=3).collect()}
    again = {r["ch"]: r for r in beats.shuffled_phase_null(df.repartition(7, "phase"), 50, seed=3).collect()}
    for ch in (1, 2):
        own = [(i, rate, p) for c, i, rate, p in rows if c == ch]
        mean = np.mean([r for _, r, _ in own])
        depth = lambda phases: 2 * abs(np.mean([(r - mean) * np.exp(1j * p) for (_, r, _), p in zip(own, phases)])) / mean  # noqa: B023, E731
        draw = lambda rep, i: int(hashlib.md5(f"3:{ch}:{rep}:{i}".encode()).hexdigest()[:8], 16) / 2**32 * 2 * np.pi  # noqa: B023, E731
        null = [depth([draw(rep, i) for i, _, _ in own]) for rep in range(50)]
        assert got[ch]["depth"] == pytest.approx(depth([p for _, _, p in own])) and got[ch]["p95"] == pytest.approx(np.percentile(null, 95))
        assert again[ch]["p95"] == pytest.approx(got[ch]["p95"]) and got[ch]["present"] == (ch == 1) and got[ch]["beats"] == 120


def test_interleaved_complexity_and_shared_shuffles(spark):
    from tideline.functions.rng import Stream
    from tideline.operators import channels

    rng = np.random.default_rng(10)
    runs = {r: rng.integers(0, 2, (3, 40)) for r in range(4)}
    runs[4] = runs[0][:, ::-1]  # same length and density
    rows = [(r, place, i, int(v)) for r, m in runs.items() for place, xs in enumerate(m) for i, v in enumerate(xs)] + [(0, 1, 40, 1)]
    records = channels.interleaved(spark.createDataFrame(rows, "run long, place int, i long, s int"))
    got = {r["ch"]: list(r["xs"]) for r in records.collect()}
    assert got == {r: m.T.ravel().tolist() for r, m in runs.items()}
    for parse, kernel in (("lz76", dsp.lz76), ("lzw", dsp.lzw)):
        computed = spark.sparkContext.accumulator(0)
        out = channels.complexity(records.repartition(5), parse, computed=computed)
        for _ in range(2):
            rows_ = {r["ch"]: r for r in out.collect()}
        keys = {(120, int(m.sum())) for m in runs.values()}
        assert computed.value == len(keys)
        for r, m in runs.items():
            s = m.T.ravel()
            ones = int(s.sum())
            mean = dsp.shuffled_complexity(np.r_[np.ones(ones, int), np.zeros(120 - ones, int)], kernel, Stream(0, f"shuffle/{(120, ones)}").generator())
            assert (rows_[r]["raw"], rows_[r]["ones"]) == (kernel(s), ones) and rows_[r]["ratio"] == pytest.approx(kernel(s) / mean)


def test_provenance_of_a_closure(spark):
    from tideline.sources import params

    registry = spark.createDataFrame([("a", "measured", "scalar"), ("b", "invented", "scalar"), ("c", "derived", "pending"), ("d", "derived", "solved")], "key string, standing string, kind string")
    closure = spark.createDataFrame([("m1", "a"), ("m1", "d"), ("m2", "a"), ("m2", "b"), ("m3", "c"), ("m4", "nowhere")], "metric string, key string")
    assert {r["metric"]: r["provisional"] for r in params.provisional_metrics(closure, registry).collect()} == {"m1": False, "m2": True, "m3": True, "m4": True}


@pytest.mark.parametrize("size", [200, 1 << 16])
def test_band_amplitude_follows_a_phase(spark, size):
    from tideline.operators import coupling

    fs, n = 64.0, 1500
    t = np.arange(n) / fs
    phase = 2 * np.pi * 0.25 * t
    x = (1 + 0.5 * np.cos(phase - 1.0)) * np.sin(2 * np.pi * 10 * t) + 3 * np.sin(2 * np.pi * 1.0 * t)
    phases = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(phase)], "ch long, i long, phase double")
    got = coupling.band_amplitude_harmonic(table(spark, {1: x}), phases, 8.0, 12.0, fs, size=size).first()
    band = dsp.cascade(x, dsp.sections(fs, 8.0, 12.0))
    half = 8
    env = np.array([np.sqrt(np.mean(band[max(0, i - half) : i + half + 1] ** 2)) for i in range(n)])
    z = np.mean(env * np.exp(1j * phase))
    assert got["depth"] == pytest.approx(2 * abs(z) / env.mean(), rel=1e-6) and got["amplitude"] == pytest.approx(env.mean(), rel=1e-6)
    assert got["max_phase"] == pytest.approx(np.angle(z), abs=1e-6) and abs(got["max_phase"] - 1.0) < 0.2
    v = coupling.periodic_vector(spark.createDataFrame([got])).first()
    assert math.hypot(v["cosine"], v["sine"]) == pytest.approx(v["amplitude"])
    a = spark.createDataFrame([(1, 1.0, 3.0, 4.0)], "ch long, mean double, cosine double, sine double")
    b = spark.createDataFrame([(1, 0.5, 3.0, 3.0)], "ch long, mean double, cosine double, sine double")
    d = coupling.vector_difference(a, b, ["ch"]).first()
    assert (d["mean"], d["cosine"], d["sine"], d["amplitude"]) == (0.5, 0.0, 1.0, 1.0) and d["phase"] == pytest.approx(math.pi / 2)


def test_exponent_job_of_stored_epochs(spark):
    from tideline.operators import coupling, spectra
    from tideline.sources import epochs

    rng = np.random.default_rng(11)
    x = {c: rng.normal(size=320).cumsum() for c in ("Fz", "A1", "A2")}
    rows = [("r", c, place, i, float(v)) for place, (c, xs) in enumerate(x.items()) for i, v in enumerate(xs)]
    stored = epochs.blocks(spark.createDataFrame(rows, "run_id string, channel string, place int, i long, x double"), 8.0, 80)
    got = coupling.exponent_job_of_epochs(stored, "Fz", [0.1, 0.25], lo=0.5, hi=3.5).orderBy("rate").collect()
    plain = table(spark, {1: x["Fz"] - (x["A1"] + x["A2"]) / 2})
    chi = spectra.exponent_over_time(plain, 8.0, 2.0, 0.25, 0.5, 3.5)
    assert [r["rate"] for r in got] == [0.1, 0.25] and {r["frames"] for r in got} == {chi.count()}
    for r in got:
        assert r["depth"] == pytest.approx(spectra.modulation_depth(chi, "chi", r["rate"], 0.25).first()["depth"])
    with pytest.raises(ValueError, match="continue"):
        coupling.exponent_job_of_epochs(stored.where("epoch <> 2"), "Fz", [0.1])


def test_alpha_metrics_are_those_of_the_envelope(spark):
    from tideline.operators import coupling

    fs, n = 64.0, 1200
    t = np.arange(n) / fs
    x = np.where((t // 3) % 2 == 0, 2.0, 0.4) * np.sin(2 * np.pi * 10 * t) + np.random.default_rng(12).normal(size=n)
    got = coupling.alpha_metrics(table(spark, {1: x}), 8.0, 12.0, fs, 100).first()
    band = dsp.cascade(x, dsp.sections(fs, 8.0, 12.0))
    env = np.array([np.sqrt(np.mean(band[max(0, i - 8) : i + 9] ** 2)) for i in range(n)])
    d = env - env.mean()
    m2, m3, m4 = ((d**k).mean() for k in (2, 3, 4))
    assert got["level"] == pytest.approx(env.mean()) and got["bimodality"] == pytest.approx((m3 * m3 / m2**3 + 1) / (m4 / m2**2), rel=1e-5)
    lags = [k for k in range(1, 101) if (d[: n - k] * d[k:]).sum() <= (d * d).sum() / math.e]
    assert got["lag"] == lags[0] and got["bimodality"] > 0.555
