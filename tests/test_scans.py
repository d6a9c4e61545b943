"""Filters by chunks against whole records, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import dsp
from tideline.operators import scans

RNG = np.random.default_rng(7)
RECORDS = {1: RNG.normal(size=1000).cumsum(), 2: RNG.normal(size=257), 3: np.ones(64), 5: RNG.normal(size=1)}
BAND = dsp.butterworth_bandpass(4, 0.3, 35.0, 256.0)


def table(spark, records=RECORDS):
    return spark.createDataFrame([(c, i, float(v)) for c, xs in records.items() for i, v in enumerate(xs)], "ch long, i long, x double")


def by_channel(df):
    out = {}
    for r in df.orderBy("ch", "i").collect():
        out.setdefault(r["ch"], []).append((r["i"], r["x"]))
    assert all([i for i, _ in v] == list(range(len(v))) for v in out.values())
    return {c: np.array([x for _, x in v]) for c, v in out.items()}


def loop(x, sections, starts=None):
    """Sample by sample, in transposed direct form."""
    for n, (b0, b1, b2, a1, a2) in enumerate(sections):
        s1, s2 = (0.0, 0.0) if starts is None else starts[2 * n : 2 * n + 2]
        out = []
        for v in x:
            y = b0 * v + s1
            s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
            out.append(y)
        x = np.array(out)
    return x


@pytest.mark.parametrize("size", [7, 64, 100, 1 << 16])
@pytest.mark.parametrize("both", [False, True])
def test_chunks_give_the_whole_records_numbers(spark, monkeypatch, size, both):
    got = by_channel(scans.filtered(table(spark), BAND, both, size))
    for c, x in RECORDS.items():
        want = loop(x, BAND)
        if both:
            want = loop(want[::-1], BAND)[::-1]
        assert np.abs(got[c] - want).max() < 1e-9


def test_a_scan_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    t, e = rng.normal(size=(30, 2, 2)) / 2, rng.normal(size=(30, 2))
    steps = spark.createDataFrame([(c, k, t[k].ravel().tolist(), (e[k] * c).tolist()) for c in (1, 2) for k in range(30)], "ch long, k long, t array<double>, e array<double>")
    first = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "ch long, s array<double>")
    for backwards in (False, True):
        got = {(r["ch"], r["k"]): r["s"] for r in scans.scan(steps, first, backwards, fan=7).collect()}
        for c, s in ((1, np.array([1.0, 2.0])), (2, np.zeros(2))):
            for k in range(29, -1, -1) if backwards else range(30):
                assert np.allclose(got[c, k], s)
                s = t[k] @ s + e[k] * c


@pytest.mark.parametrize("size", [50, 1 << 16])
def test_whole_records_have_settled_starts_and_reflected_ends(spark, size):
    got = by_channel(scans.filtered_whole(table(spark), BAND, size))
    assert set(got) == {1, 2, 3}
    settled, level = [], 1.0
    for b0, b1, b2, a1, a2 in BAND:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        settled += [level * (gain - b0), level * (b2 - a2 * gain)]
        level *= gain
    settled = np.array(settled)
    for c in got:
        x, pad = RECORDS[c], 27
        y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
        y = loop(y, BAND, settled * y[0])[::-1]
        y = loop(y, BAND, settled * y[0])[::-1][pad:-pad]
        assert np.abs(got[c] - y).max() < 1e-8
    assert np.abs(got[3]).max() < 1e-9  # a band-pass leaves nothing of a constant


def test_band_pass_design():
    for order, low, high, fs in ((4, 0.3, 35.0, 256.0), (3, 8.0, 25.0, 256.0), (1, 1.0, 2.0, 100.0), (2, 0.001, 40.0, 100.0)):
        sections = dsp.butterworth_bandpass(order, low, high, fs)
        assert len(sections) == order
        gain = lambda f: abs(np.prod([np.polyval(s[:3][::-1], z) / np.polyval((1.0, *s[3:])[::-1], z) for s in sections for z in [np.exp(-2j * np.pi * f / fs)]]))  # noqa: B023, E731
        assert gain(low) == pytest.approx(0.5**0.5, rel=1e-6) and gain(high) == pytest.approx(0.5**0.5, rel=1e-6)
        warped = lambda f: np.tan(np.pi * f / fs)  # noqa: B023, E731
        for f in (low / 3, (low + high) / 2, high * 1.1):  # the analogue prototype's gain at the warped frequency
            u = (warped(f) ** 2 - warped(low) * warped(high)) / (warped(f) * (warped(high) - warped(low)))
            assert gain(f) == pytest.approx((1 + u ** (2 * order)) ** -0.5, rel=1e-6)
        assert all(max(abs(np.roots((1.0, *s[3:])))) < 1 for s in sections)
    with pytest.raises(ValueError):
        dsp.butterworth_bandpass(4, 5.0, 200.0, 256.0)


def test_a_long_record_stays_in_chunks(spark):
    """10^7 samples of one channel: no row holds more than a chunk, and a stretch equals the filter started far enough before it."""
    n = 10_000_000
    made = spark.range(0, n, 1, 16).select(F.lit(1).cast("long").alias("ch"), F.col("id").alias("i"), F.sin(F.col("id") * F.col("id") % 1009).alias("x"))
    rows = scans.filtered_chunks(scans.chunks(made), BAND)
    sizes = rows.agg(F.max(F.size("xs")).alias("most"), F.sum(F.size("xs")).alias("n")).first()
    assert (sizes["most"], sizes["n"]) == (scans.CHUNK, n)
    chunk = np.array(rows.where("chunk = 100").first()["xs"])
    i = np.arange(98 * scans.CHUNK, 101 * scans.CHUNK)
    want = dsp.Cascade(BAND).run(np.sin((i * i % 1009).astype(float)))[0][-scans.CHUNK :]
    assert np.abs(chunk - want).max() < 1e-9
