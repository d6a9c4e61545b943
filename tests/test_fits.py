"""Spectral peak fits against planted spectra; versions of tables and the grid search's restore."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import peaks
from tideline.operators import spectra
from tideline.sources import versions

FREQ = np.arange(0.5, 45.01, 0.25)


def planted(offset, knee, chi, tops=(), noise=0.0, seed=0):
    level = offset - np.log10(knee + FREQ**chi) + peaks.gaussians(FREQ, [(c, h, w / 2) for c, h, w in tops])
    return 10 ** (level + noise * np.random.default_rng(seed).normal(size=len(FREQ)))


@pytest.mark.parametrize("knee", [False, True])
@pytest.mark.parametrize("tops", [(), ((10.0, 0.8, 2.0),), ((6.0, 0.4, 1.5), (10.5, 0.9, 2.5), (21.0, 0.5, 4.0))])
def test_planted_peaks_and_exponents_are_recovered(knee, tops):
    for chi, seed in ((1.0, 1), (1.7, 2), (2.4, 3)):
        k = 25.0 if knee else 0.0
        got = peaks.fit(FREQ[2:], planted(1.5, k, chi, tops, 0.01, seed)[2:], knee, peaks.Limits(height=0.1))
        assert got["exponent"] == pytest.approx(chi, abs=0.12) and got["r2"] > 0.98 and got["error"] < 0.03
        strong = [p for p in got["peaks"] if p[1] > 0.2]
        assert len(strong) == len(tops)
        for (c, h, w), (c0, h0, w0) in zip(strong, tops):
            assert c == pytest.approx(c0, abs=0.15) and h == pytest.approx(h0, abs=0.12) and w == pytest.approx(w0, rel=0.25)
        if knee:
            assert got["knee"] ** (1 / got["exponent"]) == pytest.approx(k ** (1 / chi), rel=0.35)


def test_a_line_is_bent_by_a_peak_and_a_fit_with_peaks_is_not(spark):
    power = planted(1.0, 0.0, 1.5, ((3.0, 1.2, 2.0),), 0.01)
    rows = [(1, float(f), float(p)) for f, p in zip(FREQ, power)] + [(2, float(f), float(p)) for f, p in zip(FREQ, planted(0.0, 0.0, 2.0))] + [(3, 1.0, 1.0), (3, 2.0, 0.0)]
    psd = spark.createDataFrame(rows, "ch long, freq double, power double")
    got = {(r["ch"], r["estimator"]): r["chi"] for r in spectra.exponents(psd, (30.0, 45.0), (2.0, 40.0), (2.0, 8.0), (16.0, 40.0)).collect()}
    assert {e for c, e in got if c == 2} == {"two_bands", "line_narrow", "line_wide", "peaks_narrow", "peaks_wide"} and not [k for k in got if k[0] == 3]
    assert all(got[2, e] == pytest.approx(2.0, abs=1e-6) for c, e in got if c == 2 and e != "two_bands")
    sums = [sum(f**-2.0 for f in FREQ if a <= f <= b) for a, b in ((2.0, 8.0), (16.0, 40.0))]
    assert got[2, "two_bands"] == pytest.approx(np.log10(sums[0] / sums[1]) / np.log10((16 * 40) ** 0.5 / (2 * 8) ** 0.5))
    assert got[1, "peaks_wide"] == pytest.approx(1.5, abs=0.05) and abs(got[1, "line_wide"] - 1.5) > 3 * abs(got[1, "peaks_wide"] - 1.5)
    fits = spectra.peak_fits(psd, 1.0, 45.0).where("ch = 1").first()
    assert [round(p["centre"]) for p in fits["peaks"] if p["height"] > 0.3] == [3]


def test_spectra_that_cannot_be_fitted():
    for f, p in (([], []), ([1.0, 2.0], [1.0, 1.0]), (FREQ, np.zeros(len(FREQ))), (FREQ, np.full(len(FREQ), np.nan)), (np.ones(9), np.ones(9))):
        got = peaks.fit(f, p)
        assert np.isnan(got["exponent"]) and got["peaks"] == []
    flat = peaks.fit(FREQ, np.ones(len(FREQ)))
    assert flat["exponent"] == pytest.approx(0, abs=1e-9) and flat["peaks"] == []


def test_grid_search_restores_on_failure(spark, tmp_path):
    path = f"file://{tmp_path}/fits"
    keys = spark.createDataFrame([("a", 3.0), ("b", 7.0)], "key string, target double")
    grid = [{"x": x, "y": y} for x in (1.0, 3.0, 7.0) for y in (0.0, 1.0)]
    error = lambda df: df.withColumn("error", F.when(F.col("x") != 1.0, F.abs(F.col("x") - F.col("target")) + F.col("y")))
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    got = versions.grid_search(keys, grid, error, path)
    assert {r["key"]: (r["point"], r["x"], r["y"], r["error"]) for r in got.collect()} == {"a": (2, 3.0, 0.0, 0.0), "b": (4, 7.0, 0.0, 0.0)}
    first = versions.version(spark, path)

    def broken(df):
        fail = F.udf(lambda x: 1 / (x - 7.0), "double")
        return df.withColumn("error", fail("x"))

    with pytest.raises(Exception):
        versions.grid_search(keys, grid, broken, path)
    with pytest.raises(ValueError, match="finite"):
        versions.grid_search(keys, grid, lambda df: df.withColumn("error", F.when(F.col("key") == "a", 1.0)), path)
    assert versions.version(spark, path) == first and versions.current(spark, path).count() == 2
    again = versions.grid_search(keys.limit(1), grid, error, path)
    assert again.count() == 1 and versions.version(spark, path) != first
