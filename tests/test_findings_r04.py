"""What the fourth round's findings showed."""

import math

import numpy as np
from pyspark.sql import functions as F

from tideline.functions import dsp
from tideline.operators import pairs
from tideline.plans import base


def _samples(spark, records: dict, kind: str = "long"):
    return spark.createDataFrame([(c, i, x) for c, xs in records.items() for i, x in enumerate(map(float, xs))], f"ch {kind}, i long, x double")


def test_records_are_sent_to_few_blocks_whatever_the_number_of_channels(spark):
    many = spark.range(20000).select(F.col("id").alias("ch"), F.lit(0).cast("long").alias("i"), F.lit(1.0).alias("x"))
    channels, longest, block = pairs._size(many)
    assert (channels, longest) == (20000, 1) and -(-channels // block) <= 16
    long = spark.createDataFrame([(c, 8191, 1.0) for c in range(5000)], "ch long, i long, x double")
    assert pairs._size(long)[2] == pairs.BLOCK  # but two blocks must fit a task


def test_tiles_of_blocks_are_whole_and_in_order(spark, monkeypatch):
    draw = np.random.default_rng(8)
    records = {f"c{k:02d}": draw.normal(size=16 + 5 * (k % 7)) for k in range(23)}
    records["c05"] = records["c17"].copy()  # a copy: no imaginary part is left between them
    records["c09"] = np.full(30, 2.0)
    monkeypatch.setattr(pairs, "WIDE", 6)
    monkeypatch.setattr(pairs, "BLOCKS", 3)
    monkeypatch.setattr(pairs, "TILE", (2, 3))
    s = _samples(spark, records, "string").cache()
    got = {(r["a"], r["b"]): r for r in pairs.correlations(s).collect()}
    assert len(got) == 23 * 22 // 2 and all(a < b for a, b in got)
    for (a, b), row in got.items():
        n = min(len(records[a]), len(records[b]))
        x, y = records[a][:n], records[b][:n]
        assert row["n"] == n and (math.isnan(row["r"]) if "c09" in (a, b) else abs(row["r"] - np.corrcoef(x, y)[0, 1]) < 1e-9)
    z = {c: np.array([np.fft.rfft((x[i : i + 16] - x[i : i + 16].mean()) * dsp.hann(16)) for i in range(0, len(x) - 15, 8)]) for c, x in records.items()}
    rows = pairs.connectivity(s, 8.0, 16, 1.0, 2.0).collect()
    assert len(rows) == 3 * 23 * 22 // 2
    for row in rows:
        n = min(len(z[row["a"]]), len(z[row["b"]]))
        u, v = z[row["a"]][:n, row["k"]], z[row["b"]][:n, row["k"]]
        im, level = (u * v.conj()).imag, math.sqrt((abs(u) ** 2).sum() * (abs(v) ** 2).sum())
        d = abs(im).sum() ** 2 - (im**2).sum()
        if (row["a"], row["b"]) == ("c05", "c17"):
            assert row["dwpli"] == 0
        elif "c09" not in (row["a"], row["b"]):
            assert abs(row["coherence"] - abs((u * v.conj()).sum()) / level) < 1e-9
            assert abs(row["dwpli"] - (min(1, max(0, (im.sum() ** 2 - (im**2).sum()) / d)) if n > 1 else 0)) < 1e-6


def test_quick_rounding_is_that_of_the_sql(spark):
    rows = [(0.123456,), (-0.123456,), (-0.000004,), (0.000005,), (math.nan,), (None,), (1.0,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "x double").coalesce(1).select(base.near("x", 5).alias("x")).collect()]
    assert got == [0.12346, -0.12346, 0.0, 0.00001, None, None, 1.0] and math.copysign(1, got[2]) == 1
