"""The 10-20 montage and a made-up set of projection weights on it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

# The standard electrodes on a unit circle, x to the right ear and y to the nose; then the mastoids.
PLACES = [
    ("Fp1", -0.31, 0.95), ("Fp2", 0.31, 0.95), ("F7", -0.81, 0.59), ("F3", -0.45, 0.51), ("Fz", 0.0, 0.5), ("F4", 0.45, 0.51), ("F8", 0.81, 0.59),
    ("T3", -1.0, 0.0), ("C3", -0.5, 0.0), ("Cz", 0.0, 0.0), ("C4", 0.5, 0.0), ("T4", 1.0, 0.0),
    ("T5", -0.81, -0.59), ("P3", -0.45, -0.51), ("Pz", 0.0, -0.5), ("P4", 0.45, -0.51), ("T6", 0.81, -0.59), ("O1", -0.31, -0.95), ("O2", 0.31, -0.95),
    ("A1", -1.12, 0.08), ("A2", 1.12, 0.08),
]
SCALP = [p[0] for p in PLACES if p[0] not in ("A1", "A2")]
#: Centre of each generator's patch; weights fall off as a bell around it. No head model is behind them.
PATCHES = {"background": (0.0, 0.0), "alpha": (0.0, -0.9), "theta": (0.0, 0.7), "delta": (0.0, 0.4), "spindle_fast": (0.0, -0.3), "spindle_slow": (0.0, 0.6), "slow_osc": (0.0, 0.6), "kcomplex": (0.0, 0.2), "artifact": (0.0, 1.0)}


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, x, y, i) for i, (c, x, y) in enumerate(PLACES)], "channel string, x double, y double, place int")


def weight(generator: str, channel: str, width: float = 0.6) -> float:
    (cx, cy), (x, y) = PATCHES[generator], next((p[1], p[2]) for p in PLACES if p[0] == channel)
    return math.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * width * width))


def weights(spark: SparkSession) -> DataFrame:
    """(generator, patch, mode, channel, w): one mode a patch, by label and never by position."""
    return spark.createDataFrame([(f"{g}_m0", g, 0, c, weight(g, c)) for g in PATCHES for c, _, _ in PLACES], "generator string, patch string, mode int, channel string, w double")


def anterior(channel: str) -> float:
    """0 at the back, 1 at the front."""
    ys = [p[2] for p in PLACES]
    return (next(p[2] for p in PLACES if p[0] == channel) - min(ys)) / (max(ys) - min(ys))
