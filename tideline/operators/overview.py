"""Overviews of whole recordings: two filtered arms, decimated, as a pyramid of smallest and largest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import dsp
from tideline.operators import scans
from tideline.operators.samples import decimated
from tideline.sources.written import written


def arms(samples: DataFrame, fs: float, antialias: float, highpass: float, order: int = 4, size: int = scans.CHUNK) -> DataFrame:
    """(arm, ch, i, x): every channel low-passed against aliases ('raw'), and also high-passed ('high'), without a shift of phase.

    Each section runs forth and back over time chunks, whatever a record's length.
    """
    cut, out = written(scans.chunks(samples, size)), None  # both arms read it
    for name, low in (("raw", None), ("high", highpass)):
        rows = scans.filtered_in_turn(cut, dsp.sections(fs, low, antialias, order), both_ways=True)
        arm = scans.unchunked(rows, size).select(F.lit(name).alias("arm"), "ch", "i", "x")
        out = arm if out is None else out.unionByName(arm)
    return out


def stride_of(fs: float, rate: float) -> int:
    """Samples from one of the overview to the next; the rate must divide the sampling rate."""
    stride = round(fs / rate)
    if stride < 1 or abs(stride * rate - fs) > 1e-9 * fs:
        raise ValueError("the overview's rate must divide the sampling rate")
    return stride


def pyramid(samples: DataFrame, stride: int, levels: int = 4, fan: int = 4, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """(keys, level, k, lo, hi, n): every `stride`th sample, and above it levels whose points span `fan` points of the level below.

    A level is built from the one below by partial aggregates. The lowest is written, so the samples are read once for it, however many levels and views read it.
    """
    points = written(decimated(samples, stride).select(*keys, F.floor(F.col("i") / stride).alias("k"), "x"))
    level = points.select(*keys, "k", F.col("x").alias("lo"), F.col("x").alias("hi"), F.lit(1).cast("bigint").alias("n"))
    out = level.withColumn("level", F.lit(0))
    for n in range(1, levels):
        level = level.groupBy(*keys, F.floor(F.col("k") / fan).alias("k")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select(*keys, "level", "k", "lo", "hi", "n")


def level_for(seconds: float, rate: float, pixels: int, fan: int = 4, levels: int = 4) -> int:
    """The highest level that still has a point a pixel over so many seconds."""
    return max(n for n in range(levels) if n == 0 or seconds * rate / fan**n >= pixels)


def view(built: DataFrame, rate: float, begin: float, seconds: float, pixels: int, fan: int = 4, levels: int = 4, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """(keys, pixel, lo, hi): smallest and largest value under each of `pixels` over a span, read from one level of the pyramid.

    A point belongs to the pixel in which it begins; pixels without a point have no row.
    """
    n = level_for(seconds, rate, pixels, fan, levels)
    t: Column = F.col("k") * float(fan**n) / rate
    pixel = F.floor((t - begin) / seconds * pixels).cast("int")
    seen = built.where((F.col("level") == n) & (t >= begin) & (t < begin + seconds))
    return seen.groupBy(*keys, pixel.alias("pixel")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
