"""Window-style operators: running measures, islands, extrema, bursts, decimation and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by():
    """A record's samples in order."""
    return Window.partitionBy("ch").orderBy("i")


def running_rms(samples: DataFrame, half: int) -> DataFrame:
    """RMS over i - half .. i + half, truncated at the ends."""
    return samples.withColumn("rms", F.sqrt(F.avg(F.col("x") * F.col("x")).over(by().rowsBetween(-half, half))))


def centred_mean(samples: DataFrame, half: int) -> DataFrame:
    return samples.withColumn("m", F.avg("x").over(by().rowsBetween(-half, half)))


def lag_difference(samples: DataFrame) -> DataFrame:
    return samples.withColumn("d", F.col("x") - F.lag("x").over(by()))


def lag_correlation(samples: DataFrame) -> DataFrame:
    """Correlation of each channel with itself one sample on; null under three samples."""
    pairs = samples.withColumn("p", F.lag("x").over(by()))
    got = pairs.groupBy("ch").agg(F.count("*").alias("n"), F.corr("x", "p").alias("r"))
    return got.select("ch", "n", F.when(F.col("n") >= 3, F.col("r")).alias("r"))


def islands(samples: DataFrame, state: Column) -> DataFrame:
    """(ch, island, state, first, n, peak, total): maximal runs of samples with equal state; the last run is included."""
    marked = samples.withColumn("state", state)
    edge = F.when(F.col("state") == F.lag("state").over(by()), 0).otherwise(1)
    numbered = marked.withColumn("_edge", edge).withColumn("island", F.sum("_edge").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ch", "island", "state").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.max(F.abs("x")).alias("peak"), F.sum("x").alias("total"))


def half_wave_occupancy(samples: DataFrame, amplitude: float, least: int = 2) -> DataFrame:
    """Share of samples in half waves between sign changes (0 counts as positive) of at least `least` samples whose
    doubled peak reaches the amplitude."""
    waves = islands(samples, F.col("x") < 0)
    counted = F.when((F.col("n") >= least) & (2 * F.col("peak") >= amplitude), F.col("n")).otherwise(0)
    return waves.groupBy("ch").agg(F.sum(counted).alias("counted"), F.sum("n").alias("n"), (F.sum(counted) / F.sum("n")).alias("occupancy"))


def detrended(samples: DataFrame) -> DataFrame:
    """x minus the channel's mean."""
    mean = samples.groupBy("ch").agg(F.avg("x").alias("_m"))
    return samples.join(mean, "ch").withColumn("x", F.col("x") - F.col("_m")).drop("_m")


def binarized(samples: DataFrame) -> DataFrame:
    """1 where x lies above the channel's median (of an even number: the mean of the middle two)."""
    middle = samples.groupBy("ch").agg(F.percentile("x", 0.5).alias("_m"))
    return samples.join(middle, "ch").withColumn("s", F.when(F.col("x") > F.col("_m"), 1).otherwise(0)).drop("_m")


def extrema(samples: DataFrame) -> DataFrame:
    """Peaks and troughs: strict to the left, loose to the right; the ends are none."""
    before, after = F.lag("x").over(by()), F.lead("x").over(by())
    kind = F.when((F.col("x") > before) & (F.col("x") >= after), "peak").when((F.col("x") < before) & (F.col("x") <= after), "trough")
    return samples.withColumn("kind", kind).where("kind is not null")


def bursts(samples: DataFrame, p: float) -> DataFrame:
    """Runs above a channel's percentile: how many, their mean length, and the mean gap between them."""
    level = samples.groupBy("ch").agg(F.percentile("x", p).alias("_level"))
    runs = islands(samples.join(level, "ch"), F.col("x") > F.col("_level"))
    last = runs.withColumn("_inner", (F.col("island") > 1) & (F.col("island") < F.max("island").over(Window.partitionBy("ch"))))
    return last.groupBy("ch").agg(F.sum(F.when(F.col("state"), 1).otherwise(0)).alias("bursts"), F.avg(F.when(F.col("state"), F.col("n"))).alias("length"), F.avg(F.when(~F.col("state") & F.col("_inner"), F.col("n"))).alias("gap"))


def upward_periods(samples: DataFrame, fs: float) -> DataFrame:
    """Times between upward zero crossings, each placed by linear interpolation."""
    p = F.lag("x").over(by())
    crossing = samples.withColumn("_p", p).where("_p < 0 and x >= 0").withColumn("t", (F.col("i") - 1 + F.col("_p") / (F.col("_p") - F.col("x"))) / fs)
    return crossing.withColumn("period", F.col("t") - F.lag("t").over(by())).where("period is not null").select("ch", "i", "t", "period")


def decimated_extremes(samples: DataFrame, pixels: int) -> DataFrame:
    """Smallest and largest finite x of each pixel's samples; blank pixels are missing. Records under two samples a pixel stay raw."""
    sized = samples.join(samples.groupBy("ch").agg(F.count("*").alias("_n")), "ch")
    pixel = F.when(F.col("_n") < 2 * pixels, F.col("i")).otherwise(F.floor(F.col("i") * pixels / F.col("_n")))
    kept = sized.withColumn("pixel", pixel.cast("bigint")).where(~F.isnan("x") & F.col("x").isNotNull())
    return kept.groupBy("ch", "pixel").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))


def median_filtered(samples: DataFrame, half: int) -> DataFrame:
    """Running median of 2 half + 1 samples; near the ends, the values themselves."""
    n = F.count("*").over(by().rowsBetween(-half, half))
    middle = F.percentile("x", 0.5).over(by().rowsBetween(-half, half))
    return samples.withColumn("m", F.when(n == 2 * half + 1, middle).otherwise(F.col("x")))


def rr_quality(samples: DataFrame, lo: float, hi: float, within: float, half: int = 5) -> DataFrame:
    """Intervals in [lo, hi] and within a share of their running median."""
    smooth = median_filtered(samples, half)
    return smooth.withColumn("good", F.col("x").between(lo, hi) & (F.abs(F.col("x") - F.col("m")) <= within * F.col("m")))


def flattened(samples: DataFrame, half: int, alpha: float, floor: float = 0.1) -> DataFrame:
    """x over its running RMS to the power alpha, the RMS held above a share of its mean."""
    run = running_rms(samples, half)
    mean = run.groupBy("ch").agg(F.avg("rms").alias("_mean"))
    level = F.greatest(F.col("rms"), floor * F.col("_mean"))
    return run.join(mean, "ch").withColumn("y", F.when(level > 0, F.col("x") / F.pow(level, F.lit(alpha))).otherwise(F.col("x"))).select("ch", "i", "y")


def fluctuation_slope(samples: DataFrame, boxes: list[int]) -> DataFrame:
    """First-order detrended fluctuation analysis: slope of log F(box) on log box over whole boxes of the cumulative sum."""
    profile = detrended(samples).withColumn("y", F.sum("x").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    each = profile.withColumn("size", F.explode(F.array(*[F.lit(b) for b in boxes]))).withColumn("box", F.floor(F.col("i") / F.col("size")))
    fits = each.groupBy("ch", "size", "box").agg(F.count("*").alias("n"), F.regr_syy("y", "i").alias("syy"), F.regr_sxy("y", "i").alias("sxy"), F.regr_sxx("y", "i").alias("sxx"))
    left = fits.where("n = size").withColumn("ss", F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")))
    scale = left.groupBy("ch", "size").agg(F.sqrt(F.sum("ss") / F.sum("n")).alias("f")).where("f > 0")
    return scale.groupBy("ch").agg(F.regr_slope(F.log("f"), F.log("size")).alias("slope"), F.count("*").alias("scales")).where("scales >= 3")


def epochs(samples: DataFrame, size: int) -> DataFrame:
    return samples.withColumn("epoch", F.floor(F.col("i") / size).cast("bigint"))


def frames(samples: DataFrame, size: int, hop: int, last_excluded: bool = False) -> DataFrame:
    """Overlapping frames (ch, frame, k, x): every whole window of `size` samples at multiples of `hop`.

    Each sample is sent to the frames that hold it, size / hop at most; with `last_excluded` the last whole window is left
    out, as the sliding-exponent readout counts them.
    """
    length = samples.groupBy("ch").agg(F.count("*").alias("_n"))
    last = F.floor((F.col("_n") - size) / hop) - (1 if last_excluded else 0)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / hop))
    hi = F.least(last, F.floor(F.col("i") / hop))
    held = samples.join(length, "ch").where(F.col("_n") >= size).withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")}).where("_lo <= _hi")
    each = held.withColumn("frame", F.explode(F.sequence("_lo", "_hi")))
    return each.select("ch", "frame", (F.col("i") - F.col("frame") * hop).alias("k"), "x")
