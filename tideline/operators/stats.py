"""Aggregates and tests: circular and harmonic statistics, quartiles, robust measures, matching scores, exact sign tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.expressions import exclusive_quantile
from tideline.sources.written import written


def moments(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean, population deviation and coefficient of variation: null when empty, under two values, or at mean 0."""
    sd = F.when(F.count(x) >= 2, F.stddev_pop(x))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), sd.alias("sd"), F.when((F.avg(x) != 0) & (F.count(x) >= 2), F.stddev_pop(x) / F.avg(x)).alias("cv"), F.count(x).alias("n"))


def circular(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """n, mean direction and resultant length."""
    c, s = F.sum(F.cos(angle)), F.sum(F.sin(angle))
    return df.groupBy(*keys).agg(F.count(angle).alias("n"), F.atan2(s, c).alias("direction"), (F.hypot(s, c) / F.count(angle)).alias("resultant"))


def pooled_circular(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of (n, direction, resultant) as one, weighted by n."""
    w = F.col("n") * F.col("resultant")
    c, s = F.sum(w * F.cos("direction")), F.sum(w * F.sin("direction"))
    return groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.atan2(s, c).alias("direction"), (F.hypot(s, c) / F.sum("n")).alias("resultant"))


def harmonic(df: DataFrame, keys: list[str], phase: str, y: str) -> DataFrame:
    """Least squares of centred y on cosine and sine, which aren't centred: amplitude and r2; null under three rows or when singular.

    One aggregate of plain sums, so partial sums are combined before the shuffle.
    """
    c, s, v = F.cos(phase), F.sin(phase), F.col(y)
    sums = df.groupBy(*keys).agg(F.count(y).alias("n"), F.sum(v).alias("y"), F.sum(v * v).alias("yy"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(c * v).alias("cv"), F.sum(s * v).alias("sv"))
    m = F.col("y") / F.col("n")
    cy, sy, sst = F.col("cv") - m * F.col("c"), F.col("sv") - m * F.col("s"), F.col("yy") - m * F.col("y")
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    solved = sums.withColumns({"_bc": (cy * F.col("ss") - sy * F.col("cs")) / det, "_bs": (sy * F.col("cc") - cy * F.col("cs")) / det, "_sst": sst, "_cy": cy, "_sy": sy, "_ok": (F.col("n") >= 3) & (F.abs(det) > 1e-12)})
    explained = 2 * (F.col("_bc") * F.col("_cy") + F.col("_bs") * F.col("_sy")) - (F.col("_bc") * F.col("_bc") * F.col("cc") + 2 * F.col("_bc") * F.col("_bs") * F.col("cs") + F.col("_bs") * F.col("_bs") * F.col("ss"))
    return solved.select(*keys, "n", F.when(F.col("_ok"), F.hypot("_bc", "_bs")).alias("amplitude"), F.when(F.col("_ok") & (F.col("_sst") > 0), explained / F.col("_sst")).alias("r2"))


def harmonic3(df: DataFrame, keys: list[str], phase: str, y: str) -> DataFrame:
    """Least squares of y on intercept, cosine and sine, by Cramer's rule on centred sums."""
    c, s = F.cos(phase), F.sin(phase)
    g = df.groupBy(*keys).agg(F.count(y).alias("n"), F.var_pop(c).alias("cc"), F.var_pop(s).alias("ss"), F.covar_pop(c, s).alias("cs"), F.covar_pop(c, F.col(y)).alias("cy"), F.covar_pop(s, F.col(y)).alias("sy"), F.avg(y).alias("m"), F.avg(c).alias("mc"), F.avg(s).alias("ms"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    bc, bs = (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det, (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det
    return g.where("n >= 4").select(*keys, (F.col("m") - bc * F.col("mc") - bs * F.col("ms")).alias("intercept"), bc.alias("cosine"), bs.alias("sine"))


def interval_variability(df: DataFrame, keys: list[str], rr: str, previous: str) -> DataFrame:
    """SDNN and RMSSD in ms, and mean rate a minute, of intervals in seconds."""
    d = F.col(rr) - F.col(previous)
    return df.groupBy(*keys).agg((F.stddev_pop(rr) * 1000).alias("sdnn"), (F.sqrt(F.avg(d * d)) * 1000).alias("rmssd"), (60 / F.avg(rr)).alias("rate"))


def quartiles(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Inclusive (linear) and exclusive quartiles of the finite values, the exclusive ones NaN under four values.

    The exclusive ones need the ordered values of a group in one row; groups are seeds or epochs, not records.
    """
    kept = df.where(F.col(x).isNotNull() & ~F.isnan(x))
    got = kept.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"), F.sort_array(F.collect_list(x)).alias("_v"))
    return got.select(*keys, F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3"), exclusive_quantile(F.col("_v"), 0.25).alias("x1"), exclusive_quantile(F.col("_v"), 0.75).alias("x3"))


def robust(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median, 1.4826 times the median absolute deviation, and their ratio."""
    mid = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("_m"))
    far = df.join(mid, keys).groupBy(*keys).agg(F.first("_m").alias("median"), (1.4826 * F.percentile(F.abs(F.col(x) - F.col("_m")), 0.5)).alias("spread"))
    return far.withColumn("cv", F.when(F.col("median") != 0, F.col("spread") / F.col("median")))


def scores(df: DataFrame, keys: list[str], truth: Column, found: Column) -> DataFrame:
    """Precision, recall and F1 of two flags: 0 where nothing is to divide by; F1 NaN without any true case."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = df.groupBy(*keys).agg(n(truth & found).alias("tp"), n(found & ~truth).alias("fp"), n(truth & ~found).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("tp") + F.col("fn") == 0, float("nan")).otherwise(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return got.select(*keys, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def binomial_upper(k: Column, n: Column) -> Column:
    """P(X >= k) of a fair binomial, by its exact terms; 1 for n <= 0. Counts to 62 stay exact."""
    term = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(1.0), lambda a, j: F.when(i >= 1, a * (n - j + 1) / j).otherwise(1.0))
    total = F.aggregate(F.transform(F.sequence(F.least(k, n), n), term), F.lit(0.0), lambda a, t: a + t)
    return F.when(n <= 0, 1.0).when(k > n, 0.0).otherwise(total / F.pow(F.lit(2.0), n))


def sign_test(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Paired values: ties dropped, the one-sided odds of so many a > b, and twice the smaller tail, at most 1."""
    got = df.groupBy(*keys).agg(F.sum(F.when(F.col(a) > F.col(b), 1).otherwise(0)).cast("int").alias("k"), F.sum(F.when(F.col(a) != F.col(b), 1).otherwise(0)).cast("int").alias("n"))
    upper, lower = binomial_upper(F.col("k"), F.col("n")), binomial_upper(F.col("n") - F.col("k"), F.col("n"))
    return got.select(*keys, "k", "n", upper.alias("p_upper"), F.least(F.lit(1.0), 2 * F.least(upper, lower)).alias("p_two_sided"))


def excess(observed: Column, baseline: Column) -> Column:
    """sqrt(max(o^2 - b^2, 0))"""
    return F.sqrt(F.greatest(F.lit(0.0), observed * observed - baseline * baseline))


def summary(df: DataFrame, keys: list[str], cohort: str, cohorts: tuple[str, str], x: str) -> DataFrame:
    """Medians of two cohorts side by side and their ratio."""
    wide = df.groupBy(*keys).agg(*[F.percentile(F.when(F.col(cohort) == c, F.col(x)), 0.5).alias(c) for c in cohorts])
    return wide.withColumn("ratio", F.when(F.col(cohorts[1]) != 0, F.col(cohorts[0]) / F.col(cohorts[1])))


def verdicts(values: DataFrame, reference: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """HOLD where a value lies within the reference's quartiles, MOVE outside, INSUFFICIENT with fewer than `least` subjects."""
    iqr = reference.groupBy(*keys).agg(F.percentile("x", 0.25).alias("_lo"), F.percentile("x", 0.75).alias("_hi"), F.count("x").alias("_n"))
    verdict = F.when(F.col("_n") < least, "INSUFFICIENT").when(F.col("value").between(F.col("_lo"), F.col("_hi")), "HOLD").otherwise("MOVE")
    return values.join(iqr, keys).select(*keys, "value", verdict.alias("verdict"))


def mean_relative_error(df: DataFrame, keys: list[str], got: str, want: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(got) - F.col(want)) / F.abs(F.col(want))).alias("error"))


def analytic_slope(chi: Column, knee: Column, lo: float, hi: float, points: int = 400) -> Column:
    """Slope of log10(1 / (knee + f^chi)) on log10 f over log-spaced points, as a positive exponent."""
    a, b = math.log10(lo), math.log10(hi)
    xs = [a + (b - a) * i / (points - 1) for i in range(points)]
    mean = sum(xs) / points
    sxx = sum((x - mean) ** 2 for x in xs)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(a) + F.lit((b - a) / (points - 1)) * i)
    return F.aggregate(F.transform(grid, lambda x: (x - mean) * F.log10(knee + F.pow(F.lit(10.0), x * chi))), F.lit(0.0), lambda s, t: s + t) / F.lit(sxx)


def medians(values: DataFrame, buckets: int = 1024, passes: int = 3) -> DataFrame:
    """(key, n, median) of values (key, x), exactly, for groups of any size; an even number's is the mean of the middle two.

    Each pass counts a key's values in buckets between its bounds and narrows these to the buckets that hold the middle, so no
    task gets a key's values, but counts of buckets; what is left is counted by value. Values that are null or not finite
    take no part.
    """
    x = F.col("x").cast("double")
    good = values.select("key", x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    span = good.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("skip", F.lit(0).cast("bigint"))
    middle = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]
    for _ in range(passes):
        span = written(span)
        inside = good.join(span, "key").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets))).otherwise(0)
        counts = inside.withColumn("b", bucket).groupBy("key", "n", "skip", "b").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.col("skip") + F.sum("c").over(Window.partitionBy("key").orderBy("b")) - F.col("c")
        chosen = counts.withColumn("before", before).where((F.col("before") <= middle[1]) & (F.col("before") + F.col("c") > middle[0]))
        span = chosen.groupBy("key", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("skip"))
    span = written(span)
    left = good.join(span, "key").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))).groupBy("key", "n", "skip", "x").agg(F.count("*").alias("c"))
    upto = left.withColumn("upto", F.col("skip") + F.sum("c").over(Window.partitionBy("key").orderBy("x")))
    at = [F.min(F.when(F.col("upto") > m, F.col("x"))) for m in middle]
    return upto.groupBy("key", "n").agg(((at[0] + at[1]) / 2).alias("median"))
