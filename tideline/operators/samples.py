"""Sample-wise operators over long tables (record, channel, i, x): referencing, projection, gain and decimation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REFERENCES = ("A1", "A2")


def indexed(df: DataFrame, channel: str, order: list[str], value: str) -> DataFrame:
    """Rows of a table as samples (ch, i, x), i counting from 0 within each channel."""
    w = Window.partitionBy(channel).orderBy(*order)
    return df.select(F.col(channel).alias("ch"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.col(value).cast("double").alias("x"))


def projected(sources: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over generators of weight times source, for each channel and sample.

    Zero weights are pruned before the join; the montage's weights are a table of fixed size (generators times channels).
    """
    met = sources.join(F.broadcast(weights.where("w <> 0")), "generator")
    return met.groupBy(*keys, "channel").agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def modes(weights: DataFrame, patch: str) -> DataFrame:
    """A patch's modes in order; none is an error when collected by the caller."""
    return weights.where(F.col("patch") == patch).select("generator", "mode").distinct().orderBy("mode")


def patch_loading(weights: DataFrame) -> DataFrame:
    """sqrt of the summed squared weights of a patch's modes at each channel, scaled to a largest value of one."""
    power = weights.groupBy("patch", "channel").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("loading"))
    return power.withColumn("loading", F.col("loading") / F.max("loading").over(Window.partitionBy("patch")))


def first_largest(df: DataFrame, group: list[str], value: Column, order: Column) -> DataFrame:
    """The row of each group with the strictly largest value, the first in order among equal ones."""
    w = Window.partitionBy(*group).orderBy(value.desc(), order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def rereferenced(samples: DataFrame, mode: str, keys: list[str], neighbours: DataFrame | None = None) -> DataFrame:
    """Scalp channels against a reference: as-generated, linked-mastoid, contralateral, average or laplacian.

    One aggregate over the channels of each sample gives every reference at once; a missing mastoid leaves x null. The
    Laplacian takes the mean of the channels that `neighbours` (channel, neighbour) lists.
    """
    scalp = samples.where(~F.col("channel").isin(*REFERENCES))
    if mode == "as-generated":
        return scalp
    at = Window.partitionBy(*keys)
    a1, a2 = (F.max(F.when(F.col("channel") == r, F.col("x"))).over(at) for r in REFERENCES)
    if mode == "linked-mastoid":
        ref = (a1 + a2) * 0.5
    elif mode == "contralateral":
        ref = F.when(F.col("channel").rlike("(?i)z$"), (a1 + a2) * 0.5).when(F.col("channel").rlike("[13579]$"), a2).otherwise(a1)
    elif mode == "average":
        ref = F.avg(F.when(~F.col("channel").isin(*REFERENCES), F.col("x"))).over(at)
    elif mode == "laplacian":
        if neighbours is None:
            raise ValueError("the Laplacian needs the neighbours of each channel")
        # A montage's channels become columns in one aggregate, from which every neighbour is read: one shuffle, no join and no list.
        listed = neighbours.select("channel", "neighbour").distinct().limit(4097).collect()
        if len(listed) > 4096:
            raise ValueError("neighbours are those of a montage")
        near: dict[str, list[str]] = {}
        for c, other in sorted(map(tuple, listed)):
            near.setdefault(c, []).append(other)
        names = sorted(set(near) | {o for os in near.values() for o in os})
        at = {c: n for n, c in enumerate(names)}
        own = lambda f, c, value: f(F.when(F.col("channel") == c, value))
        parts = [(F.max, "x", F.col("x")), (F.max, "on", F.lit(1)), (F.sum, "s", F.col("x")), (F.count, "n", F.col("x"))]
        whole = scalp.groupBy(*keys).agg(*[own(f, c, value).alias(f"_{name}{n}") for f, name, value in parts for c, n in at.items()])

        def less_mean(c: str) -> Column:
            total = sum((F.coalesce(f"_s{at[o]}", F.lit(0.0)) for o in near[c]), F.lit(0.0))
            count = sum((F.col(f"_n{at[o]}") for o in near[c]), F.lit(0))
            return F.when(F.col(f"_on{at[c]}").isNotNull() & (count > 0), F.struct(F.lit(c).alias("channel"), (F.col(f"_x{at[c]}") - total / count).alias("x")))

        # Of repeated samples of a channel itself the largest counts, so that a repeated task finds the same; of its neighbours all do.
        rows = F.explode(F.array_compact(F.array(*[less_mean(c) for c in near]))).alias("_r")
        return whole.select(*keys, rows).select(*keys, "_r.*")
    else:
        raise ValueError(f"no such reference: {mode}")
    return samples.withColumn("_ref", ref).where(~F.col("channel").isin(*REFERENCES)).withColumn("x", F.col("x") - F.col("_ref")).drop("_ref")


def nearest(montage: DataFrame, k: int = 4) -> DataFrame:
    """(channel, neighbour): the k nearest channels by place, ties in montage order. A montage has a fixed, small size."""
    a = montage.select("channel", "x", "y")
    b = montage.select(F.col("channel").alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("place"))
    pairs = a.join(F.broadcast(b), F.col("channel") != F.col("neighbour"))
    far = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    w = Window.partitionBy("channel").orderBy(far, "place")
    return pairs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).select("channel", "neighbour")


def decimated(samples: DataFrame, stride: int) -> DataFrame:
    return samples.where(F.col("i") % stride == 0)


def block_means(samples: DataFrame, size: int) -> DataFrame:
    """Means of consecutive whole blocks."""
    blocks = samples.groupBy("ch", F.floor(F.col("i") / size).alias("block")).agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return blocks.where(F.col("n") == size).drop("n")


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def rms_matched(samples: DataFrame, target: float, first: int | None = None) -> DataFrame:
    """Samples scaled so that each channel's RMS, over all or its first samples, is the target; silence stays."""
    x = F.col("x") if first is None else F.when(F.col("i") < first, F.col("x"))
    level = samples.groupBy("ch").agg(rms(x).alias("_rms"))
    return samples.join(level, "ch").withColumn("x", F.when(F.col("_rms") > 0, F.col("x") * target / F.col("_rms")).otherwise(F.col("x"))).drop("_rms")


def lag_coupled(samples: DataFrame, source: int, target: int, lag: int, strength: float) -> DataFrame:
    """The target channel as c times the source `lag` samples before plus sqrt(1 - c^2) times its own; the rest as it was."""
    own = samples.where(F.col("ch") == target)
    late = samples.where(F.col("ch") == source).select((F.col("i") + lag).alias("i"), F.col("x").alias("_s"))
    mixed = own.join(late, "i", "left").select("ch", "i", (strength * F.coalesce("_s", F.lit(0.0)) + (1 - strength * strength) ** 0.5 * F.col("x")).alias("x"))
    return samples.where(F.col("ch") != target).unionByName(mixed)


def windowed(samples: DataFrame, end: int, size: int) -> DataFrame:
    """The last `size` samples before `end` of each channel, places before the record's start being NaN."""
    places = samples.select("ch").distinct().withColumn("i", F.explode(F.sequence(F.lit(end - size).cast("bigint"), F.lit(end - 1).cast("bigint"))))
    inside = samples.where(F.col("i").between(end - size, end - 1))
    return places.join(inside, ["ch", "i"], "left").withColumn("x", F.coalesce("x", F.lit(float("nan"))))
