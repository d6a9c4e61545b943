"""Joins in time: overlap, as-of, sample-at-time, nearest, greedy matching, paired arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlapping(events: DataFrame, spans: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """Events (onset, duration) and spans (lo, hi) that overlap: onset < hi and onset + duration > lo.

    Both sides are filed under the bins of `width` that they touch and meet by equality, so the join is a hash or
    merge join, not a comparison of all with all; a pair is reported in its first common bin only.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("bigint"), F.greatest(F.floor(a / width), F.floor(b / width)).cast("bigint")))
    left = events.withColumn("_bin", bins(F.col("onset"), F.col("onset") + F.col("duration")))
    right = spans.withColumn("_bin", bins(F.col("lo"), F.col("hi")))
    first = F.greatest(F.floor(F.col("onset") / width), F.floor(F.col("lo") / width)).cast("bigint")
    return left.join(right, [*keys, "_bin"]).where((F.col("onset") < F.col("hi")) & (F.col("onset") + F.col("duration") > F.col("lo")) & (F.col("_bin") == first)).drop("_bin")


def as_of(rows: DataFrame, steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's latest step (t, value) with step t <= row t. One sort of both sides together, no range join."""
    both = rows.withColumns({"_row": F.lit(1), value: F.lit(None).cast(steps.schema[value].dataType)}).unionByName(steps.select(*keys, "t", value).withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_row = 1").drop("_row")


def valid_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose step function is no function of all t >= 0: its first segment begins after 0."""
    return steps.groupBy(*keys).agg(F.min("t").alias("first")).where("first > 0")


def sample_at(times: DataFrame, samples: DataFrame, fs: float, n: Column) -> DataFrame:
    """The sample at index clip(floor(t fs + 0.5), 0, n - 1)."""
    i = F.greatest(F.lit(0), F.least(n - 1, F.floor(F.col("t") * fs + 0.5))).cast("bigint")
    return times.withColumn("i", i).join(samples, ["ch", "i"])


def nearest_event(events: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """The event nearest to each time: the last before and the first after are found by a running sort either way, so each frame only grows; ties go to the earlier onset."""
    both = at.select(*keys, "t", F.lit(1).alias("_row"), F.lit(None).cast("bigint").alias("event")).unionByName(events.select(*keys, F.col("onset").alias("t"), F.lit(0).alias("_row"), F.col("event").cast("bigint").alias("event")))
    mark = F.when(F.col("_row") == 0, F.struct("t", "event"))
    w = Window.partitionBy(*keys).orderBy("t", "_row")
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumns({"_b": before, "_a": after}).where("_row = 1")
    take = F.when(F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("t") - F.col("_b.t") <= F.col("_a.t") - F.col("t"))), F.col("_b")).otherwise(F.col("_a"))
    return got.select(*keys, "t", take["event"].alias("event"), F.abs(take["t"] - F.col("t")).alias("distance"))


def nearest_angle(asked: DataFrame, candidates: DataFrame, keys: list[str], bins: int = 4096) -> DataFrame:
    """For each row (id, angle), the candidate of its key with the smallest circular distance, the first id among equal ones.

    The turn is cut into bins. In a bin both sides are sorted together by angle, once either way, and each row finds the last candidate before it
    and the first after; where its bin has none, the nearest bins' last or first one stands in, round the turn's end too. A bin sends one row for that.
    """
    turn = lambda c: F.pmod(F.col(c), F.lit(6.283185307179586))
    place = F.floor(F.col("_t") / F.lit(6.283185307179586) * bins)
    found = candidates.groupBy(*keys, turn("candidate_angle").alias("_t")).agg(F.min(F.struct("candidate", "candidate_angle")).alias("_c"))
    ends = found.groupBy(*keys, place.alias("_bin")).agg(F.min_by("_c", "_t").alias("_first"), F.max_by("_c", "_t").alias("_last"))
    # One row a key and bin that a row asks from or a candidate lies in: the last candidate of the bins before and the first of those behind.
    w = Window.partitionBy(*keys).orderBy("_bin")
    down = Window.partitionBy(*keys).orderBy(F.desc("_bin"))
    before = lambda o: o.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda o: o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = asked.withColumn("_t", turn("angle")).select(*keys, place.alias("_bin")).distinct().join(ends, [*keys, "_bin"], "full_outer")
    carried = known.select(
        *keys,
        "_bin",
        F.coalesce(F.last("_last", ignorenulls=True).over(before(w)), F.last("_last", ignorenulls=True).over(whole(w))).alias("_before"),
        F.coalesce(F.last("_first", ignorenulls=True).over(before(down)), F.first("_first", ignorenulls=True).over(whole(w))).alias("_behind"),
    ).where("_before is not null")
    none = F.lit(None).cast(found.schema["_c"].dataType)
    both = asked.withColumns({"_t": turn("angle"), "_c": none, "_row": F.lit(1)}).unionByName(found.withColumn("_row", F.lit(0)), allowMissingColumns=True).withColumn("_bin", place)
    up = Window.partitionBy(*keys, "_bin").orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_t"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"_b": F.last("_c", ignorenulls=True).over(up), "_a": F.last("_c", ignorenulls=True).over(back)}).where("_row = 1").join(carried, [*keys, "_bin"])
    d = lambda c: F.abs(F.atan2(F.sin(F.col("angle") - c["candidate_angle"]), F.cos(F.col("angle") - c["candidate_angle"])))
    option = lambda c: F.struct(d(c).alias("distance"), c["candidate"].alias("candidate"), c["candidate_angle"].alias("candidate_angle"))
    best = F.least(option(F.coalesce("_b", "_before")), option(F.coalesce("_a", "_behind")))
    return near.withColumn("_best", best).drop("_t", "_c", "_row", "_b", "_a", "_bin", "_before", "_behind").select("*", "_best.*").drop("_best")


def greedy_match(truth: DataFrame, found: DataFrame, width: float, share: float = 0.2) -> DataFrame:
    """(rec, truth_id, found_id): each true event in order of onset takes the unused detection that overlaps it most, if by
    more than a share of its duration; ties to the earlier detection. Candidates come by an overlap join; one record's are matched together."""
    spans = found.select("rec", F.col("onset").alias("lo"), (F.col("onset") + F.col("duration")).alias("hi"), F.col("id").alias("found_id"))
    pairs = overlapping(truth.withColumnRenamed("id", "truth_id"), spans, width, ["rec"])
    over = F.least(F.col("onset") + F.col("duration"), F.col("hi")) - F.greatest("onset", "lo")
    near = pairs.withColumn("over", over).where(F.col("over") > share * F.col("duration")).select("rec", "truth_id", "found_id", "onset", "lo", "over")

    def match(frame):
        used, out = set(), []
        ordered = frame.sort_values(["onset", "truth_id", "over", "lo", "found_id"], ascending=[True, True, False, True, True])
        done = set()
        for r in ordered.itertuples():
            if r.truth_id not in done and r.found_id not in used:
                done.add(r.truth_id)
                used.add(r.found_id)
                out.append((r.rec, r.truth_id, r.found_id))
        import pandas as pd

        return pd.DataFrame(out, columns=["rec", "truth_id", "found_id"])

    return near.groupBy("rec").applyInPandas(match, "rec long, truth_id long, found_id long")


def paired(arms: DataFrame, keys: list[str], arm: str, a, b, x: str) -> DataFrame:
    """One row a key with the values of two arms, both present."""
    got = arms.groupBy(*keys).agg(F.max(F.when(F.col(arm) == a, F.col(x))).alias("a"), F.max(F.when(F.col(arm) == b, F.col(x))).alias("b"))
    return got.where("a is not null and b is not null")


def marker_times(events: DataFrame, offset: str = "marker_offset") -> DataFrame:
    """Events with the time of their marker: the onset and the event's own offset in seconds, 0 where it has none."""
    return events.withColumn("marker", F.col("onset") + F.coalesce(F.col(offset), F.lit(0.0)))


def phase_at_marker(marked: DataFrame, phases: DataFrame, fs: float) -> DataFrame:
    """Marked events with the phase (ch, i, phase) at the sample nearest their marker, held inside the record."""
    last = phases.groupBy("ch").agg(F.max("i").alias("_last"))
    at = marked.join(last, "ch").withColumn("i", F.greatest(F.lit(0), F.least(F.col("_last"), F.floor(F.col("marker") * fs + 0.5))).cast("bigint")).drop("_last")
    return at.join(phases.select("ch", "i", "phase"), ["ch", "i"])
