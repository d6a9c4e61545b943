"""A stream of segments through the resumable controllers, as Structured Streaming state by run."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.streaming import controllers

OUT = "run long, i long, belt double, phase double, ecg double, drive double"


def advance(state: str | None, run: int, n: int, fs: float) -> tuple[str, dict]:
    """The next n samples of a run from its checkpoint, or from its beginning (seed = run)."""
    s = json.loads(state) if state else {"breath": controllers.breathing_state(run), "heart": controllers.heart_state(run), "infra": controllers.infra_state(run)}
    first = s["breath"]["at"]
    s["breath"], belt, phase, _ = controllers.breathe(s["breath"], n, fs)
    s["heart"], ecg, _ = controllers.beat(s["heart"], n, phase, fs)
    s["infra"], drive = controllers.drift(s["infra"], n, fs)
    return json.dumps(s), {"run": run, "i": range(first, first + n), "belt": belt, "phase": phase, "ecg": ecg, "drive": drive}


def stream(segments: DataFrame, fs: float = 256.0) -> DataFrame:
    """Segments (run, segment, n) of a stream as samples; each run's state is carried between micro-batches, and segments that
    arrive together are taken in order."""

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        held = pd.concat(list(batches)).sort_values("segment")
        now = state.get[0] if state.exists else None
        for n in held["n"]:
            now, out = advance(now, int(key[0]), int(n), fs)
            yield pd.DataFrame(out)
        state.update((now,))

    return segments.groupBy("run").applyInPandasWithState(step, OUT, "state string", "append", "NoTimeout")


def batch(segments: DataFrame, fs: float = 256.0) -> DataFrame:
    """The same samples in one go."""

    def whole(frame):
        import pandas as pd

        return pd.DataFrame(advance(None, int(frame["run"].iloc[0]), int(frame["n"].sum()), fs)[1])

    return segments.groupBy("run").applyInPandas(whole, OUT)


def joined_boundaries(samples: DataFrame, segment: int, fade: int) -> DataFrame:
    """Samples (ch, i, x) whose jump at each segment's start decays over `fade` samples (for display only)."""
    w = Window.partitionBy("ch").orderBy("i")
    jump = F.when((F.col("i") % segment == 0) & (F.col("i") > 0), F.lag("x").over(w) - F.col("x"))
    held = samples.withColumn("_j", jump).withColumn("_j", F.last("_j", ignorenulls=True).over(w.rowsBetween(-fade, 0)))
    left = F.lit(1.0) - (F.col("i") % segment) / F.lit(float(fade))
    return held.withColumn("x", F.col("x") + F.coalesce("_j", F.lit(0.0)) * F.greatest(left, F.lit(0.0))).drop("_j")


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extra over event tables: counts and means in event-time windows under a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
