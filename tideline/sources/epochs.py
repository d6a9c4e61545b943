"""Epoch directories and block tables: writing, reading back, continuity and digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA_VERSION, EVENT_VERSION = 7, 2
BLOCK = "run_id string, epoch int, t_start double, duration double, fs double, channels array<string>, signal binary, digest string"


def signal_bytes(channels: list[list[float]]) -> bytes:
    """Channel after channel, little-endian 64-bit floats; ragged or empty records are errors."""
    import numpy as np

    if not channels or not channels[0] or len({len(c) for c in channels}) != 1:
        raise ValueError("channels must be of one length, and not empty")
    return np.asarray(channels, "<f8").tobytes()


def signal_from(raw: bytes, channels: int, samples: int, dtype: str = "float64", order: str = "little"):
    import numpy as np

    if dtype != "float64" or order != "little":
        raise ValueError(f"{order} {dtype} can't be read")
    if len(raw) != 8 * channels * samples:
        raise ValueError("the file's size doesn't fit its shape")
    return np.frombuffer(raw, "<f8").reshape(channels, samples)


def csv_text(names: list[str], channels: list[list[float]]) -> str:
    """A header and nine significant digits."""
    return "\n".join([",".join(names), *(",".join(f"{v:.9g}" for v in row) for row in zip(*channels, strict=True))]) + "\n"


def blocks(samples: DataFrame, fs: float, epoch: int) -> DataFrame:
    """Samples (run_id, channel, place, i, x) as one block row an epoch, channels in montage order."""
    cut = samples.withColumn("epoch", F.floor(F.col("i") / epoch).cast("int"))
    lines = cut.groupBy("run_id", "epoch", "channel", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))
    whole = lines.groupBy("run_id", "epoch").agg(F.array_sort(F.collect_list(F.struct("place", "channel", "xs"))).alias("cs"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                raw = signal_bytes([list(c["xs"]) for c in r.cs])
                rows.append((r.run_id, r.epoch, r.epoch * epoch / fs, len(r.cs[0]["xs"]) / fs, fs, [c["channel"] for c in r.cs], raw, hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCK.split(", ")])

    return whole.mapInPandas(run, BLOCK)


def write(table: DataFrame, path: str, manifest: dict) -> None:
    """Blocks as Parquet by run, the manifest as JSON beside them; the manifest comes last, so that a broken run has none."""
    table.write.partitionBy("run_id").parquet(f"{path}/blocks")
    table.sparkSession.createDataFrame([(json.dumps(manifest | {"schemaVersion": SCHEMA_VERSION}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Blocks and manifest; a missing manifest is an error, and so is another schema version."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["schemaVersion"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {manifest['schemaVersion']} can't be read")
    return spark.read.parquet(f"{path}/blocks"), manifest


def samples(table: DataFrame) -> DataFrame:
    """Blocks as (run_id, channel, i, x)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                n = round(r.duration * r.fs)
                got, first = signal_from(r.signal, len(r.channels), n), round(r.t_start * r.fs)
                yield pd.DataFrame({"run_id": r.run_id, "channel": np.repeat(r.channels, n), "i": np.tile(np.arange(first, first + n), len(r.channels)), "x": got.ravel()})

    return table.mapInPandas(run, "run_id string, channel string, i long, x double")


def gaps(table: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Epochs that don't continue the one before in time or channels; none must be left before records are joined."""
    w = Window.partitionBy("run_id").orderBy("epoch")
    before = table.select("run_id", "epoch", "t_start", "channels", F.lag(F.col("t_start") + F.col("duration")).over(w).alias("end"), F.lag("channels").over(w).alias("_c"))
    return before.where((F.abs(F.col("t_start") - F.col("end")) > tolerance) | (F.col("_c").isNotNull() & (F.col("channels") != F.col("_c")))).select("run_id", "epoch", "t_start", "end")


def digests(table: DataFrame) -> DataFrame:
    """One SHA-256 a run, of its epochs' digests in order."""
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "digest")))
    return table.groupBy("run_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda e: e["digest"]), ""), 256).alias("digest"))


def fingerprint(sources: dict[str, str]) -> str:
    """SHA-256 of texts by path, line ends unified, paths in order."""
    h = hashlib.sha256()
    for path in sorted(sources):
        h.update(path.encode() + b"\0" + sources[path].replace("\r\n", "\n").encode() + b"\0")
    return h.hexdigest()


def events_in(events: DataFrame, lo: float, hi: float) -> DataFrame:
    """Events that overlap the half-open span."""
    return events.where((F.col("onset") < hi) & (F.col("onset") + F.col("duration") > lo))


def events_above(events: DataFrame, tag: float) -> DataFrame:
    """Events whose inclusion tag, a random number and no score, reaches a bound."""
    return events.where(F.col("inclusion_tag") >= tag)
