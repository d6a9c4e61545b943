"""Tables with versions: a new one is written beside the old, and a pointer is moved to it only when it is whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> str | None:
    """The present version's name, or None."""
    files, at = _store(spark, f"{path}/current.json")
    if not files.exists(at):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/current.json").collect()))["version"]


def publish(table: DataFrame, path: str) -> str:
    """Writes a version and points to it; whatever fails before the pointer is moved leaves the former version in place."""
    spark, name = table.sparkSession, uuid.uuid4().hex
    table.write.parquet(f"{path}/{name}")
    files, fresh = _store(spark, f"{path}/.{name}.json")
    out = files.create(fresh, True)
    out.write(bytearray(json.dumps({"version": name}).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(rename, 1)
    kinds[0] = rename.OVERWRITE
    options.rename(fresh, _store(spark, f"{path}/current.json")[1], kinds)
    return name


def current(spark: SparkSession, path: str) -> DataFrame:
    found = version(spark, path)
    if found is None:
        raise FileNotFoundError(f"no version has been published in {path}")
    return spark.read.parquet(f"{path}/{found}")


def grid_search(keys: DataFrame, grid: list[dict[str, float]], score: Callable[[DataFrame], DataFrame], path: str, error: str = "error") -> DataFrame:
    """The best grid point of every key, published as a version; the former version stays if anything fails.

    All points of all keys are rows of one job: `score` takes (keys, point, the grid's columns) and adds an error. Points without a finite error are
    passed over, the first of equal ones wins, and a key without any is an error.
    """
    from tideline.operators.probes import grid_best

    names = list(grid[0])
    points = F.explode(F.array(*[F.struct(F.lit(n).alias("point"), *[F.lit(float(g[c])).alias(c) for c in names]) for n, g in enumerate(grid)])).alias("_g")
    asked = keys.select(*keys.columns, points).select(*keys.columns, "_g.*")
    best = grid_best(score(asked), keys.columns, error, ["point"])
    name = uuid.uuid4().hex
    held = f"{path}/.{name}"
    best.write.parquet(held)
    found = keys.sparkSession.read.parquet(held)
    if found.count() < keys.distinct().count():
        raise ValueError("a key has no grid point with a finite error")
    publish(found, path)
    files, at = _store(keys.sparkSession, held)
    files.delete(at, True)
    return current(keys.sparkSession, path)
