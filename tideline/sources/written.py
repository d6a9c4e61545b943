"""Small tables that several later steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """This application's folder under `spark.checkpoint.dir`; where that is unset, a temporary one, on local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/tideline-scratch"
    return f"{found.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """The table, written and read back: computed once, and safe from lost executors."""
    path = f"{root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what this application has written; results that still read it must have been written elsewhere."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
