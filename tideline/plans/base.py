"""How queries are registered, and the tables' roles: signals, phases, channels and arms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import samples

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """A module's queries and SQL."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; NaN as null, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c, digits) + F.lit(0.0))


def near(c: Column | str, digits: int = 6) -> Column:
    """As `r`, for results with a row a pair: in doubles, as the SQL's round, without a decimal a value. Of values below 10^12 or so."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.signum(c) * F.floor(F.abs(c) * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits) + F.lit(0.0))


def signal(spark: SparkSession, sf_dir: str, centre: float = 0.0) -> DataFrame:
    """Events as samples: a user is a channel, in order of time, the value less a constant."""
    got = samples.indexed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return got.withColumn("x", F.col("x") - centre) if centre else got


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ch, type, t, x, phase): events at seconds, with the day's phase."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    day = F.pmod(t, F.lit(86400))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ch"), F.col("event_type").alias("type"), t.alias("t"), F.col("value").alias("x"), (F.lit(6.283185307179586) * day / F.lit(86400.0)).alias("phase"))


def multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples of four scalp channels and two mastoids."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(v).cast("double").alias("x")) for c, v in CHANNELS.items()])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(pairs).alias("_p")).select("l_orderkey", "l_linenumber", "_p.*")


CHANNELS = {"C3": "l_quantity", "C4": "l_extendedprice", "Cz": "l_discount", "P3": "l_tax", "A1": "l_linenumber", "A2": "l_suppkey"}
SIG = "sig AS (SELECT user_id AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)"
TIMED = "timed AS (SELECT event_id, user_id AS ch, event_type AS type, CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS x, 6.283185307179586::DOUBLE * (CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 86400.0::DOUBLE AS phase FROM events)"
MULTI = "multi AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS channel, CAST({v} AS DOUBLE) AS x FROM lineitem" for c, v in CHANNELS.items()) + ")"


def sig(centre: float) -> str:
    return SIG.replace("value AS x", f"value - {centre} AS x")

