"""Queries over samples and windows: referencing, projection, gain, runs, extrema, decimation, fluctuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators import samples, windows
from tideline.plans.base import MULTI, SIG, Book, multichannel, r, sig, signal, table
from tideline.sources import epochs, montage

BOOK = Book()
query, QUERIES, SQL = BOOK.query, BOOK.QUERIES, BOOK.SQL
CENTRE = 50.0


@query(f"""WITH {sig(CENTRE)}, edged AS (SELECT *, CASE WHEN (x < 0) = (lag(x < 0) OVER (PARTITION BY ch ORDER BY i)) THEN 0 ELSE 1 END AS e FROM sig),
 numbered AS (SELECT *, sum(e) OVER (PARTITION BY ch ORDER BY i) AS island FROM edged),
 waves AS (SELECT ch, island, count(*) AS n, max(abs(x)) AS peak FROM numbered GROUP BY 1, 2)
 SELECT ch, CAST(sum(CASE WHEN n >= 2 AND 2 * peak >= 75 THEN n ELSE 0 END) AS BIGINT) AS counted, CAST(sum(n) AS BIGINT) AS n,
 round(CAST(sum(CASE WHEN n >= 2 AND 2 * peak >= 75 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS occupancy FROM waves GROUP BY ch""")
def half_wave_occupancy(spark, sf_dir) -> DataFrame:
    """Half waves of at least 75 peak to peak, as a share of each channel's samples."""
    return windows.half_wave_occupancy(signal(spark, sf_dir, CENTRE), 75.0).select("ch", "counted", "n", r("occupancy").alias("occupancy"))


@query(f"WITH {SIG} SELECT ch, i, round(sqrt(avg(x * x) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 4) AS rms FROM sig")
def running_rms(spark, sf_dir) -> DataFrame:
    return windows.running_rms(signal(spark, sf_dir), 3).select("ch", "i", r("rms", 4).alias("rms"))


@query(f"WITH {SIG}, p AS (SELECT ch, x, lag(x) OVER (PARTITION BY ch ORDER BY i) AS p FROM sig) SELECT ch, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(x, p), 6) + 0.0 END AS r FROM p GROUP BY ch")
def lag_correlation(spark, sf_dir) -> DataFrame:
    return windows.lag_correlation(signal(spark, sf_dir)).select("ch", "n", r("r").alias("r"))


@query(f"""WITH {sig(CENTRE)}, n AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM sig WINDOW w AS (PARTITION BY ch ORDER BY i)),
 k AS (SELECT ch, i, round(x, 4) AS x, CASE WHEN x > b AND x >= a THEN 'peak' WHEN x < b AND x <= a THEN 'trough' END AS kind FROM n) SELECT ch, i, x, kind FROM k WHERE kind IS NOT NULL""")
def local_extrema(spark, sf_dir) -> DataFrame:
    return windows.extrema(signal(spark, sf_dir, CENTRE)).select("ch", "i", r("x", 4).alias("x"), "kind")


@query(f"""WITH {SIG}, l AS (SELECT ch, quantile_cont(x, 0.75) AS l FROM sig GROUP BY ch), s AS (SELECT sig.*, x > l AS st FROM sig JOIN l USING (ch)),
 e AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY ch ORDER BY i) THEN 0 ELSE 1 END AS e FROM s), m AS (SELECT *, sum(e) OVER (PARTITION BY ch ORDER BY i) AS island FROM e),
 runs AS (SELECT ch, island, st, count(*) AS n FROM m GROUP BY 1, 2, 3), g AS (SELECT *, island > 1 AND island < max(island) OVER (PARTITION BY ch) AS inner_ FROM runs)
 SELECT ch, CAST(sum(CASE WHEN st THEN 1 ELSE 0 END) AS BIGINT) AS bursts, round(avg(CASE WHEN st THEN n END), 6) AS length, round(avg(CASE WHEN NOT st AND inner_ THEN n END), 6) AS gap FROM g GROUP BY ch""")
def percentile_bursts(spark, sf_dir) -> DataFrame:
    return windows.bursts(signal(spark, sf_dir), 0.75).select("ch", "bursts", r("length").alias("length"), r("gap").alias("gap"))


@query(f"""WITH {sig(CENTRE)}, p AS (SELECT *, lag(x) OVER (PARTITION BY ch ORDER BY i) AS p FROM sig), c AS (SELECT ch, i, (i - 1 + p / (p - x)) / 4.0 AS t FROM p WHERE p < 0 AND x >= 0),
 d AS (SELECT ch, i, t - lag(t) OVER (PARTITION BY ch ORDER BY i) AS period FROM c) SELECT ch, i, round(period, 6) AS period FROM d WHERE period IS NOT NULL""")
def upward_crossings(spark, sf_dir) -> DataFrame:
    return windows.upward_periods(signal(spark, sf_dir, CENTRE), 4.0).select("ch", "i", r("period").alias("period"))


@query(f"""WITH {SIG}, s AS (SELECT *, count(*) OVER (PARTITION BY ch) AS c FROM sig), p AS (SELECT ch, CASE WHEN c < 40 THEN i ELSE CAST(floor(i * 20 / c::DOUBLE) AS BIGINT) END AS pixel, x FROM s)
 SELECT ch, pixel, min(x) AS lo, max(x) AS hi, count(*) AS n FROM p GROUP BY 1, 2""")
def pixel_extremes(spark, sf_dir) -> DataFrame:
    return windows.decimated_extremes(signal(spark, sf_dir), 20)


@query(f"WITH {SIG}, m AS (SELECT ch, quantile_cont(x, 0.5) AS m FROM sig GROUP BY ch) SELECT ch, CAST(sum(CASE WHEN x > m THEN 1 ELSE 0 END) AS BIGINT) AS ones, round(avg(CASE WHEN x > m THEN 1.0 ELSE 0.0 END), 6) AS density FROM sig JOIN m USING (ch) GROUP BY ch")
def symbol_density(spark, sf_dir) -> DataFrame:
    return windows.binarized(signal(spark, sf_dir)).groupBy("ch").agg(F.sum("s").alias("ones"), r(F.avg("s")).alias("density"))


@query(f"""WITH {SIG}, m AS (SELECT *, count(*) OVER w AS c, quantile_cont(x, 0.5) OVER w AS q FROM sig WINDOW w AS (PARTITION BY ch ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
 f AS (SELECT ch, i, x, CASE WHEN c = 11 THEN q ELSE x END AS m FROM m) SELECT ch, i, round(m, 4) AS m, x BETWEEN 5 AND 200 AND abs(x - m) <= 0.25 * m AS good FROM f""")
def interval_quality(spark, sf_dir) -> DataFrame:
    return windows.rr_quality(signal(spark, sf_dir), 5.0, 200.0, 0.25).select("ch", "i", r("m", 4).alias("m"), "good")


@query(f"""WITH {SIG}, a AS (SELECT *, sqrt(avg(x * x) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS rms FROM sig), m AS (SELECT ch, avg(rms) AS m FROM a GROUP BY ch)
 SELECT ch, i, round(x / pow(greatest(rms, 0.1 * m), 0.5), 5) AS y FROM a JOIN m USING (ch)""")
def flattened_carrier(spark, sf_dir) -> DataFrame:
    return windows.flattened(signal(spark, sf_dir), 4, 0.5).select("ch", "i", r("y", 5).alias("y"))


@query(f"""WITH {SIG}, d AS (SELECT ch, i, x - avg(x) OVER (PARTITION BY ch) AS x FROM sig), y AS (SELECT ch, i, sum(x) OVER (PARTITION BY ch ORDER BY i) AS y FROM d),
 e AS (SELECT ch, i, y, s AS size, floor(i / s::DOUBLE) AS box FROM y, (SELECT unnest([4, 6, 8, 12, 16]) AS s)),
 f AS (SELECT ch, size, box, count(*) AS n, regr_syy(y, i) AS syy, regr_sxy(y, i) AS sxy, regr_sxx(y, i) AS sxx FROM e GROUP BY 1, 2, 3),
 g AS (SELECT ch, size, sqrt(sum(greatest(0, syy - sxy * sxy / sxx)) / sum(n)) AS f FROM f WHERE n = size GROUP BY 1, 2)
 SELECT ch, round(regr_slope(ln(f), ln(size)), 5) AS slope, count(*) AS scales FROM g WHERE f > 0 GROUP BY ch HAVING count(*) >= 3""")
def fluctuation_slope(spark, sf_dir) -> DataFrame:
    return windows.fluctuation_slope(signal(spark, sf_dir), [4, 6, 8, 12, 16]).select("ch", r("slope", 5).alias("slope"), "scales")


@query(f"WITH {SIG} SELECT ch, i, x FROM sig WHERE i % 4 = 0")
def strided_samples(spark, sf_dir) -> DataFrame:
    return samples.decimated(signal(spark, sf_dir), 4)


@query(f"WITH {SIG} SELECT ch, CAST(floor(i / 5.0) AS BIGINT) AS block, round(avg(x), 5) AS x FROM sig GROUP BY 1, 2 HAVING count(*) = 5")
def block_means(spark, sf_dir) -> DataFrame:
    return samples.block_means(signal(spark, sf_dir), 5).select("ch", "block", r("x", 5).alias("x"))


@query(f"""WITH {SIG}, u AS (SELECT DISTINCT ch FROM sig), p AS (SELECT ch, i FROM u, (SELECT unnest(range(-5, 10)) AS i))
 SELECT p.ch, p.i, sig.x AS x, sig.x IS NULL AS blank FROM p LEFT JOIN sig ON p.ch = sig.ch AND p.i = sig.i""")
def window_before_start(spark, sf_dir) -> DataFrame:
    return samples.windowed(signal(spark, sf_dir), 10, 15).select("ch", "i", F.when(~F.isnan("x"), F.col("x")).alias("x"), F.isnan("x").alias("blank"))


@query(f"WITH {SIG} SELECT ch, CAST(floor(i / 16.0) AS BIGINT) AS epoch, count(*) AS n, round(sqrt(avg(x * x)), 4) AS rms FROM sig GROUP BY 1, 2")
def epoch_rms(spark, sf_dir) -> DataFrame:
    return windows.epochs(signal(spark, sf_dir), 16).groupBy("ch", "epoch").agg(F.count("*").alias("n"), r(samples.rms(F.col("x")), 4).alias("rms"))


@query(f"WITH {SIG}, l AS (SELECT ch, sqrt(avg(CASE WHEN i < 16 THEN x * x END)) AS l FROM sig GROUP BY ch) SELECT ch, i, round(x * 10.0 / l, 5) AS x FROM sig JOIN l USING (ch)")
def first_epoch_rms(spark, sf_dir) -> DataFrame:
    return samples.rms_matched(signal(spark, sf_dir), 10.0, 16).select("ch", "i", r("x", 5).alias("x"))


@query(f"""WITH {SIG}, s AS (SELECT i + 2 AS i, x AS s FROM sig WHERE ch = 1) SELECT sig.ch, sig.i, round(CASE WHEN sig.ch = 2 THEN 0.6 * coalesce(s.s, 0.0) + pow(1 - 0.6 * 0.6, 0.5) * x ELSE x END, 5) AS x
 FROM sig LEFT JOIN s ON sig.ch = 2 AND sig.i = s.i""")
def injected_lag(spark, sf_dir) -> DataFrame:
    return samples.lag_coupled(signal(spark, sf_dir), 1, 2, 2, 0.6).select("ch", "i", r("x", 5).alias("x"))


def _referenced(mode: str):
    def run(spark, sf_dir) -> DataFrame:
        near = samples.nearest(montage.table(spark).where(F.col("channel").isin("C3", "C4", "Cz", "P3")), 2) if mode == "laplacian" else None
        return samples.rereferenced(multichannel(spark, sf_dir), mode, ["l_orderkey", "l_linenumber"], near).select("l_orderkey", "l_linenumber", "channel", r("x").alias("x"))

    run.__name__ = f"reference_{mode.replace('-', '_')}"
    return run


_REFS = f"WITH {MULTI}, a AS (SELECT *, max(CASE WHEN channel = 'A1' THEN x END) OVER w AS a1, max(CASE WHEN channel = 'A2' THEN x END) OVER w AS a2, avg(CASE WHEN channel NOT IN ('A1', 'A2') THEN x END) OVER w AS m FROM multi WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) SELECT l_orderkey, l_linenumber, channel, round(x - (%s), 6) + 0.0 AS x FROM a WHERE channel NOT IN ('A1', 'A2')"
#: The two nearest of the four channels, from their places.
_NEAR = {"C3": ("P3", "Cz"), "C4": ("Cz", "C3"), "Cz": ("C3", "C4"), "P3": ("C3", "Cz")}
for _mode, _sql in {
    "as-generated": _REFS % "0.0",
    "linked-mastoid": _REFS % "(a1 + a2) * 0.5",
    "contralateral": _REFS % "CASE WHEN regexp_matches(channel, '[zZ]$') THEN (a1 + a2) * 0.5 WHEN regexp_matches(channel, '[13579]$') THEN a2 ELSE a1 END",
    "average": _REFS % "m",
    "laplacian": f"WITH {MULTI}, n(channel, other) AS (VALUES {', '.join(f'({c!r}, {o!r})' for c, os in _NEAR.items() for o in os)}) SELECT a.l_orderkey, a.l_linenumber, a.channel, round(max(a.x) - avg(b.x), 6) + 0.0 AS x FROM multi a JOIN n ON a.channel = n.channel JOIN multi b ON b.channel = n.other AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2, 3",
}.items():
    query(_sql)(_referenced(_mode))

_MONTAGE = "montage(channel, x, y, place) AS (VALUES " + ", ".join(f"('{c}', {x}::DOUBLE, {y}::DOUBLE, {i})" for i, (c, x, y) in enumerate(montage.PLACES)) + ")"


@query(f"""WITH {_MONTAGE}, d AS (SELECT a.channel, b.channel AS neighbour, row_number() OVER (PARTITION BY a.channel ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.place) AS k
 FROM montage a JOIN montage b ON a.channel <> b.channel) SELECT channel, neighbour FROM d WHERE k <= 4""")
def nearest_electrodes(spark, sf_dir) -> DataFrame:
    return samples.nearest(montage.table(spark), 4)


_WEIGHTS = [(t, c, w) for k, t in enumerate(("click", "view", "purchase", "login", "scroll", "signup", "search", "logout")) for c, w in (("C3", 0.5 - 0.125 * k), ("C4", 0.25 * k), ("Cz", 0.0 if k % 2 else 1.0))]


@query(f"""WITH w(generator, channel, w) AS (VALUES {', '.join(f"('{t}', '{c}', {w}::DOUBLE)" for t, c, w in _WEIGHTS)}), s AS (SELECT event_type AS generator, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value AS x FROM events)
 SELECT i, channel, round(sum(w * x), 6) + 0.0 AS x FROM s JOIN w USING (generator) WHERE w <> 0 GROUP BY 1, 2""")
def projection(spark, sf_dir) -> DataFrame:
    sources = samples.indexed(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").withColumnRenamed("ch", "generator")
    weights = spark.createDataFrame(_WEIGHTS, "generator string, channel string, w double")
    return samples.projected(sources, weights, ["i"]).select("i", "channel", r("x").alias("x"))


@query("""WITH w AS (SELECT label AS patch, k AS channel, sqrt(sum(w * w)) AS l FROM (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS w FROM embeddings) GROUP BY 1, 2)
 SELECT patch, channel, round(l / max(l) OVER (PARTITION BY patch), 6) AS loading FROM w""")
def patch_loading(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("patch"), F.posexplode("embedding").alias("k", "w"))
    return samples.patch_loading(e.select("patch", F.col("k").cast("bigint").alias("channel"), F.col("w").cast("double").alias("w"))).select("patch", "channel", r("loading").alias("loading"))


@query("""WITH w AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS w FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, k) AS p FROM w)
 SELECT vec_id, k, round(w, 6) + 0.0 AS w FROM n WHERE p = 1""")
def argmax_channel(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "w")).withColumn("w", F.col("w").cast("double"))
    return samples.first_largest(e, ["vec_id"], F.col("w"), F.col("k")).select("vec_id", F.col("k").cast("bigint").alias("k"), r("w").alias("w"))


@query("""WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts) / 3600) AS h FROM events), e AS (SELECT user_id, row_number() OVER w - 1 AS epoch, h * 3600 AS t_start, (lag(h) OVER w + 1) * 3600 AS ended FROM h WINDOW w AS (PARTITION BY user_id ORDER BY h))
 SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(epoch AS BIGINT) AS epoch, CAST(t_start AS DOUBLE) AS t_start, CAST(ended AS DOUBLE) AS ended FROM e WHERE abs(t_start - ended) > 1e-9""")
def contiguous_epochs(spark, sf_dir) -> DataFrame:
    """Hours with events as a user's epochs: those that don't continue the hour before."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    hours = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), hour.alias("h")).distinct()
    number = (F.row_number().over(Window.partitionBy("run_id").orderBy("h")) - 1).cast("bigint")
    made = hours.select("run_id", number.alias("epoch"), (F.col("h") * 3600.0).alias("t_start"), F.lit(3600.0).alias("duration"), F.array(F.lit("Cz")).alias("channels"))
    return epochs.gaps(made).withColumnRenamed("end", "ended")
