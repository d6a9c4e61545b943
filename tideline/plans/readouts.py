"""Queries over the readouts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import pairs, readouts, samples
from tideline.plans.base import SIG, TIMED, Book, near, r, signal, table, timed
from tideline.plans.samplewise import _MONTAGE
from tideline.plans.spectral import FS
from tideline.sources import montage

BOOK = Book()
query, QUERIES, SQL = BOOK.query, BOOK.QUERIES, BOOK.SQL
_W = "w(generator, channel, w, place) AS (VALUES " + ", ".join(f"('{g}_m0', '{c}', {montage.weight(g, c)!r}::DOUBLE, {i})" for g in montage.PATCHES for i, (c, _, _) in enumerate(montage.PLACES)) + ")"
_LAPLACE = """n AS (SELECT a.channel, b.channel AS other, row_number() OVER (PARTITION BY a.channel ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.place) AS k
 FROM montage a JOIN montage b ON a.channel <> b.channel WHERE a.channel NOT IN ('A1', 'A2') AND b.channel NOT IN ('A1', 'A2'))"""


@query(f"WITH {_W} SELECT generator, channel, round(w - avg(w) OVER (PARTITION BY generator), 6) + 0.0 AS x FROM w WHERE channel NOT IN ('A1', 'A2')")
def average_referenced_gain(spark, sf_dir) -> DataFrame:
    return readouts.referenced_gain(montage.weights(spark), "average").select("generator", "channel", r("x").alias("x"))


@query(f"WITH {_MONTAGE}, {_W}, {_LAPLACE} SELECT a.generator, a.channel, round(max(a.w) - avg(b.w), 6) + 0.0 AS x FROM w a JOIN n ON n.channel = a.channel AND n.k <= 4 JOIN w b ON b.generator = a.generator AND b.channel = n.other GROUP BY 1, 2")
def laplacian_referenced_gain(spark, sf_dir) -> DataFrame:
    """Four neighbours of nineteen channels."""
    near = samples.nearest(readouts.scalp_places(spark), 4)
    return readouts.referenced_gain(montage.weights(spark), "laplacian", near).select("generator", "channel", r("x").alias("x"))


@query(f"WITH {_MONTAGE}, s AS (SELECT channel FROM montage WHERE channel NOT IN ('A1', 'A2')) SELECT a.channel, b.channel AS other, round(CASE WHEN a.channel = b.channel THEN 1.0 ELSE 0.0 END - 1.0 / (SELECT count(*) FROM s), 6) AS c FROM s a, s b")
def average_reference_matrix(spark, sf_dir) -> DataFrame:
    return readouts.reference_matrix(readouts.scalp_places(spark), "average").select("channel", "other", r("c").alias("c"))


@query(f"WITH {SIG}, m AS (SELECT ch, x - avg(x) OVER (PARTITION BY ch) AS d FROM sig), k AS (SELECT ch, avg(pow(d, 2)) AS m2, avg(pow(d, 3)) AS m3, avg(pow(d, 4)) AS m4 FROM m GROUP BY ch) SELECT ch, round((m3 * m3 / pow(m2, 3) + 1) / (m4 / (m2 * m2)), 5) AS bimodality FROM k WHERE m2 > 0")
def bimodality(spark, sf_dir) -> DataFrame:
    return readouts.envelope_shape(signal(spark, sf_dir)).where("bimodality is not null").select("ch", r("bimodality", 5).alias("bimodality"))


@query(f"""WITH {SIG}, c AS (SELECT ch, i, x - avg(x) OVER (PARTITION BY ch) AS d FROM sig), v AS (SELECT ch, sum(d * d) AS v FROM c GROUP BY ch),
 a AS (SELECT a.ch, k, sum(a.d * coalesce(b.d, 0)) AS s FROM c a CROSS JOIN (SELECT unnest(range(1, 9)) AS k) LEFT JOIN c b ON a.ch = b.ch AND b.i = a.i + k GROUP BY 1, 2)
 SELECT v.ch, CAST(min(CASE WHEN s <= v / {math.e!r}::DOUBLE THEN k END) AS INTEGER) AS lag FROM v JOIN a ON v.ch = a.ch WHERE v > 0 GROUP BY v.ch""")
def folding_lag(spark, sf_dir) -> DataFrame:
    return readouts.folding_lag(signal(spark, sf_dir), 8)


@query(f"""WITH {TIMED}, e AS (SELECT ch, event_id, phase, row_number() OVER (PARTITION BY ch ORDER BY phase, event_id) - 1 AS r, count(*) OVER (PARTITION BY ch) AS n FROM timed),
 v AS (SELECT ch, k, sqrt(pow(avg(cos(phase + {2 * math.pi!r}::DOUBLE * k * r / n)), 2) + pow(avg(sin(phase + {2 * math.pi!r}::DOUBLE * k * r / n)), 2)) AS v FROM e CROSS JOIN (SELECT unnest(range(0, 6)) AS k) GROUP BY 1, 2)
 SELECT ch, round(max(CASE WHEN k = 0 THEN v END), 5) AS r, round(max(CASE WHEN k > 0 THEN v END), 5) AS null_max FROM v GROUP BY ch""")
def event_phase_null(spark, sf_dir) -> DataFrame:
    e = timed(spark, sf_dir).select("ch", F.col("event_id").alias("event"), "phase")
    return readouts.shifted_null(e, 5, ["ch"]).select("ch", r("r", 5).alias("r"), r("null_max", 5).alias("null_max"))


@query(f"""WITH {TIMED}, p AS (SELECT ch, row_number() OVER (PARTITION BY ch ORDER BY t, event_id) - 1 AS i, t, phase FROM timed), q AS (SELECT ch, phase, t - lag(t) OVER (PARTITION BY ch ORDER BY i) AS rr FROM p),
 d AS (SELECT ch, phase, rr - avg(rr) OVER (PARTITION BY ch) AS d FROM q WHERE rr IS NOT NULL), h AS (SELECT ch, count(*) AS beats, 2 * avg(d * cos(phase)) AS c, 2 * avg(d * sin(phase)) AS s FROM d GROUP BY ch)
 SELECT ch, beats, round(sqrt(c * c + s * s), 3) AS depth, round(atan2(s, c), 5) + 0.0 AS angle FROM h""")
def beat_phase_fit(spark, sf_dir) -> DataFrame:
    """Events as beats: the time since the one before against the day's phase."""
    from pyspark.sql.window import Window

    p = timed(spark, sf_dir).withColumn("i", (F.row_number().over(Window.partitionBy("ch").orderBy("t", "event_id")) - 1).cast("bigint"))
    return readouts.beat_phase_fit(p.select("ch", "i", F.col("t").cast("double").alias("t")), p.select("ch", "i", "phase")).select("ch", "beats", r("depth", 3).alias("depth"), r("angle", 5).alias("angle"))


@query(f"WITH {SIG}, c AS (SELECT ch, sqrt(avg(x * x)) AS v FROM sig GROUP BY ch) SELECT round(min(v), 4) AS lo, round(quantile_cont(v, 0.5), 4) AS mid, round(max(v), 4) AS hi FROM c")
def rms_spread(spark, sf_dir) -> DataFrame:
    s = signal(spark, sf_dir).withColumn("all", F.lit(0))
    return readouts.rms_spread(s, ["all"]).select(*[r(c, 4).alias(c) for c in ("lo", "mid", "hi")])


@query(f"WITH {_W} SELECT generator, channel FROM (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY abs(w) DESC, place) AS k FROM w) WHERE k = 1")
def peak_electrodes(spark, sf_dir) -> DataFrame:
    return readouts.peak_electrode(montage.weights(spark).join(montage.table(spark).select("channel", "place"), "channel"))


@query(f"WITH {_MONTAGE} SELECT a.channel AS a, b.channel AS b, round(exp(-sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 0.5), 6) AS c FROM montage a JOIN montage b ON a.channel <= b.channel")
def patch_covariance(spark, sf_dir) -> DataFrame:
    return readouts.patch_covariance(montage.table(spark), 0.5).select("a", "b", r("c").alias("c"))


@query()
def patch_modes(spark, sf_dir) -> DataFrame:
    return readouts.patch_modes(spark, readouts.scalp_places(spark), 0.5).select("mode", "channel", r("w", 5).alias("w"))


@query("SELECT l_returnflag, round(avg((least(l_discount, l_tax) + greatest(l_discount, l_tax)) / 2), 6) AS mid, round(sum(l_quantity / (2 * sqrt(2.0::DOUBLE))), 3) AS rms FROM lineitem GROUP BY 1")
def interval_picks(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(r(F.avg(readouts.midpoint(F.least("l_discount", "l_tax"), F.greatest("l_discount", "l_tax")))).alias("mid"), r(F.sum(readouts.peak_to_rms(F.col("l_quantity"))), 3).alias("rms"))


@query("""WITH n AS (SELECT *, list_element(['wake_eo', 'wake_ec', 'n1', 'n2', 'n3', 'rem', 'N3', 'awake'], 1 + CAST(p_partkey % 8 AS INTEGER)) AS name FROM part)
 SELECT p_partkey, name, name IN ('wake_eo', 'wake_ec', 'n1', 'n2', 'n3', 'rem') AS dealt_state, p_name IN ('wake_eo', 'wake_ec', 'n1', 'n2', 'n3', 'rem') AS state,
 contains(lower(p_type), 'provisional') OR contains(lower(p_type), 'placeholder') OR contains(lower(p_type), 'stub') AS provisional FROM n""")
def name_rules(spark, sf_dir) -> DataFrame:
    """Whether parts' names are states and their types provisional; beside them names of states and ones that only look like them, one a part."""
    names = F.array(*[F.lit(n) for n in ("wake_eo", "wake_ec", "n1", "n2", "n3", "rem", "N3", "awake")])
    named = table(spark, sf_dir, "part").withColumn("name", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")))
    rules = readouts.is_state(F.col("name")).alias("dealt_state"), readouts.is_state(F.col("p_name")).alias("state"), readouts.is_provisional(F.col("p_type")).alias("provisional")
    return named.select("p_partkey", "name", *rules)


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS gate, CAST(l_partkey AS VARCHAR) AS key FROM lineitem WHERE (l_suppkey, l_partkey) IN (SELECT (s_suppkey, p_partkey) FROM supplier JOIN part ON s_nationkey = p_size)")
def circular_inputs(spark, sf_dir) -> DataFrame:
    """Suppliers as gates and parts as keys: those that were fitted on each other, by nation and size."""
    s, p, li = (table(spark, sf_dir, t) for t in ("supplier", "part", "lineitem"))
    used = li.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    # Nation and size are looked up for the pairs that are used: all pairs of a nation and a size are their product.
    fitted = used.join(s, "s_suppkey").join(p, "p_partkey").where(F.col("s_nationkey") == F.col("p_size"))
    named = lambda df: df.select(F.col("s_suppkey").cast("string").alias("gate"), F.col("p_partkey").cast("string").alias("key"))
    return readouts.circular_inputs(named(used), named(fitted))


@query()
def band_means(spark, sf_dir) -> DataFrame:
    """Connectivity of all channel pairs, averaged over a band."""
    return pairs.mean_connectivity(signal(spark, sf_dir), FS, 16, 1.0, 2.0).select("a", "b", near("coherence", 4).alias("coherence"), near("dwpli", 4).alias("dwpli"))
