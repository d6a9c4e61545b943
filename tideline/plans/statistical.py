"""Queries over statistics, joins in time, the registry, gates and seeded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.rng import Stream
from tideline.operators import channels, gates, joins, pairs, samples, stats
from tideline.plans.base import SIG, TIMED, Book, r, signal, table, timed
from tideline.sources import epochs, montage, params
from tideline.streaming import segments

BOOK = Book()
query, QUERIES, SQL = BOOK.query, BOOK.QUERIES, BOOK.SQL


@query("SELECT event_type, round(avg(value), 4) AS mean, CASE WHEN count(value) >= 2 THEN round(stddev_pop(value), 4) END AS sd, CASE WHEN avg(value) <> 0 AND count(value) >= 2 THEN round(stddev_pop(value) / avg(value), 6) END AS cv, count(value) AS n FROM events GROUP BY event_type")
def moments(spark, sf_dir) -> DataFrame:
    return stats.moments(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"), r("cv").alias("cv"), "n")


@query(f"WITH {TIMED} SELECT type, count(phase) AS n, round(atan2(sum(sin(phase)), sum(cos(phase))), 5) + 0.0 AS direction, round(sqrt(pow(sum(sin(phase)), 2) + pow(sum(cos(phase)), 2)) / count(phase), 6) AS resultant FROM timed GROUP BY type")
def circular_summary(spark, sf_dir) -> DataFrame:
    return stats.circular(timed(spark, sf_dir), ["type"], "phase").select("type", "n", r("direction", 5).alias("direction"), r("resultant").alias("resultant"))


@query(f"""WITH {TIMED}, g AS (SELECT type, ch, count(*) AS n, atan2(sum(sin(phase)), sum(cos(phase))) AS d, sqrt(pow(sum(sin(phase)), 2) + pow(sum(cos(phase)), 2)) / count(*) AS q FROM timed GROUP BY 1, 2)
 SELECT type, CAST(sum(n) AS BIGINT) AS n, round(sqrt(pow(sum(n * q * cos(d)), 2) + pow(sum(n * q * sin(d)), 2)) / sum(n), 6) AS resultant FROM g GROUP BY type""")
def pooled_circular(spark, sf_dir) -> DataFrame:
    return stats.pooled_circular(stats.circular(timed(spark, sf_dir), ["type", "ch"], "phase"), ["type"]).select("type", "n", r("resultant").alias("resultant"))


_LS = f"""WITH {TIMED}, m AS (SELECT *, x - avg(x) OVER (PARTITION BY ch) AS y FROM timed), s AS (SELECT ch, count(*) AS n, sum(y * y) AS yy, sum(cos(phase) * cos(phase)) AS cc, sum(sin(phase) * sin(phase)) AS ss, sum(cos(phase) * sin(phase)) AS cs, sum(y * cos(phase)) AS cy, sum(y * sin(phase)) AS sy FROM m GROUP BY ch),
 b AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS bc, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS bs FROM s)"""


@query(_LS + " SELECT ch, n, round(sqrt(bc * bc + bs * bs), 4) AS amplitude, round((2 * (bc * cy + bs * sy) - (bc * bc * cc + 2 * bc * bs * cs + bs * bs * ss)) / yy, 6) + 0.0 AS r2 FROM b")
def harmonic_fit(spark, sf_dir) -> DataFrame:
    return stats.harmonic(timed(spark, sf_dir), ["ch"], "phase", "x").select("ch", "n", r("amplitude", 4).alias("amplitude"), r("r2").alias("r2"))


@query(f"""WITH {TIMED}, g AS (SELECT ch, count(*) AS n, var_pop(cos(phase)) AS cc, var_pop(sin(phase)) AS ss, covar_pop(cos(phase), sin(phase)) AS cs, covar_pop(cos(phase), x) AS cy, covar_pop(sin(phase), x) AS sy, avg(x) AS m, avg(cos(phase)) AS mc, avg(sin(phase)) AS ms FROM timed GROUP BY ch),
 b AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS bc, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS bs FROM g WHERE n >= 4) SELECT ch, round(m - bc * mc - bs * ms, 4) + 0.0 AS intercept, round(bc, 4) + 0.0 AS cosine, round(bs, 4) + 0.0 AS sine FROM b""")
def harmonic_with_intercept(spark, sf_dir) -> DataFrame:
    return stats.harmonic3(timed(spark, sf_dir), ["ch"], "phase", "x").select("ch", *[r(c, 4).alias(c) for c in ("intercept", "cosine", "sine")])


@query(f"WITH {SIG}, p AS (SELECT ch, x / 100 AS rr, lag(x / 100) OVER (PARTITION BY ch ORDER BY i) AS p FROM sig) SELECT ch, round(stddev_pop(rr) * 1000, 3) AS sdnn, round(sqrt(avg((rr - p) * (rr - p))) * 1000, 3) AS rmssd, round(60 / avg(rr), 4) AS rate FROM p GROUP BY ch")
def interval_variability(spark, sf_dir) -> DataFrame:
    from tideline.operators.windows import by

    rr = signal(spark, sf_dir).withColumn("rr", F.col("x") / 100).withColumn("p", F.lag("rr").over(by()))
    return stats.interval_variability(rr, ["ch"], "rr", "p").select("ch", r("sdnn", 3).alias("sdnn"), r("rmssd", 3).alias("rmssd"), r("rate", 4).alias("rate"))


def _excl(p: float) -> str:
    at = lambda j: f"v[CAST(least(n, greatest(1, {j})) AS BIGINT)]"
    return f"CASE WHEN n >= 4 THEN round({at(f'floor((n + 1) * {p})')} + ((n + 1) * {p} - floor((n + 1) * {p})) * ({at(f'floor((n + 1) * {p}) + 1')} - {at(f'floor((n + 1) * {p})')}), 5) END"


@query(f"""WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY user_id)
 SELECT user_id, round(q1, 5) AS q1, round(m, 5) AS median, round(q3, 5) AS q3, {_excl(0.25)} AS x1, {_excl(0.75)} AS x3 FROM q""")
def quartiles_both_ways(spark, sf_dir) -> DataFrame:
    return stats.quartiles(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", *[r(c, 5).alias(c) for c in ("q1", "median", "q3", "x1", "x3")])


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY event_type), d AS (SELECT event_type, m, quantile_cont(abs(value - m), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY 1, 2)
 SELECT event_type, round(m, 5) AS median, round(1.4826::DOUBLE * mad, 5) AS spread, round(1.4826::DOUBLE * mad / m, 6) AS cv FROM d""")
def robust_spread(spark, sf_dir) -> DataFrame:
    return stats.robust(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", r("median", 5).alias("median"), r("spread", 5).alias("spread"), r("cv").alias("cv"))


@query("""WITH f AS (SELECT l_returnflag AS flag, l_quantity > 25 AS t, l_discount > 0.05 AS d FROM lineitem), c AS (SELECT flag, CAST(sum(CASE WHEN t AND d THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN d AND NOT t THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN t AND NOT d THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM f GROUP BY flag)
 SELECT flag, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def matching_scores(spark, sf_dir) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return stats.scores(f, ["flag"], F.col("l_quantity") > 25, F.col("l_discount") > 0.05).select("flag", "tp", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


_PAIRS = "arms AS (SELECT c_nationkey AS seed, c_mktsegment AS arm, CAST(round(sum(c_acctbal)) AS BIGINT) AS v FROM customer GROUP BY 1, 2), pairs AS (SELECT seed, seed % 3 AS g, max(CASE WHEN arm = 'BUILDING' THEN v END) AS a, max(CASE WHEN arm = 'MACHINERY' THEN v END) AS b FROM arms GROUP BY 1), ok AS (SELECT * FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)"
_TAIL = "CASE WHEN n <= 0 THEN 1.0::DOUBLE ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT unnest(range(0, 63)) AS i) WHERE i <= n AND i >= {k}) END"


def _arms(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("seed"), F.col("c_mktsegment").alias("arm")).agg(F.round(F.sum("c_acctbal")).cast("bigint").alias("v"))
    return joins.paired(v, ["seed"], "arm", "BUILDING", "MACHINERY", "v").withColumn("g", F.col("seed") % 3)


@query(f"WITH {_PAIRS} SELECT CAST(g AS INTEGER) AS g, CAST(seed AS INTEGER) AS seed, a, b, round(sqrt(greatest(0, a::DOUBLE * a - b::DOUBLE * b)), 3) AS excess FROM ok")
def paired_arms(spark, sf_dir) -> DataFrame:
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return _arms(spark, sf_dir).select("g", "seed", "a", "b", r(stats.excess(a, b), 3).alias("excess"))


@query(f"""WITH {_PAIRS}, c AS (SELECT g, CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS INTEGER) AS k, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS INTEGER) AS n FROM ok GROUP BY g),
 p AS (SELECT *, {_TAIL.format(k='k')} AS u, {_TAIL.format(k='n - k')} AS l FROM c) SELECT CAST(g AS INTEGER) AS g, k, n, round(u, 6) AS p_upper, round(least(1, 2 * least(u, l)), 6) AS p_two_sided FROM p""")
def sign_test(spark, sf_dir) -> DataFrame:
    return stats.sign_test(_arms(spark, sf_dir), ["g"], "a", "b").select("g", "k", "n", r("p_upper").alias("p_upper"), r("p_two_sided").alias("p_two_sided"))


@query(f"""WITH {_PAIRS}, c AS (SELECT g, CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS INTEGER) AS k, CAST(count(*) AS INTEGER) AS n FROM ok GROUP BY g), p AS (SELECT *, {_TAIL.format(k='k')} AS p FROM c) SELECT CAST(g AS INTEGER) AS g, k, n, round(p, 6) AS p, p < 0.05 AS pass FROM p""")
def gate_detection(spark, sf_dir) -> DataFrame:
    return gates.detection(_arms(spark, sf_dir), ["g"], "a", "b").select("g", "k", "n", r("p").alias("p"), "pass")


@query(f"""WITH {_PAIRS}, c AS (SELECT g, CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS INTEGER) AS k, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS INTEGER) AS n, quantile_cont(sqrt(greatest(0, a::DOUBLE * a - b::DOUBLE * b)), 0.5) AS effect FROM ok GROUP BY g),
 p AS (SELECT *, {_TAIL.format(k='k')} AS u, {_TAIL.format(k='n - k')} AS l FROM c) SELECT CAST(g AS INTEGER) AS g, k, n, round(least(1, 2 * least(u, l)), 6) AS p, round(effect, 3) AS effect, NOT (least(1, 2 * least(u, l)) < 0.05 AND effect > 0.048) AS pass FROM p""")
def gate_null(spark, sf_dir) -> DataFrame:
    d = _arms(spark, sf_dir).withColumns({"a": F.col("a").cast("double"), "b": F.col("b").cast("double")})
    return gates.null_arm(d, ["g"], "a", "b", 0.048).select("g", "k", "n", r("p").alias("p"), r("effect", 3).alias("effect"), "pass")


@query("""WITH w AS (SELECT l_shipdate::DATE AS d, quantile_cont(CASE WHEN l_returnflag = 'A' THEN l_quantity END, 0.5) AS A, quantile_cont(CASE WHEN l_returnflag = 'R' THEN l_quantity END, 0.5) AS R FROM lineitem GROUP BY 1)
 SELECT CAST(d AS VARCHAR) AS d, round(A, 4) AS "A", round(R, 4) AS "R", round(CASE WHEN R <> 0 THEN A / R END, 5) AS ratio FROM w""")
def cohort_summary(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("d", F.to_date("l_shipdate").cast("string"))
    return stats.summary(df, ["d"], "l_returnflag", ("A", "R"), "l_quantity").select("d", r("A", 4).alias("A"), r("R", 4).alias("R"), r("ratio", 5).alias("ratio"))


@query("""WITH i AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.25) AS lo, quantile_cont(c_acctbal, 0.75) AS hi, count(c_acctbal) AS n FROM customer GROUP BY 1)
 SELECT s_suppkey, i.c_nationkey, CASE WHEN n < 8 THEN 'INSUFFICIENT' WHEN s_acctbal BETWEEN lo AND hi THEN 'HOLD' ELSE 'MOVE' END AS verdict FROM supplier JOIN i ON s_nationkey = c_nationkey""")
def hold_or_move(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("value"))
    ref = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"))
    named = stats.verdicts(v, ref, ["c_nationkey"])
    return named.join(v, ["c_nationkey", "value"]).select("s_suppkey", "c_nationkey", "verdict").distinct()


@query("SELECT p_brand, round(avg(abs(p_retailprice - p_size * 30) / abs(p_size * 30)), 5) AS error FROM part GROUP BY p_brand")
def mean_relative_error(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "part").withColumn("want", F.col("p_size") * 30)
    return stats.mean_relative_error(d, ["p_brand"], "p_retailprice", "want").select("p_brand", r("error", 5).alias("error"))


_SPANS = "spans AS (SELECT user_id AS ch, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS onset, 600.0::DOUBLE + value AS duration, event_id AS event FROM events)"


def _spans(spark, sf_dir) -> DataFrame:
    return timed(spark, sf_dir).select("ch", (F.col("t") - 1704067200).cast("double").alias("onset"), (600.0 + F.col("x")).alias("duration"), F.col("event_id").alias("event"))


@query(f"""WITH {_SPANS}, ep AS (SELECT DISTINCT ch, e * 3600.0::DOUBLE AS lo, (e + 1) * 3600.0::DOUBLE AS hi, e FROM (SELECT ch, unnest(range(0, 48)) AS e FROM (SELECT DISTINCT ch FROM spans)))
 SELECT spans.ch, CAST(e AS BIGINT) AS e, count(*) AS events, CAST(sum(event) AS BIGINT) AS ids FROM spans JOIN ep ON spans.ch = ep.ch AND onset < hi AND onset + duration > lo GROUP BY 1, 2""")
def interval_overlap(spark, sf_dir) -> DataFrame:
    s = _spans(spark, sf_dir)
    ep = s.select("ch").distinct().withColumn("e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(47).cast("bigint")))).withColumns({"lo": F.col("e") * 3600.0, "hi": (F.col("e") + 1) * 3600.0})
    return joins.overlapping(s, ep, 3600.0, ["ch"]).groupBy("ch", "e").agg(F.count("*").alias("events"), F.sum("event").alias("ids"))


@query("""WITH s AS (SELECT user_id, ts, event_type AS state FROM events WHERE event_type IN ('click', 'purchase')), a AS (SELECT e.event_id, (SELECT arg_max(s.state, s.ts) FROM s WHERE s.user_id = e.user_id AND s.ts <= e.ts) AS state FROM events e) SELECT event_id, state FROM a""")
def as_of_state(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("t"), F.col("event_type").alias("kind"))
    steps = e.where(F.col("kind").isin("click", "purchase")).select("user_id", "t", F.col("kind").alias("state"))
    return joins.as_of(e.drop("kind"), steps, ["user_id"], "state").select("event_id", "state")


@query(f"WITH {SIG}, n AS (SELECT ch, count(*) AS n FROM sig GROUP BY ch), t AS (SELECT ch, n, unnest([-1.0, 0.3, 1.49, 4.5, 1000.0])::DOUBLE AS t FROM n), j AS (SELECT ch, t, CAST(greatest(0, least(n - 1, floor(t * 4 + 0.5))) AS BIGINT) AS i FROM t) SELECT j.ch, j.t, j.i, sig.x FROM j JOIN sig ON j.ch = sig.ch AND j.i = sig.i")
def sample_at_time(spark, sf_dir) -> DataFrame:
    s = signal(spark, sf_dir)
    times = s.groupBy("ch").agg(F.count("*").alias("n")).withColumn("t", F.explode(F.array(*[F.lit(v) for v in (-1.0, 0.3, 1.49, 4.5, 1000.0)])))
    return joins.sample_at(times, s, 4.0, F.col("n")).select("ch", "t", "i", "x")


@query(f"""WITH {_SPANS}, a AS (SELECT ch, unnest([0, 100000, 777777, 2000000, 9000000])::DOUBLE AS t FROM (SELECT DISTINCT ch FROM spans)),
 d AS (SELECT a.ch, a.t, abs(onset - t) AS distance, row_number() OVER (PARTITION BY a.ch, a.t ORDER BY abs(onset - t), onset, event DESC) AS k FROM a JOIN spans USING (ch)) SELECT ch, t, distance FROM d WHERE k = 1""")
def nearest_event(spark, sf_dir) -> DataFrame:
    s = _spans(spark, sf_dir)
    at = s.select("ch").distinct().withColumn("t", F.explode(F.array(*[F.lit(float(v)) for v in (0, 100000, 777777, 2000000, 9000000)])))
    return joins.nearest_event(s, at, ["ch"]).select("ch", "t", "distance")


@query(f"""WITH {TIMED}, c AS (SELECT type, event_id AS candidate, phase AS ca FROM timed WHERE event_id % 2 = 1), a AS (SELECT event_id AS id, type, phase FROM timed WHERE event_id % 2 = 0),
 d AS (SELECT id, abs(atan2(sin(phase - ca), cos(phase - ca))) AS distance, row_number() OVER (PARTITION BY id ORDER BY abs(atan2(sin(phase - ca), cos(phase - ca))), candidate) AS k FROM a JOIN c USING (type)) SELECT id, round(distance, 6) + 0.0 AS distance FROM d WHERE k = 1""")
def nearest_angle(spark, sf_dir) -> DataFrame:
    """Of every even event among all odd ones of its type."""
    t = timed(spark, sf_dir)
    a = t.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "type", F.col("phase").alias("angle"))
    c = t.where("event_id % 2 = 1").select("type", F.col("event_id").alias("candidate"), F.col("phase").alias("candidate_angle"))
    return joins.nearest_angle(a, c, ["type"]).select("id", r("distance").alias("distance"))


@query()
def greedy_matching(spark, sf_dir) -> DataFrame:
    s = _spans(spark, sf_dir).select(F.col("ch").alias("rec"), F.col("event").alias("id"), "onset", "duration")
    return joins.greedy_match(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 3600.0)


@query(f"WITH {_SPANS} SELECT ch, event, CAST(onset AS DOUBLE) AS onset, duration FROM spans WHERE onset < 90000 AND onset + duration > 86400")
def events_in_window(spark, sf_dir) -> DataFrame:
    return epochs.events_in(_spans(spark, sf_dir), 86400.0, 90000.0).select("ch", "event", "onset", "duration")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def anti_membership(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
def semi_membership(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("SELECT count(*) AS common FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 2 = 1)")
def disjoint_holdout(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.where("doc_id % 2 = 0").intersect(d.where("doc_id % 2 = 1")).agg(F.count("*").alias("common"))


@query("""WITH m AS (SELECT p_brand AS gate, CASE WHEN p_size % 2 = 0 THEN 'positive' ELSE 'null' END AS arm FROM part GROUP BY 1, 2 HAVING max(p_size) >= 49), l AS (SELECT p_brand AS gate, CASE WHEN p_size % 2 = 0 THEN 'positive' ELSE 'null' END AS arm FROM part GROUP BY 1, 2 HAVING min(p_size) <= 2)
 SELECT gate, arm, 'not in the ledger' AS problem FROM m WHERE (gate, arm) NOT IN (SELECT (gate, arm) FROM l) UNION ALL SELECT gate, arm, 'no module' FROM l WHERE (gate, arm) NOT IN (SELECT (gate, arm) FROM m)
 UNION ALL SELECT gate, arm, 'no null arm' FROM m WHERE arm = 'positive' AND gate NOT IN (SELECT gate FROM m WHERE arm = 'null')""")
def gate_preflight(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"gate": F.col("p_brand"), "arm": F.when(F.col("p_size") % 2 == 0, "positive").otherwise("null")})
    arms = p.groupBy("gate", "arm").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    return gates.preflight(arms.where("lo <= 2").select("gate", "arm"), arms.where("hi >= 49").select("gate", "arm"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'RECORD' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'FAIL' WHEN o_orderkey % 3 = 1 THEN 'SKIPPED' ELSE 'UNAVAILABLE' END END"


@query(f"WITH s AS (SELECT o_custkey, {_STATUS} AS status FROM orders) SELECT o_custkey, CASE max(CASE status WHEN 'ERROR' THEN 3 WHEN 'FAIL' THEN 2 WHEN 'SKIPPED' THEN 1 WHEN 'UNAVAILABLE' THEN 1 ELSE 0 END) WHEN 3 THEN 'ERROR' WHEN 2 THEN 'FAIL' WHEN 1 THEN 'INCOMPLETE' ELSE 'PASS' END AS verdict FROM s GROUP BY 1")
def overall_verdict(spark, sf_dir) -> DataFrame:
    return gates.overall(table(spark, sf_dir, "orders").select("o_custkey", F.expr(_STATUS).alias("status")), ["o_custkey"])


@query("SELECT bool_and(c = 1) AS repeats, count(DISTINCT d) = count(*) AS differs, count(*) AS seeds FROM (SELECT c_custkey, count(DISTINCT sha256(c_name)) AS c, first(sha256(c_name)) AS d FROM customer GROUP BY 1)")
def gate_determinism(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"), F.sha2("c_name", 256).alias("digest"))
    return gates.determinism(d)


@query("SELECT round(avg(l_discount - 0.05), 5) + 0.0 AS chi, count(*) AS n, abs(avg(l_discount - 0.05)) < 0.1 AND abs(avg(l_tax - 0.04)) < 1.0 AS pass FROM lineitem")
def gate_white_noise(spark, sf_dir) -> DataFrame:
    fits = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("chi"), (F.col("l_tax") - 0.04).alias("knee"))
    return gates.white_noise_null(fits).select(r("chi", 5).alias("chi"), "n", "pass")


_W = ", ".join(f"('{g}', '{c}', {montage.weight(g, c)!r}::DOUBLE, {i})" for g in montage.PATCHES for i, (c, _, _) in enumerate(montage.PLACES))
_WANT = [("alpha", "O1"), ("alpha", "O2"), ("alpha", "Pz"), ("slow_osc", "Fz"), ("theta", "Cz")]


@query(f"""WITH w(generator, channel, w, i) AS (VALUES {_W}), b AS (SELECT generator, channel FROM (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY w DESC, i) AS k FROM w) WHERE k = 1), e(generator, channel) AS (VALUES {', '.join(map(str, _WANT))})
 SELECT b.generator, b.channel, e.channel IS NOT NULL AS match FROM b LEFT JOIN e ON b.generator = e.generator AND b.channel = e.channel""")
def gate_topography(spark, sf_dir) -> DataFrame:
    w = montage.weights(spark).join(montage.table(spark).select("channel", "place"), "channel")
    best = samples.first_largest(w, ["generator"], F.col("w"), F.col("place")).select(F.col("patch").alias("generator"), "channel")
    return gates.topography(best, spark.createDataFrame(_WANT, "generator string, channel string"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def minimum_support(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT p_type AS standing, count(*) AS n FROM part GROUP BY ROLLUP (p_type)")
def standing_tally(spark, sf_dir) -> DataFrame:
    return params.tally(table(spark, sf_dir, "part").withColumnRenamed("p_type", "standing"))


_PARAMS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in (x[0], x[1], x[9], x[3])) + ")" for x in params.rows())


@query(f"WITH p(key, kind, standing, v) AS (VALUES {_PARAMS}) SELECT key, kind, standing, CAST(v AS DOUBLE) AS v FROM p")
def registry_table(spark, sf_dir) -> DataFrame:
    return params.table(spark).select("key", "kind", "standing", "v")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, 'an interval''s ends are missing or out of order' AS rule FROM part WHERE NOT coalesce(p_size <= p_retailprice - 900, false)")
def registry_violations(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    null = lambda t: F.lit(None).cast(t)
    rows = p.select(F.col("p_partkey").cast("string").alias("key"), F.lit("interval").alias("kind"), F.lit("band_edges").alias("meaning"), null("double").alias("v"), F.col("p_size").cast("double").alias("lo"), (F.col("p_retailprice") - 900).alias("hi"), null("string").alias("text"), null("array<string>").alias("items"), F.lit("").alias("units"), F.lit("chosen").alias("standing"), null("array<string>").alias("states"), F.lit(False).alias("provisional"))
    return params.violations(rows)


@query("WITH f(state, f, chi, knee) AS (VALUES ('n1', 13.0::DOUBLE, 1.4::DOUBLE, 32.423::DOUBLE), ('rem', 20.0::DOUBLE, 2.1::DOUBLE, 539.7131::DOUBLE), ('n2', 1.0::DOUBLE, 1.9::DOUBLE, 1.0::DOUBLE)) SELECT state, round(knee, 4) AS knee, round(pow(f, chi), 4) AS expected FROM f WHERE abs(knee - pow(f, chi)) > 0.001 * pow(f, chi)")
def registry_knee_check(spark, sf_dir) -> DataFrame:
    f = spark.createDataFrame([("n1", 13.0), ("rem", 20.0), ("n2", 1.0)], "state string, f double")
    return params.knee_check(params.table(spark), f).select("state", r("knee", 4).alias("knee"), r("expected", 4).alias("expected"))


_M = "4294967295"
_ROT = "(((({x}) << {k}) & 4294967295) | (({x}) >> {n}))"


def _rot(x: str, k: int) -> str:
    return _ROT.format(x=x, k=k, n=32 - k)


@query(f"""WITH RECURSIVE seeds AS (SELECT n_nationkey AS seed, sha256(n_nationkey || '/draws') AS h FROM nation), w AS (SELECT seed, {', '.join(f"CAST('0x' || substr(h, {8 * j + 7}, 2) || substr(h, {8 * j + 5}, 2) || substr(h, {8 * j + 3}, 2) || substr(h, {8 * j + 1}, 2) AS BIGINT) AS s{j}" for j in range(4))} FROM seeds),
 d AS (SELECT seed, 0 AS i, s0, s1, s2, s3 FROM w UNION ALL SELECT seed, i + 1, xor(s0, xor(s3, s1)), xor(s1, xor(s2, s0)), xor(xor(s2, s0), (s1 << 9) & {_M}), {_rot('xor(s3, s1)', 11)} FROM d WHERE i < 7)
 SELECT CAST(seed AS INTEGER) AS seed, CAST(i AS INTEGER) AS i, ({_rot(f'((s0 + s3) & {_M})', 7)} + s0) & {_M} AS u FROM d""")
def seeded_draws(spark, sf_dir) -> DataFrame:
    """Eight draws of a named stream for each seed."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for seed in batch["seed"].tolist():
                s = Stream(seed, "draws")
                yield pd.DataFrame({"seed": seed, "i": range(8), "u": [s.next_uint32() for _ in range(8)]})

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seed")).mapInPandas(run, "seed int, i int, u long")


@query()
def resumable_segments(spark, sf_dir) -> DataFrame:
    seg = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("run")).withColumns({"segment": F.lit(0), "n": F.lit(512)})
    return segments.batch(seg).select("run", "i", *[r(c, 5).alias(c) for c in ("belt", "phase", "ecg", "drive")])


@query()
def generated_runs(spark, sf_dir) -> DataFrame:
    from tideline.functions import generators

    runs = table(spark, sf_dir, "region").select(F.concat(F.lit("run"), F.col("r_regionkey")).alias("run_id"), F.element_at(F.array(*map(F.lit, ("wake_ec", "n1", "n2", "n3", "rem"))), F.col("r_regionkey") + 1).alias("state"), F.col("r_regionkey").alias("seed"), F.lit(4.0).alias("seconds"), F.lit(0.3).alias("depth"), F.lit(0.0).alias("snr_db"))
    return generators.runs(runs).select("run_id", "channel", F.size("xs").alias("n"), r(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x), 3).alias("power"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_properties(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf_dir) -> DataFrame:
    got = segments.windowed_events(table(spark, sf_dir, "events"))
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", r("mean", 5).alias("mean"))


@query()
def principal_shares(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("all"), "embedding")
    got = channels.rank_statistics(pairs.covariances(e, "embedding", ["all"]))
    return spark.createDataFrame([(got["n95"], got["n99"], round(got["first"], 5))], "n95 int, n99 int, first double")
