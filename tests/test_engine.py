"""Sources, streaming, gates and operators on made-up tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import gates, joins, pairs, samples, spectra, stats
from tideline.sources import epochs, montage, params
from tideline.streaming import segments


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, s, n) for r in (1, 2) for s, n in enumerate((100, 300, 50))]
    for s in range(3):
        spark.createDataFrame([x for x in rows if x[1] == s], "run long, segment int, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("run long, segment int, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = segments.stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    key = ["run", "i"]
    got = spark.read.parquet(str(tmp_path / "out")).orderBy(*key).collect()
    want = segments.batch(spark.createDataFrame(rows, "run long, segment int, n int")).orderBy(*key).collect()
    assert len(got) == 900 and got == want


def test_epochs_round_trip(spark, tmp_path):
    x = [("r", c, p, i, float(i * (p + 1))) for p, c in enumerate(("Cz", "A1")) for i in range(100)]
    table = epochs.blocks(spark.createDataFrame(x, "run_id string, channel string, place int, i long, x double"), 10.0, 25)
    epochs.write(table, str(tmp_path / "run"), {"seed": 1})
    back, manifest = epochs.read(spark, str(tmp_path / "run"))
    assert manifest["seed"] == 1 and epochs.gaps(back).count() == 0
    assert sorted(tuple(r) for r in epochs.samples(back.select(table.columns)).collect()) == sorted((r, c, i, v) for r, c, _, i, v in x)
    assert len(epochs.digests(back).first()["digest"]) == 64
    assert epochs.gaps(back.where("epoch <> 1")).count() == 1
    with pytest.raises(ValueError):
        epochs.signal_bytes([[1.0], [1.0, 2.0]])
    with pytest.raises(ValueError):
        epochs.signal_from(b"12345678", 1, 2)
    with pytest.raises(ValueError):
        epochs.signal_from(b"12345678", 1, 1, order="big")
    assert epochs.csv_text(["a", "b"], [[1.0], [1 / 3]]) == "a,b\n1,0.333333333\n"
    assert epochs.fingerprint({"a": "x\r\n"}) == epochs.fingerprint({"a": "x\n"})


def test_registry(spark):
    reg = params.Registry()
    assert reg.scalar("fs") == 256 and reg.band("isf1") == (0.008, 0.05) and reg.provisional("chi_n3") == 3.4
    assert reg.electrodes("reference_channels") == ["A1", "A2"] and reg.enum("welch_window") == "hann"
    for read, key in ((reg.scalar, "isf1"), (reg.scalar, "chi_n3"), (reg.band, "fs"), (reg.uncertainty, "isf1")):
        with pytest.raises(params.KindError):
            read(key)
    with pytest.raises(KeyError):
        reg.record("nothing")
    assert reg.applies_to("chi_n3", "n3") and not reg.applies_to("chi_n3", "rem") and reg.applies_to("fs", "rem")
    table = params.table(spark)
    assert params.violations(table).count() == 0
    assert params.violations(table.withColumn("kind", F.lit("odd"))).where("rule = 'unknown kind'").count() == table.count()
    assert params.emit() == params.emit(list(reversed(params.rows())))


@pytest.mark.parametrize("mode", ["linked-mastoid", "contralateral", "average", "laplacian"])
def test_references_are_linear(spark, mode):
    rng = np.random.default_rng(1)
    names = [p[0] for p in montage.PLACES]
    weights = dict(zip(names, rng.normal(size=21), strict=True))
    near = samples.nearest(montage.table(spark))
    one = spark.createDataFrame([(0, c, float(w)) for c, w in weights.items()], "i int, channel string, x double")
    three = one.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(s).alias("s")) for i, s in enumerate((1.0, 2.0, -3.0))])).alias("g"), "channel", "x").select("g.i", "channel", (F.col("x") * F.col("g.s")).alias("x"))
    gain = {r["channel"]: r["x"] for r in samples.rereferenced(one, mode, ["i"], near).collect()}
    for r in samples.rereferenced(three, mode, ["i"], near).collect():
        assert r["x"] == pytest.approx(gain[r["channel"]] * (1.0, 2.0, -3.0)[r["i"] - 1], abs=1e-12)
    assert len(gain) == 19
    with pytest.raises(ValueError):
        samples.rereferenced(one, "other", ["i"])


def test_connectivity_knows_its_answers(spark):
    t = np.arange(120 * 64) / 64
    rng = np.random.default_rng(2)
    turn = 2 * np.pi * 10 * t + np.cumsum(rng.normal(size=len(t))) * 0.1
    waves = [np.cos(turn), np.cos(turn - np.pi), np.cos(turn - np.pi / 2), rng.normal(size=len(t))]
    rec = spark.createDataFrame([(c, i, float(v)) for c, w in enumerate(waves) for i, v in enumerate(w + 0.3 * rng.normal(size=len(t)))], "ch long, i long, x double")
    got = {(r["a"], r["b"]): r["d"] for r in pairs.connectivity(rec, 64.0, 128, 9.0, 11.0).groupBy("a", "b").agg(F.avg("dwpli").alias("d")).collect()}
    assert got[(0, 1)] <= 0.1 and got[(0, 2)] >= 0.5 and got[(0, 3)] <= 0.2


def test_modulation_of_a_cosine(spark):
    rows = [(1, i, 1.4 + 0.25 * math.cos(2 * math.pi * 0.05 * i)) for i in range(400)] + [(2, i, math.nan) for i in range(5)]
    got = {r["ch"]: r["depth"] for r in spectra.modulation_depth(spark.createDataFrame([(c, f, v - 1.4 if v == v else v) for c, f, v in rows], "ch int, frame int, v double"), "v", 0.05, 1.0).collect()}
    assert got[1] == pytest.approx(0.25, abs=1e-3) and math.isnan(got[2])


def test_greedy_match_takes_the_best_unused(spark):
    truth = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 8.0, 10.0), (1, 3, 100.0, 10.0)], "rec long, id long, onset double, duration double")
    found = spark.createDataFrame([(1, 7, 1.0, 10.0), (1, 8, 9.0, 10.0), (1, 9, 109.0, 10.0)], "rec long, id long, onset double, duration double")
    got = sorted((r["truth_id"], r["found_id"]) for r in joins.greedy_match(truth, found, 7.0).collect())
    assert got == [(1, 7), (2, 8)]


def test_sign_test_is_exact(spark):
    d = spark.createDataFrame([(g, float(i < k), 0.5) for g, (k, n) in enumerate(((12, 12), (5, 12), (7, 12), (30, 60))) for i in range(n)] + [(9, 1.0, 1.0)], "g int, a double, b double")
    got = {r["g"]: (r["p_upper"], r["p_two_sided"]) for r in stats.sign_test(d, ["g"], "a", "b").collect()}
    tail = lambda k, n: sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    for g, (k, n) in enumerate(((12, 12), (5, 12), (7, 12), (30, 60))):
        assert got[g] == pytest.approx((tail(k, n), min(1, 2 * min(tail(k, n), tail(n - k, n)))))
    assert got[9] == (1.0, 1.0)
    assert got[0][0] == pytest.approx(0.000244, abs=1e-6)


def test_gate_statuses(spark):
    made = gates.run([
        gates.Gate("b", "positive", lambda: ("PASS", {}), after=["a"]),
        gates.Gate("a", "positive", lambda: ("FAIL", {"x": 1})),
        gates.Gate("c", "positive", lambda: 1 / 0),
        gates.Gate("d", "positive", lambda: ("PASS", {}), tool="no_such_tool_at_all"),
        gates.Gate("e", "positive", lambda: ("RECORD", {})),
    ])
    assert {n: s for n, _, s, _ in made} == {"a": "FAIL", "b": "SKIPPED", "c": "ERROR", "d": "UNAVAILABLE", "e": "RECORD"}
    assert gates.report(made).splitlines()[-1] == "ERROR" and gates.report([]).strip() == "INCOMPLETE"
    with pytest.raises(ValueError):
        gates.ordered([gates.Gate("x", "p", lambda: ("PASS", {}), after=["y"]), gates.Gate("y", "p", lambda: ("PASS", {}), after=["x"])])
    assert gates.bisected(lambda g: g, 3.25) == pytest.approx(3.25, abs=1e-5)


def test_boundary_jumps_fade(spark):
    rows = [(1, i, 0.0 if i < 10 else 5.0) for i in range(20)]
    got = [r["x"] for r in segments.joined_boundaries(spark.createDataFrame(rows, "ch int, i long, x double"), 10, 4).orderBy("i").collect()]
    assert got[:10] == [0.0] * 10 and got[10] == 0.0 and 0 < got[12] < 5 and got[14:] == [5.0] * 6


def test_plans_stay_lean(spark):
    """Filters and columns reach the scan, and overlap joins are no comparison of all with all."""
    from tideline.plans import registry

    def plan(name):
        return registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<c_nationkey:int,c_acctbal:double>" in plan("semi_membership") and "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)" in plan("semi_membership")
    assert "NestedLoop" not in plan("interval_overlap") and "Cartesian" not in plan("interval_overlap")


def test_validation_run(spark):
    from tideline.plans.validation import validation_run

    got = {(r["gate"], r["arm"]): r["status"] for r in validation_run(spark, "").collect()}
    assert got[("G3", "positive")] == "RECORD" and got[("G3", "null")] in ("PASS", "FAIL") and got[("G2", "positive")] == got[("G2", "null")] == "PASS"
    assert got[("G1a", "positive")] == "RECORD" and got[("G6", "positive")] == got[("G6", "null")] == "PASS"


def test_nearest_electrodes_of_the_fixed_places(spark):
    from tideline.operators import samples
    from tideline.sources import montage

    scalp = montage.table(spark).where(~F.col("channel").isin("A1", "A2"))
    got = {}
    for r in samples.nearest(scalp, 4).collect():
        got.setdefault(r["channel"], set()).add(r["neighbour"])
    want = {
        "Cz": "C3 C4 Fz Pz", "Fz": "F3 F4 Cz Fp1", "Pz": "P3 P4 Cz O1", "C3": "Cz T3 F3 P3", "C4": "Cz T4 F4 P4",
        "F3": "F7 Fz Fp1 C3", "P4": "T6 Pz O2 C4", "T3": "C3 F7 T5 F3",
    }
    assert {c: got[c] for c in want} == {c: set(v.split()) for c, v in want.items()}


def test_pairs_by_blocks_are_those_of_one_block(spark, monkeypatch):
    import numpy as np

    from tideline.operators import pairs

    rng = np.random.default_rng(3)
    rows = [(int(c), [float(v) for v in rng.normal(size=int(n))]) for c, n in zip(rng.permutation(11), rng.integers(3, 90, 11), strict=True)]
    table = spark.createDataFrame([(c, i, x) for c, xs in rows for i, x in enumerate(xs)], "ch long, i long, x double")
    kinds = [lambda t: pairs.correlations(t), lambda t: pairs.connectivity(t, 4.0, 16, 0.5, 1.5), lambda t: pairs.recovered_lag(t, 4.0, 16, 0.25, 1.5), lambda t: pairs.phase_locking(t, 4)]
    flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.fillna(-9.0).collect())
    whole = [flat(k(table)) for k in kinds]
    monkeypatch.setattr(pairs, "BLOCK", 3)
    monkeypatch.setattr(pairs, "STRETCH", 7)
    monkeypatch.setattr(pairs, "FRAMES", 2)
    assert [flat(k(table)) for k in kinds] == whole
    by = dict(rows)
    for a, b, r, n in whole[0]:
        assert a < b and n == min(len(by[a]), len(by[b])) and abs(r - np.corrcoef(by[a][:n], by[b][:n])[0, 1]) < 1e-6
    assert all(k(table.limit(0)).count() == 0 for k in kinds)


def test_covariances_of_vectors(spark):
    import numpy as np

    from tideline.operators import pairs

    rng = np.random.default_rng(4)
    x = rng.normal(100.0, 1.0, (60, 5))
    table = spark.createDataFrame([(i % 2, [float(v) for v in row]) for i, row in enumerate(x)], "g int, v array<double>").repartition(7)
    for r in pairs.covariances(table, "v", ["g"]).collect():
        assert abs(r["c"] - np.cov(x[r["g"] :: 2].T, bias=True)[r["a"], r["b"]]) < 1e-9


def test_spindles_are_found_and_matched():
    import numpy as np

    from tideline.plans.validation import detected, matched

    t = np.arange(0, 30, 1 / 256)
    x = np.random.default_rng(1).standard_normal(len(t)) + 20 * np.sin(2 * np.pi * 13 * t) * (np.abs(t - 10) < 0.5)
    found = detected(x)
    assert matched([(9.5, 1.0)], found) == 1 and matched([(20.0, 1.0)], found) == 0
    assert matched([(0.0, 10.0), (1.0, 2.0)], [(1.0, 5.0)]) == 1
