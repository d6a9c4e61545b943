"""What the third round's findings showed."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tideline.functions import dsp, peaks
from tideline.llm import common
from tideline.operators import beats, channels, joins, overview, pairs, probes, scans, spatial, spectra
from tideline.plans import registry


def test_nearest_angle_across_bins_and_the_turn(spark):
    draw = random.Random(3)
    asked = [(i, k, draw.uniform(-7, 7)) for i, k in enumerate("aabb" * 30)] + [(900, "c", 0.1), (901, "d", 1.0)]
    candidates = [(i, k, draw.uniform(-7, 7)) for i, k in enumerate("aab" * 5)] + [(50, "c", 6.2)]
    a = spark.createDataFrame(asked, "id long, type string, angle double")
    c = spark.createDataFrame(candidates, "candidate long, type string, candidate_angle double")
    away = lambda x, y: abs(math.atan2(math.sin(x - y), math.cos(x - y)))
    want = {i: min(away(x, y) for _, t, y in candidates if t == k) for i, k, x in asked if k != "d"}
    for bins in (1, 7, 4096):
        got = {r["id"]: r["distance"] for r in joins.nearest_angle(a, c, ["type"], bins).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    plan = joins.nearest_angle(a, c, ["type"])._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan


def test_slope_with_a_zero_is_nan_as_in_the_sql(spark):
    rows = [(1, i, float(i % 3), float(i)) for i in range(12)] + [(2, i, math.exp(0.5 * i), float(i)) for i in range(12)]
    s = spark.createDataFrame(rows, "ch long, i long, y double, x double")
    got = {r["ch"]: r["slope"] for r in probes.log_slope(s, 3, 0.0).collect()}
    assert math.isnan(got[1]) and abs(got[2] - 0.5) < 1e-12
    assert all(math.isfinite(r["slope"]) for r in probes.log_slope(s, 3).collect())


def test_names_and_types_of_parts_are_judged(spark, tmp_path):
    rows = [(0, "n2", "STUB STEEL"), (1, "brass", "tin"), (6, "rem", "A placeholder"), (7, "N3", "provisional")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_partkey"]: (r["name"], r["dealt_state"], r["state"], r["provisional"]) for r in registry.queries()["name_rules"](spark, str(tmp_path)).collect()}
    assert got == {0: ("wake_eo", True, True, True), 1: ("wake_ec", True, False, False), 6: ("N3", False, True, True), 7: ("awake", False, False, True)}


def test_circular_inputs_builds_no_product(spark):
    plan = registry.queries()["circular_inputs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joined and all("s_suppkey" in line or "p_partkey" in line for line in joined)


def test_pairs_of_short_records_are_whole_in_their_task(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(c, i, float(x)) for c in range(9) for i, x in enumerate(draw.normal(size=90 + 7 * (c % 3)))]
    s = spark.createDataFrame(rows, "ch long, i long, x double").cache()
    measures = {
        "r": (lambda n: pairs.correlations(s, n), 32),
        "coherence": (lambda n: pairs.connectivity(s, 8.0, 16, 1.0, 2.0, n), 3),
        "means": (lambda n: pairs.mean_connectivity(s, 8.0, 16, 1.0, 2.0, n) if n is None else pairs.band_means(pairs.connectivity(s, 8.0, 16, 1.0, 2.0, n)), 3),
        "lag_s": (lambda n: pairs.recovered_lag(s, 8.0, 16, 0.5, 3.0, n), 3),
        "plv": (lambda n: pairs.phase_locking(s, 9, n), 32),
    }
    table = lambda df: sorted(tuple(r) for r in df.collect())
    for blocks in ((128, 512), (2, 4)):
        monkeypatch.setattr(pairs, "BLOCK", blocks[0])
        monkeypatch.setattr(pairs, "WIDE", blocks[1])
        for run, cut in measures.values():
            whole, parts = run(None), run(cut)
            after = whole._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[0]
            assert "Aggregate" not in after and "Window" not in after  # pairs aren't shuffled
            got, want = table(whole), table(parts)
            assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)


def test_row_groups_of_large_rows_are_small(spark):
    scratch = common.Scratch(spark, "groups")
    rows = spark.range(0, 40, numPartitions=1).select("id", F.expr("transform(sequence(1, 20000), k -> xxhash64(id, k))").alias("xs"))
    try:
        saved = scratch.save(rows, "rows", 1 << 20)
        assert saved.count() == 40 and saved.select("id").distinct().count() == 40
        path = next(f for f in saved.inputFiles())
        assert pq.ParquetFile(path.removeprefix("file://")).metadata.num_row_groups > 5
    finally:
        scratch.close()


def test_knees_are_judged_at_once_and_rows_sent_together(spark):
    draw, grid = np.random.default_rng(2), tuple(spectra.knee_grid())
    f = np.arange(1, 15) / 4
    p = 10 ** draw.normal(size=14) / (2 + f**1.5)
    best = (math.nan, math.nan, math.nan, -math.inf)
    for chi, e in grid:
        shape = np.log10((10**e) ** chi + f**chi)
        offset = (np.log10(p) + shape).mean()
        r2 = 1 - ((np.log10(p) - offset + shape) ** 2).sum() / ((np.log10(p) - np.log10(p).mean()) ** 2).sum()
        best = max(best, (chi, (10**e) ** chi, offset, r2), key=lambda b: b[3])
    dsp._knee_shapes.cache_clear()
    got = [dsp.fit_knee(f, p, grid) for _ in range(3)]
    assert np.allclose([got[0][c][0] for c in ("chi", "knee", "offset", "r2")], best) and dsp._knee_shapes.cache_info().misses == 1
    assert math.isnan(dsp.fit_knee(f[:2], p[:2], grid)["r2"][0])
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [5.0])], "ch long, xs array<double>").coalesce(1)
    out = spectra.per_record(rows, lambda x: {"x": x, "n": len(x)}, "x double, n long", "long").collect()
    assert sorted(map(tuple, out)) == [(1, 1.0, 2), (1, 2.0, 2), (3, 5.0, 1)]


def test_spatial_summary_keeps_no_pairs(spark, monkeypatch):
    draw = np.random.default_rng(7)
    monkeypatch.setattr(spatial, "band_covariance", None)  # nothing goes through a table of pairs
    for many in (40, 2):
        z = draw.normal(size=(many, 12)) + 1j * draw.normal(size=(many, 12))
        rows = [(c, k, float(v.real), float(v.imag)) for c, line in enumerate(z) for k, v in enumerate(line) if (c + k) % 5]
        df = spark.createDataFrame(rows, "ch long, k long, re double, im double")
        dense = np.where((np.arange(many)[:, None] + np.arange(12)) % 5, z, 0)
        cov = (dense @ dense.conj().T).real
        r = np.abs(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))))[np.triu_indices(many, 1)]
        for buckets, block, bins in ((1 << 16, None, 4096), (4, 7, 5)):
            monkeypatch.setattr(spatial, "BUCKETS", buckets)
            got = spatial.spatial_summary(df, block, bins).first()
            assert got["channels"] == many and abs(got["correlation"] - np.median(r)) < 1e-12 and abs(got["rank"] - np.trace(cov) ** 2 / (cov**2).sum()) < 1e-9
    equal = spark.createDataFrame([(c, k, 1.0, float(k)) for c in range(30) for k in range(3)], "ch long, k long, re double, im double")
    assert abs(spatial.spatial_summary(equal).first()["correlation"] - 1) < 1e-12
    assert tuple(spatial.spatial_summary(equal.limit(0)).first()) == (0, None, None)


def test_sections_run_in_one_pass_and_arms_are_made_once(spark):
    draw = np.random.default_rng(8)
    s = spark.createDataFrame([(c, i, float(x)) for c in range(3) for i, x in enumerate(draw.normal(size=150 + c))], "ch long, i long, x double")
    turns = dsp.sections(8.0, 0.5, 2.0)
    assert len(turns) > 1
    whole = scans.filtered_in_turn(scans.chunks(s), turns, both_ways=True)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    cut = scans.filtered_in_turn(scans.chunks(s, 64), turns, both_ways=True)
    values = lambda rows, size: [r["x"] for r in scans.unchunked(rows, size).orderBy("ch", "i").collect()]
    assert np.allclose(values(whole, scans.CHUNK), values(cut, 64), atol=1e-9)
    arms = overview.arms(s, 8.0, 1.5, 0.1)
    plan = overview.pyramid(arms, 2, keys=("arm", "ch"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_spectra_are_fitted_together_as_they_are_alone(monkeypatch):
    draw, f = np.random.default_rng(9), np.arange(1, 40) / 4
    powers = [10 ** (1 - k * np.log10(f) + peaks.gaussians(f, [(2 + k, 0.8, 0.5)] * int(k < 3)) + 0.02 * draw.normal(size=len(f))) for k in np.linspace(0.5, 4, 12)]
    powers[3][5], powers[4][:] = 0.0, np.nan
    alone = [peaks.fit(f, p) for p in powers]
    calls, solve = [], peaks.solve
    monkeypatch.setattr(peaks, "solve", lambda *a: calls.append(1) or solve(*a))
    together = peaks.fit_all([f] * 12, powers)
    one = len(calls)
    assert peaks.fit_all([f] * 120, powers * 10) and len(calls) == 2 * one  # not more for ten times the spectra
    for a, b in zip(alone, together, strict=True):
        assert all(np.isclose(a[k], b[k], atol=1e-6, equal_nan=True) for k in ("offset", "exponent", "r2", "error")) and len(a["peaks"]) == len(b["peaks"])
    assert not together[4]["peaks"] and max(len(p["peaks"]) for p in together) > 0


def test_column_correlations_are_those_of_the_pairs(spark):
    draw = random.Random(10)
    rows = [(k, k % 3, draw.random(), None if k % 11 == 0 else draw.random(), draw.random()) for k in range(60)]
    rows += [(None, 1, 1.0, 2.0, 3.0), (5, None, 4.0, 5.0, 6.0)]
    for more in ([], [(k, k % 3, draw.random(), draw.random(), draw.random()) for k in (3, 3, 9, 11)]):
        wide = spark.createDataFrame(rows + more, "k long, l long, p double, q double, s double")
        long = wide.where("k is not null and l is not null").select(F.struct("k", "l").alias("i"), F.explode(F.create_map(*[F.lit(v) if i % 2 == 0 else F.col(v) for i, v in enumerate(("c", "p", "a", "q", "b", "s"))])).alias("ch", "x"))
        want = {(r["a"], r["b"]): (r["r"], r["n"]) for r in channels.pair_correlations(long).collect()}
        got = channels.column_correlations(wide, {"c": "p", "a": "q", "b": "s"}, ["k", "l"])
        found = {(r["a"], r["b"]): (r["r"], r["n"]) for r in got.collect()}
        assert found.keys() == want.keys() and all(abs(found[k][0] - want[k][0]) < 1e-12 and found[k][1] == want[k][1] for k in want)
        if not more:
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_peaks_of_short_records_are_not_carried_on(spark, monkeypatch):
    draw = np.random.default_rng(11)
    rows = [(c, i, float(x)) for c, n in ((1, 200), (2, 90), (3, 64)) for i, x in enumerate(draw.normal(size=n) * np.where(np.arange(n) % 40 == 20, 9, 1))]
    s = spark.createDataFrame(rows, "ch long, i long, x double")
    found = lambda size: sorted((r["ch"], r["i"], round(r["height"], 8), round(r["prominence"], 8)) for r in beats.qrs_peaks(s, 64.0, times=1.0, size=size).collect())
    seen, carried = [], beats._carried
    monkeypatch.setattr(beats, "_carried", lambda peaks, outlines, size: seen.append({r["ch"] for r in outlines.select("ch").distinct().collect()}) or carried(peaks, outlines, size))
    mixed = found(100)
    assert seen == [{1}]  # the others are one chunk
    whole = found(1 << 16)
    assert len(seen) == 1 and mixed == whole and {r[0] for r in whole} == {1, 2, 3}
