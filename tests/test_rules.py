"""Small rules: summed power, comparable exponents, markers, reports, the registry's emitter and released options."""

import json
import math

import pytest

from tideline.operators import gates, joins, spectra
from tideline.sources import params


def test_summed_power_and_comparable_exponents(spark):
    psd = spark.createDataFrame([(1, 0.5 * k, float(k + 1)) for k in range(20)], "ch long, freq double, power double")
    got = spectra.summed_band_power(psd, {"a": (0.0, 2.0), "b": (1.2, 3.4)}).first()
    assert got["a"] == pytest.approx(0.5 * (2 + 3 + 4 + 5)) and got["b"] == pytest.approx(0.5 * (4 + 5 + 6 + 7))
    fits = lambda chi, mode, lo: spark.createDataFrame([(1, chi, mode, lo, 45.0)], "ch long, chi double, mode string, lo double, hi double")
    assert spectra.exponent_difference(fits(1.5, "fixed", 30.0), fits(1.2, "fixed", 30.0), ["ch"]).first()["difference"] == pytest.approx(0.3)
    for other in (fits(1.2, "knee", 30.0), fits(1.2, "fixed", 2.0)):
        with pytest.raises(Exception, match="can't be compared"):
            spectra.exponent_difference(fits(1.5, "fixed", 30.0), other, ["ch"]).collect()


def test_markers(spark):
    events = spark.createDataFrame([(1, "spindle", 1.0, 1.0), (1, "k", 3.0, None), (1, "other", 99.0, 0.0)], "ch long, kind string, onset double, marker_offset double")
    marked = joins.marker_times(events)
    assert sorted(r["marker"] for r in marked.collect()) == [2.0, 3.0, 99.0]
    phases = spark.createDataFrame([(1, i, float(i)) for i in range(40)], "ch long, i long, phase double")
    assert sorted(r["phase"] for r in joins.phase_at_marker(marked, phases, 4.0).collect()) == [8.0, 12.0, 39.0]


def test_report_as_json(spark, tmp_path):
    results = [("G1", "rem", "PASS", {"chi": 1.5, "gap": math.nan}), ("G2", "", "SKIPPED", {})]
    made = gates.report_table(results)
    assert made["verdict"] == "INCOMPLETE" and made["counts"] == {"PASS": 1, "SKIPPED": 1} and made["gates"][0]["metrics"] == {"chi": 1.5}
    path = f"file://{tmp_path}/report"
    gates.write_report(spark, results, path)
    back = "".join(r["value"] + "\n" for r in spark.read.text(f"{path}/name=report.json").collect())
    assert json.loads(back) == made


def test_emitter_check_and_released_options():
    text = params.emit()
    assert params.stale(text) == [] and params.markdown().count("\n") == len(params.rows()) + 2
    lines = text.splitlines()
    changed = json.loads(lines[0]) | {"units": "changed"}
    key, gone = changed["key"], json.loads(lines[1])["key"]
    assert params.stale("\n".join([json.dumps(changed, sort_keys=True), *lines[2:], json.dumps({"key": "zzz"})])) == sorted([key, gone, "zzz"])
    good = {"value_db": -3.5, "generator_version": "7"}
    assert params.released({"drive": 1}, good, "7", drive=2) == {"drive": 2, "snr_db": -3.5}
    for bad in ({}, good | {"value_db": math.nan}, good | {"generator_version": "6"}, good | {"value_db": None}):
        with pytest.raises(ValueError, match="stale"):
            params.released({}, bad, "7")
