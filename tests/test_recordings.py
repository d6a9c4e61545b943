"""Recordings: the EDF source against files written here byte by byte."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.sources import edf

LABELS = [("EEG F4-M1", "uV", 8, -500.0, 500.0), ("EEG C4-M1", "mV", 8, -0.5, 0.5), ("ECG", "mV", 16, -2.0, 2.0), ("Temp", "degC", 1, 30.0, 45.0)]


def edf_bytes(digital, notes=None, records=None, gaps=False, duration=2.0, times=None):
    """A file of the format's rules: digital values by signal (records x samples), annotations by record."""
    n = len(next(iter(digital.values())))
    signals = [(label, unit, per, lo, hi, -2048, 2047) for label, unit, per, lo, hi in LABELS if label in digital]
    size = 60
    if notes is not None:
        signals.append(("EDF Annotations", "", size, -1.0, 1.0, -32768, 32767))
    pad = lambda v, w: str(v).encode("latin-1").ljust(w)[:w]
    kind = "EDF+D" if gaps else "EDF+C" if notes is not None else ""
    head = b"".join([pad("0", 8), pad("X X X X", 80), pad("Startdate X X X X", 80), pad("01.01.20", 8), pad("22.00.00", 8), pad(256 * (len(signals) + 1), 8), pad(kind, 44), pad(n if records is None else records, 8), pad(duration, 8), pad(len(signals), 4)])
    for values, width in (([s[0] for s in signals], 16), ([""] * len(signals), 80), ([s[1] for s in signals], 8), ([s[3] for s in signals], 8), ([s[4] for s in signals], 8), ([s[5] for s in signals], 8), ([s[6] for s in signals], 8), ([""] * len(signals), 80), ([s[2] for s in signals], 8), ([""] * len(signals), 32)):
        head += b"".join(pad(v, width) for v in values)
    body = b""
    for r in range(n):
        for label, *_ in LABELS:
            if label in digital:
                body += np.asarray(digital[label][r], "<i2").tobytes()
        if notes is not None:
            at = times[r] if times else r * duration
            tal = f"+{at}\x14\x14\x00".encode() + b"".join(f"+{o}\x15{d}\x14{t}\x14\x00".encode() for o, d, t in notes.get(r, []))
            body += tal.ljust(2 * size, b"\x00")
    return head + body


@pytest.fixture(scope="module")
def night(tmp_path_factory):
    rng = np.random.default_rng(4)
    digital = {label: rng.integers(-2048, 2048, (40, per)) for label, _, per, *_ in LABELS}
    notes = {0: [(0, 60, "Sleep stage W")], 3: [(6.5, 61, "Sleep stage N2"), (7, 0, "tone, ü")]}
    path = tmp_path_factory.mktemp("edf") / "night.edf"
    path.write_bytes(edf_bytes(digital, notes))
    return str(path), digital


def physical(label, digital):
    _, unit, _, lo, hi = next(row for row in LABELS if row[0] == label)
    return ((np.asarray(digital) + 2048) * (hi - lo) / 4095 + lo) * {"uV": 1, "mV": 1e3}.get(unit, 1)


def test_a_file_is_read_as_written(spark, night):
    path, digital = night
    got = edf.recording(spark, path).orderBy("record").collect()
    assert [r["record"] for r in got] == list(range(40)) and [r["t"] for r in got] == [2.0 * r for r in range(40)]
    for label in digital:
        assert np.allclose([r[label] for r in got], physical(label, digital[label]), rtol=1e-12, atol=1e-9)
    plain = edf.recording(spark, path)
    raw = spark.read.format("edf").option("microvolts", "false").option("signals", "ECG").load(path)
    assert plain.columns == ["file", "record", "t", *digital] and raw.columns == ["file", "record", "t", "ECG"]
    assert np.allclose(raw.orderBy("record").first()["ECG"], physical("ECG", digital["ECG"][0]) / 1e3)


def test_conditions_reach_the_reader(spark, night):
    path, digital = night
    read = spark.read.format("edf").option("span", 600).load(path)
    got = read.where("record >= 7 and record < 12").orderBy("record").collect()
    assert [r["record"] for r in got] == [7, 8, 9, 10, 11] and np.allclose(got[0]["Temp"], physical("Temp", digital["Temp"][7]))
    assert [r["record"] for r in read.where("t > 20 and t <= 24").orderBy("record").collect()] == [11, 12]
    assert read.where("record = 39").count() == 1 and read.where("record > 900").count() == 0
    schema = read.schema
    reader = edf.EdfReader(edf.EdfSource({"path": path, "span": "600"}), schema)
    assert len(reader.partitions()) > 10
    list(reader.pushFilters([edf.GreaterThanOrEqual(("record",), 7), edf.LessThan(("record",), 12)]))
    assert sum(p.last - p.first for p in reader.partitions()) <= 6


def test_only_the_asked_bytes_are_read(spark, night):
    path, digital = night
    edf.register(spark)
    schema = spark.read.format("edf").option("signals", "EEG C4-M1,ECG").load(path).schema
    reader = edf.EdfReader(edf.EdfSource({"path": path, "signals": "EEG C4-M1,ECG"}), schema)
    head = edf.header_of(path)
    whole = open(path, "rb").read()
    touched = []

    class File:
        def read_at(self, n, at):
            touched.append((at, n))
            return whole[at : at + n]

    rows = next(iter(reader._records(File(), head, edf.Records(path, 5, 9))))
    assert np.allclose(rows.column("ECG").to_pylist(), physical("ECG", digital["ECG"][5:9]))
    first = head.bytes + 5 * head.record_bytes
    assert touched == [(first + r * head.record_bytes + 16, 48) for r in range(4)]


def test_missing_derivations_are_named(spark, night):
    with pytest.raises(Exception, match="EEG O2-M1, EEG C3-M2"):
        edf.recording(spark, night[0], ["EEG F4-M1", "EEG C4-M1", "EEG O2-M1", "EEG C3-M2"]).count()


def test_annotations_are_intervals(spark, night):
    got = sorted(tuple(r)[1:] for r in edf.annotations(spark, night[0]).collect())
    assert got == [(0.0, 60.0, "Sleep stage W"), (6.5, 61.0, "Sleep stage N2"), (7.0, 0.0, "tone, ü")]


def test_folders_gaps_and_broken_files(spark, tmp_path):
    digital = {"ECG": np.arange(48).reshape(3, 16)}
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.edf").write_bytes(edf_bytes(digital, {}, gaps=True, times=[0, 50, 90]))
    (tmp_path / "sub" / "b.EDF").write_bytes(edf_bytes(digital, records=-1))
    (tmp_path / "notes.txt").write_bytes(b"x")
    got = edf.recording(spark, str(tmp_path), ["ECG"]).collect()
    assert sorted((r["file"][-5:], r["t"]) for r in got) == [("a.edf", 0.0), ("a.edf", 50.0), ("a.edf", 90.0), ("b.EDF", 0.0), ("b.EDF", 2.0), ("b.EDF", 4.0)]
    assert edf.recording(spark, str(tmp_path / "a.edf")).where("t >= 50").count() == 2
    assert edf.recording(spark, f"file://{tmp_path}/a.edf").count() == 3
    for name, raw, message in (("c", b"0", "short"), ("d", b"1" * 600, "not an EDF"), ("e", edf_bytes(digital)[:-5], "ends before"), ("f", edf_bytes(digital)[:300], "before its signals")):
        bad = tmp_path / f"{name}.edf"
        bad.write_bytes(raw)
        with pytest.raises(Exception, match=message):
            edf.recording(spark, str(bad)).count()
    with pytest.raises(Exception, match="nowhere"):
        edf.recording(spark, str(tmp_path / "nowhere.edf")).count()


def test_samples_and_stage_epochs(spark, night):
    path, digital = night
    records = edf.recording(spark, path, ["ECG", "EEG F4-M1"])
    samples = edf.samples(records)
    ecg = np.array([r["x"] for r in samples.where("channel = 'ECG'").orderBy("i").collect()])
    assert np.allclose(ecg, physical("ECG", digital["ECG"]).ravel())
    spans = edf.epochs(edf.annotations(spark, path), {"Sleep stage W": "wake", "Sleep stage N2": "n2"}, fs=8.0, seconds=10.0, most=4)
    assert sorted(tuple(r)[1:] for r in spans.collect()) == [(s, k, f + 80 * k, 80) for s, f in (("n2", 52), ("wake", 0)) for k in range(4)]
    got = edf.cut(samples.where("channel = 'ECG'"), spans, 80)
    for (state, epoch), first in {("n2", 1): 132, ("wake", 3): 240}.items():
        own = got.where((F.col("state") == state) & (F.col("epoch") == epoch)).orderBy("k").collect()
        assert [r["k"] for r in own] == list(range(80)) and np.allclose([r["x"] for r in own], ecg[first : first + 80])
