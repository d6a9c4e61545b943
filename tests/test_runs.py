"""Run folders: what is written is read back, and a broken job leaves no readable run."""

import json
import os

import pytest

from tideline.sources import epochs, runs


def block_rows(spark, ids=("a", "b")):
    samples = spark.createDataFrame([(r, c, place, i, float(100 * place + i)) for r in ids for place, c in enumerate(("C3", "C4")) for i in range(24)], "run_id string, channel string, place int, i long, x double")
    return epochs.blocks(samples, 8.0, 8)


def manifests(spark, ids=("a", "b")):
    return spark.createDataFrame([(r, "{}" if r == "b" else json.dumps({"seed": 7, "fs": 8})) for r in ids], "run_id string, manifest string")


def events(spark):
    return spark.createDataFrame([("a", 2.0, '{"kind": "spindle", "onset": 2.0}'), ("a", 0.5, '{"kind": "k, \\"x\\"", "onset": 0.5}')], "run_id string, onset double, event string")


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs")
    truth = spark.createDataFrame([("a", 1, '{"state": "n2"}')], "run_id string, epoch int, truth string")
    physiology = spark.createDataFrame([("b", '{"breaths": [1, 2]}')], "run_id string, physiology string")
    blocks = block_rows(spark)
    runs.write(path, blocks, manifests(spark), events(spark), physiology, truth)
    got = {(r["run_id"], r["epoch"]): r for r in runs.read(spark, path).collect()}
    want = {(r["run_id"], r["epoch"]): r for r in blocks.collect()}
    assert set(got) == set(want) and len(got) == 6
    for k, r in want.items():
        assert all(got[k][c] == r[c] for c in ("t_start", "duration", "fs", "channels", "signal", "digest"))
    assert json.loads(got["a", 1]["sidecar"])["truth"] == {"state": "n2"} and "truth" not in json.loads(got["b", 1]["sidecar"])
    assert [json.loads(r["event"])["onset"] for r in runs.read(spark, path, "events").orderBy("run_id", "place").collect()] == [0.5, 2.0]
    assert [tuple(r) for r in runs.read(spark, path, "physiology").collect()] == [("b", '{"breaths": [1, 2]}')]
    assert {r["run_id"]: json.loads(r["manifest"]) for r in runs.read(spark, path, "manifest").collect()} == {"a": {"schemaVersion": epochs.SCHEMA_VERSION, "seed": 7, "fs": 8}, "b": {"schemaVersion": epochs.SCHEMA_VERSION}}
    assert not os.listdir(f"{path}/_attempts") and json.load(open(f"{path}/a/events.json"))["schemaVersion"] == epochs.EVENT_VERSION
    assert sorted(epochs.digests(runs.read(spark, path)).collect()) == sorted(epochs.digests(blocks).collect())
    with pytest.raises(Exception, match="exist already"):
        runs.write(path, blocks, manifests(spark))
    runs.write(path, block_rows(spark, ("a",)), manifests(spark, ("a",)), overwrite=True)
    assert runs.read(spark, path).count() == 6 and runs.read(spark, path, "events").count() == 0


def test_a_failed_job_leaves_no_readable_run(spark, tmp_path):
    path = str(tmp_path / "broken")

    def die(batches):
        import os
        import signal

        for batch in batches:
            if (batch["epoch"] == 2).any():
                os.kill(os.getpid(), signal.SIGKILL)
            yield batch

    blocks = block_rows(spark).repartition(3, "epoch").mapInPandas(die, epochs.BLOCK)
    with pytest.raises(Exception):
        runs.write(path, blocks, manifests(spark))
    for kind in runs.KINDS:
        with pytest.raises(Exception, match="manifest"):
            runs.read(spark, path, kind).count()
    assert not [f for _, _, files in os.walk(path) for f in files]
    runs.write(path, block_rows(spark), manifests(spark))
    assert runs.read(spark, path).count() == 6


def test_a_repeated_task_publishes_once(tmp_path):
    writer = runs.RunWriter(str(tmp_path), False)
    rows = [{"run_id": "r", "kind": runs.EVENT, "place": k, "text": f'{{"n": {k}}}', "signal": None} for k in range(3)] + [{"run_id": "r", "kind": runs.MANIFEST, "place": 0, "text": f'{{"schemaVersion": {epochs.SCHEMA_VERSION}}}', "signal": None}]
    writer.write(iter(rows[:2]))  # a lost executor's half
    done = writer.write(iter(rows))
    assert not (tmp_path / "r").exists()
    writer.commit([done])
    assert [e["n"] for e in json.loads((tmp_path / "r" / "events.json").read_text())["events"]] == [0, 1, 2] and sorted(os.listdir(tmp_path / "r")) == ["events.json", "manifest.json"]
    assert os.listdir(tmp_path / "_attempts") == []


def test_changed_signals_and_odd_names_are_errors(spark, tmp_path):
    path = str(tmp_path / "runs")
    with pytest.raises(Exception, match="without a manifest"):
        runs.write(path, block_rows(spark), manifests(spark, ("a",)))
    with pytest.raises(Exception, match="can't name a run"):
        runs.write(path, block_rows(spark, ("../x",)), manifests(spark, ("../x",)))
    runs.write(path, block_rows(spark), manifests(spark))
    with open(f"{path}/a/epoch_00001/signal.f64", "r+b") as file:
        file.write(b"\x01")
    with pytest.raises(Exception, match="isn't the one"):
        runs.read(spark, path).collect()
    with open(f"{path}/b/manifest.json", "w") as file:
        file.write('{"schemaVersion": 1}')
    with pytest.raises(Exception, match="schema version 1"):
        runs.read(spark, path, "manifest").collect()
