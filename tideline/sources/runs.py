"""Run folders as a Spark data source: epochs with sidecars, event list, physiology, and the manifest, which is published last.

    run_id/manifest.json   run_id/events.json   run_id/physiology.json   run_id/epoch_00000/{signal.f64, sidecar.json}

Tasks write below `_attempts`; only when all have succeeded are their files moved to the runs' folders, and after them the
manifests. A failed job, or a task that was repeated, leaves no readable run: readers look for manifests.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tideline.sources.edf import _store
from tideline.sources.epochs import EVENT_VERSION, SCHEMA_VERSION, signal_from

#: What a row of the sink is, and the columns it has; place orders a run's epochs and events.
EPOCH, EVENT, PHYSIOLOGY, MANIFEST = range(4)
SINK = "run_id string, kind int, place long, text string, signal binary"
EPOCHS = "run_id string, epoch int, t_start double, duration double, fs double, channels array<string>, signal binary, digest string, sidecar string"
KINDS = {"epochs": EPOCHS, "events": "run_id string, place int, event string", "physiology": "run_id string, physiology string", "manifest": "run_id string, manifest string"}


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: list[tuple[str, str]]  # (run, name) of files and folders that are ready
    manifests: list[tuple[str, str]]


@dataclass
class OneRun(InputPartition):
    run: str
    epochs: tuple[str, ...] = ()


class RunSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epoch_run"

    def schema(self) -> str:
        kind = self.options.get("kind", "epochs")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        return KINDS[kind]

    def reader(self, schema) -> RunReader:
        return RunReader(self.options["path"], self.options.get("kind", "epochs"))

    def writer(self, schema, overwrite: bool) -> RunWriter:
        if [f.name for f in schema.fields] != [c.split()[0] for c in SINK.split(", ")]:
            raise ValueError(f"rows of a run must have the columns {SINK}")
        return RunWriter(self.options["path"], overwrite)


class RunWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        """One task: epochs as they come; an event list is written event by event, so none is held whole."""
        attempt = f"_attempts/{self.job}/{uuid.uuid4().hex}"
        store, at = _store(self.path)
        files, manifests, events = [], [], None

        def put(run: str, name: str, raw: bytes) -> None:
            folder = f"{at}/{attempt}/{run}/{name}".rsplit("/", 1)[0]
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{at}/{attempt}/{run}/{name}") as out:
                out.write(raw)

        def end_events() -> None:
            if events is not None:
                events[1].write(b"]}\n")
                events[1].close()

        for r in rows:
            if not r["run_id"] or "/" in r["run_id"] or r["run_id"].startswith("_"):
                raise ValueError(f"{r['run_id']!r} can't name a run")
            if events is not None and (r["kind"] != EVENT or r["run_id"] != events[0]):
                end_events()
                events = None
            if r["kind"] == EPOCH:
                name = f"epoch_{r['place']:05d}"
                put(r["run_id"], f"{name}/signal.f64", bytes(r["signal"]))
                put(r["run_id"], f"{name}/sidecar.json", r["text"].encode())
                files.append((r["run_id"], name))
            elif r["kind"] == EVENT:
                if events is None:
                    store.create_dir(f"{at}/{attempt}/{r['run_id']}", recursive=True)
                    events = (r["run_id"], store.open_output_stream(f"{at}/{attempt}/{r['run_id']}/events.json"))
                    events[1].write(f'{{"schemaVersion": {EVENT_VERSION}, "events": ['.encode() + b"\n")
                    files.append((r["run_id"], "events.json"))
                else:
                    events[1].write(b",\n")
                events[1].write(r["text"].encode())
            elif r["kind"] == PHYSIOLOGY:
                put(r["run_id"], "physiology.json", r["text"].encode())
                files.append((r["run_id"], "physiology.json"))
            else:
                manifests.append((r["run_id"], r["text"]))
        end_events()
        return Written(attempt, files, manifests)

    def commit(self, messages) -> None:
        """Publishes what the tasks have written: files first, manifests last."""
        from pyarrow import fs

        store, at = _store(self.path)
        done = [m for m in messages if m is not None]
        manifests = dict(x for m in done for x in m.manifests)
        bare = sorted({run for m in done for run, _ in m.files} - set(manifests))
        try:
            if bare:
                raise ValueError(f"runs without a manifest: {', '.join(bare[:5])}")
            there = [r for r in manifests if store.get_file_info(f"{at}/{r}").type != fs.FileType.NotFound]
            if there and not self.overwrite:
                raise ValueError(f"runs that exist already: {', '.join(sorted(there)[:5])}")
            for run in there:
                store.delete_dir(f"{at}/{run}")
            for run in manifests:
                store.create_dir(f"{at}/{run}", recursive=True)
            for m in done:
                for run, name in m.files:
                    store.move(f"{at}/{m.attempt}/{run}/{name}", f"{at}/{run}/{name}")
            for run, text in manifests.items():
                with store.open_output_stream(f"{at}/{run}/manifest.json") as out:
                    out.write(text.encode())
        finally:
            self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        if store.get_file_info(f"{at}/_attempts/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_attempts/{self.job}")


class RunReader(DataSourceReader):
    #: Epochs that a partition reads.
    EACH = 64

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.rstrip("/"), kind

    def partitions(self) -> list[OneRun]:
        from pyarrow import fs

        store, at = _store(self.path)
        inside = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        runs = sorted(i.base_name for i in inside if i.type == fs.FileType.Directory and not i.base_name.startswith("_"))
        runs = [r for r in runs if store.get_file_info(f"{at}/{r}/manifest.json").type == fs.FileType.File]
        if not runs:
            raise FileNotFoundError(f"no run with a manifest.json in {self.path}")
        if self.kind != "epochs":
            return [OneRun(r) for r in runs]
        out = []
        for r in runs:
            names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(f"{at}/{r}")) if i.base_name.startswith("epoch_"))
            out += [OneRun(r, tuple(names[k : k + self.EACH])) for k in range(0, len(names), self.EACH)]
        return out or [OneRun(runs[0])]

    def read(self, partition: OneRun):
        import hashlib

        from pyarrow import fs

        store, at = _store(self.path)
        root = f"{at}/{partition.run}"

        def text(name: str, empty: str | None = None) -> str:
            if empty is not None and store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                return empty
            with store.open_input_stream(f"{root}/{name}") as file:
                return file.read().decode()

        if self.kind == "manifest":
            found = text("manifest.json")
            if json.loads(found).get("schemaVersion") != SCHEMA_VERSION:
                raise ValueError(f"{partition.run}: schema version {json.loads(found).get('schemaVersion')} can't be read")
            yield partition.run, found
        elif self.kind == "events":
            for place, event in enumerate(json.loads(text("events.json", '{"events": []}'))["events"]):
                yield partition.run, place, json.dumps(event, sort_keys=True)
        elif self.kind == "physiology":
            found = text("physiology.json", "")
            if found:
                yield partition.run, found
        else:
            for name in partition.epochs:
                side = text(f"{name}/sidecar.json")
                s = json.loads(side)
                with store.open_input_stream(f"{root}/{name}/signal.f64") as file:
                    raw = file.read()
                signal_from(raw, len(s["channels"]), round(s["duration"] * s["fs"]))
                if hashlib.sha256(raw).hexdigest() != s["digest"]:
                    raise ValueError(f"{partition.run}/{name}: the signal isn't the one that was written")
                yield partition.run, s["epochIndex"], s["tStart"], s["duration"], s["fs"], s["channels"], raw, s["digest"], side


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunSource)


def write(path: str, blocks: DataFrame, manifests: DataFrame, events: DataFrame | None = None, physiology: DataFrame | None = None, truth: DataFrame | None = None, overwrite: bool = False) -> None:
    """Writes runs: blocks as `epochs.blocks` makes them; manifests (run_id, manifest), events (run_id, onset, event) and physiology (run_id,
    physiology) with JSON texts; truth (run_id, epoch, truth), JSON that goes into the epochs' sidecars.

    Epochs are dealt by run and epoch, so a long run spreads over tasks; a run's events go to one task in order of onset. A run that
    exists is an error unless `overwrite`.
    """
    register(blocks.sparkSession)
    own = {"epochIndex": "epoch", "tStart": "t_start", "duration": "duration", "fs": "fs", "channels": "channels", "digest": "digest"}
    sided = blocks if truth is None else blocks.join(truth.select("run_id", "epoch", "truth"), ["run_id", "epoch"], "left")
    more = F.lit(None).cast("string") if truth is None else F.col("truth")
    side = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in own.items()]))
    joined = F.when(more.isNull(), side).otherwise(F.concat(F.substring(side, F.lit(1), F.length(side) - 1), F.lit(',"truth":'), more, F.lit("}")))
    no_signal, version = F.lit(None).cast("binary").alias("signal"), F.lit(f'{{"schemaVersion": {SCHEMA_VERSION}')
    rest = F.regexp_replace(F.regexp_replace("manifest", r"^\s*\{\s*", ""), r"^\}\s*$", "}")
    parts = [sided.select("run_id", F.lit(EPOCH).alias("kind"), F.col("epoch").cast("bigint").alias("place"), joined.alias("text"), "signal"), manifests.select("run_id", F.lit(MANIFEST), F.lit(0).cast("bigint"), F.concat(version, F.when(rest.startswith("}"), "").otherwise(", "), rest), no_signal)]
    if events is not None:
        from pyspark.sql.window import Window

        place = F.row_number().over(Window.partitionBy("run_id").orderBy("onset", "event")).cast("bigint")
        parts.append(events.select("run_id", F.lit(EVENT), place, "event", no_signal))
    if physiology is not None:
        parts.append(physiology.select("run_id", F.lit(PHYSIOLOGY), F.lit(0).cast("bigint"), "physiology", no_signal))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    dealt = rows.repartition("run_id", F.when(F.col("kind") == EPOCH, F.col("place")).otherwise(-1 - F.col("kind")))
    dealt.sortWithinPartitions("run_id", "kind", "place").write.format("epoch_run").mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, kind: str = "epochs") -> DataFrame:
    """Epochs, events, physiology or manifests of the runs in a folder. Without any manifest that is an error; a run without an event list or
    physiology has no rows of them. Signals are held against the digests in their sidecars."""
    register(spark)
    return spark.read.format("epoch_run").option("kind", kind).load(path)
