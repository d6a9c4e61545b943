"""EDF and EDF+ recordings as a Spark data source: a row a data record, an array a signal; annotations as intervals.

```python
edf.register(spark)
spark.read.format("edf").load("night.edf")                                                  # file, record, t and every signal
spark.read.format("edf").option("signals", "EEG F4-M1,ECG").load("/recordings")             # only these signals' bytes are read
spark.read.format("edf").option("kind", "annotations").load("night_scoring.edf")            # file, onset, duration, description
```

The schema comes from the headers alone. Partitions are ranges of data records; conditions on `record` skip the others, and
conditions on `t` do so where records follow each other without gaps. A folder is read file by file; its files must have the
signals that are asked for.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

#: Bytes that a partition spans, and records of a batch.
SPAN, BATCH = 32 << 20, 256
#: The signal that holds EDF+ annotations, and its signs between onset, duration and text (fixed values of the format).
ANNOTATIONS, DURATION, TEXT = "EDF Annotations", b"\x15", b"\x14"
#: Microvolts of a unit; other dimensions stay as they are.
MICROVOLTS = {"V": 1e6, "mV": 1e3, "uV": 1.0, "µV": 1.0, "nV": 1e-3}
#: Widths of the fields of the fixed header and of each signal (fixed values of the format).
FIXED = [("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4)]
OF_SIGNAL = [("label", 16), ("transducer", 80), ("dimension", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32)]


@dataclass(frozen=True)
class Signal:
    label: str
    dimension: str
    physical_min: float
    physical_max: float
    digital_min: int
    digital_max: int
    samples: int
    offset: int  # bytes from a record's start

    def scaled(self, digital, microvolts: bool = True):
        """Physical values of digital ones; voltages in microvolts if asked for."""
        gain = (self.physical_max - self.physical_min) / (self.digital_max - self.digital_min)
        return ((digital - self.digital_min) * gain + self.physical_min) * (MICROVOLTS.get(self.dimension, 1.0) if microvolts else 1.0)


@dataclass(frozen=True)
class Header:
    bytes: int
    records: int
    duration: float
    record_bytes: int
    gaps: bool
    signals: tuple[Signal, ...]

    def signal(self, label: str) -> Signal:
        return next(s for s in self.signals if s.label == label)


def header(raw: bytes, size: int | None = None) -> Header:
    """Reads a header. A number of records of -1, as an unfinished recording has it, is taken from the file's size."""
    at, fixed = 0, {}
    if len(raw) < 256:
        raise ValueError("too short for an EDF header")
    for name, n in FIXED:
        fixed[name], at = raw[at : at + n].decode("latin-1").strip(), at + n
    if fixed["version"] != "0":
        raise ValueError(f"not an EDF file: version {fixed['version']!r}")
    n = int(fixed["signals"])
    if len(raw) < 256 * (n + 1):
        raise ValueError("the header ends before its signals")
    columns: dict = {}
    for name, width in OF_SIGNAL:
        columns[name] = [raw[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    signals, offset = [], 0
    for i in range(n):
        c = {name: values[i] for name, values in columns.items()}
        one = Signal(c["label"], c["dimension"], float(c["physical_min"]), float(c["physical_max"]), int(c["digital_min"]), int(c["digital_max"]), int(c["samples"]), offset)
        if one.digital_max == one.digital_min:
            raise ValueError(f"signal {one.label!r} has no digital range")
        signals.append(one)
        offset += 2 * one.samples
    begins, records = int(fixed["bytes"]), int(fixed["records"])
    if records < 0 and size is not None:
        records = (size - begins) // max(1, offset)
    if size is not None and size < begins + records * offset:
        raise ValueError(f"the file ends before its {records} records")
    return Header(begins, records, float(fixed["duration"]), offset, fixed["reserved"].startswith("EDF+D"), tuple(signals))


def _store(path: str):
    """The file system that holds a path, and the path there."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The file itself, or the folder's .edf files in order."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    inside = [i.path for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(".edf")]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if not inside:
        raise FileNotFoundError(f"no .edf files in {path}")
    return sorted(prefix + i for i in inside)


def header_of(path: str) -> Header:
    store, at = _store(path)
    with store.open_input_file(at) as file:
        first = file.read_at(256, 0)
        return header(file.read_at(256 * (int(first[252:256] or b"0") + 1), 0) if len(first) == 256 else first, file.size())


def annotations_of(raw: bytes) -> tuple[float | None, list[tuple[float, float, str]]]:
    """A record's time, if it has one, and its annotations (onset, duration, text) from the bytes of the annotation signal."""
    time, found = None, []
    for block in raw.split(b"\x00"):
        if not block or TEXT not in block:
            continue
        when, *texts = block.split(TEXT)
        onset, _, duration = when.partition(DURATION)
        if time is None:
            time = float(onset)
        found += [(float(onset), float(duration or 0), t.decode("utf-8", "replace")) for t in texts if t]
    return time, found


@dataclass
class Records(InputPartition):
    path: str
    first: int
    last: int  # exclusive


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def _asked(self, head: Header, path: str) -> list[str]:
        present = [s.label for s in head.signals if s.label != ANNOTATIONS]
        asked = [s.strip() for s in self.options.get("signals", "").split(",") if s.strip()]
        missing = [s for s in asked if s not in present]
        if missing:
            raise ValueError(f"{path}: no signal named {', '.join(missing)} among {', '.join(present)}")
        return asked or list(dict.fromkeys(present))

    def schema(self) -> str:
        if self.options.get("kind", "records") == "annotations":
            return "file string, onset double, duration double, description string"
        path = files_of(self.options["path"])[0]
        names = ["`" + s.replace("`", "``") + "` array<double>" for s in self._asked(header_of(path), path)]
        return ", ".join(["file string", "record long", "t double", *names])

    def reader(self, schema) -> EdfReader:
        return EdfReader(self, schema)


class EdfReader(DataSourceReader):
    def __init__(self, source: EdfSource, schema):
        self.kind, self.path = source.options.get("kind", "records"), source.options["path"]
        self.microvolts = source.options.get("microvolts", "true").lower() == "true"
        self.span = int(source.options.get("span", SPAN))
        self.names = [f.name for f in schema.fields[3:]] if self.kind == "records" else []
        self.asked = source._asked
        self.low, self.high = {"record": -math.inf, "t": -math.inf}, {"record": math.inf, "t": math.inf}

    def pushFilters(self, filters: list[Filter]):
        """Bounds on record and t narrow what is read; Spark still applies all conditions to the rows."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if name in self.low and isinstance(f.value, int | float):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[name] = max(self.low[name], f.value)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[name] = min(self.high[name], f.value)
            yield f

    def partitions(self) -> list[Records]:
        out = []
        for path in files_of(self.path):
            head = header_of(path)
            if self.kind == "records":
                self.asked(head, path)
                for name in self.names:
                    if name not in [s.label for s in head.signals]:
                        raise ValueError(f"{path}: no signal named {name}")
            first, last = max(0.0, self.low["record"]), min(head.records - 1.0, self.high["record"])
            if not head.gaps and head.duration > 0:
                first, last = max(first, self.low["t"] / head.duration), min(last, self.high["t"] / head.duration)
            step = max(1, self.span // max(1, head.record_bytes))
            begin, end = (math.ceil(first - 1e-9), math.floor(last + 1e-9) + 1) if first <= last + 1 else (0, 0)
            out += [Records(path, a, min(end, a + step)) for a in range(begin, end, step)]
        return out or [Records("", 0, 0)]

    def read(self, partition: Records):
        if partition.first < partition.last:
            store, at = _store(partition.path)
            head = header_of(partition.path)
            with store.open_input_file(at) as file:
                yield from self._annotations(file, head, partition) if self.kind == "annotations" else self._records(file, head, partition)

    def _pieces(self, head: Header, names: list[str]) -> list[tuple[int, int]]:
        """Runs of a record's bytes that hold these signals, neighbours joined."""
        out: list[list[int]] = []
        for s in sorted((head.signal(n) for n in dict.fromkeys(names)), key=lambda s: s.offset):
            if out and out[-1][1] == s.offset:
                out[-1][1] += 2 * s.samples
            else:
                out.append([s.offset, s.offset + 2 * s.samples])
        return [(a, b) for a, b in out]

    def _bytes(self, file, head: Header, names: list[str], first: int, last: int) -> dict:
        """Digital values of the signals, records x samples; where they fill the records, these are read at once."""
        import numpy as np

        begin, n, raw = head.bytes + first * head.record_bytes, last - first, {}
        pieces = self._pieces(head, names)
        if pieces == [(0, head.record_bytes)]:
            raw[pieces[0]] = np.frombuffer(file.read_at(n * head.record_bytes, begin), np.uint8).reshape(n, -1)
        else:
            for a, b in pieces:
                raw[a, b] = np.frombuffer(b"".join(file.read_at(b - a, begin + r * head.record_bytes + a) for r in range(n)), np.uint8).reshape(n, -1)
        out = {}
        for name in names:
            s = head.signal(name)
            (a, _), block = next((p, v) for p, v in raw.items() if p[0] <= s.offset < p[1] or (s.samples == 0 and p[0] == s.offset))
            out[name] = np.ascontiguousarray(block[:, s.offset - a : s.offset - a + 2 * s.samples])
        return out

    def _records(self, file, head: Header, part: Records):
        import numpy as np
        import pyarrow as pa

        times = [ANNOTATIONS] if head.gaps else []
        for first in range(part.first, part.last, BATCH):
            last = min(part.last, first + BATCH)
            raw = self._bytes(file, head, [*self.names, *times], first, last) if self.names or times else {}
            number = np.arange(first, last, dtype=np.int64)
            t = np.array([annotations_of(r.tobytes())[0] for r in raw[ANNOTATIONS]], float) if head.gaps else number * head.duration
            columns = [pa.array([part.path] * len(number)), pa.array(number), pa.array(t)]
            for name in self.names:
                s = head.signal(name)
                values = s.scaled(raw[name].view("<i2").astype(float), self.microvolts)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * s.samples), pa.array(values.ravel())))
            yield pa.RecordBatch.from_arrays(columns, names=["file", "record", "t", *self.names])

    def _annotations(self, file, head: Header, part: Records):
        import pyarrow as pa

        if ANNOTATIONS not in [s.label for s in head.signals]:
            return
        for first in range(part.first, part.last, BATCH):
            raw = self._bytes(file, head, [ANNOTATIONS], first, min(part.last, first + BATCH))[ANNOTATIONS]
            rows = [a for r in raw for a in annotations_of(r.tobytes())[1]]
            if rows:
                onset, duration, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(onset, pa.float64()), pa.array(duration, pa.float64()), pa.array(text)], names=["file", "onset", "duration", "description"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with conditions passed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)


def recording(spark: SparkSession, path: str, signals: list[str] | None = None) -> DataFrame:
    """Recordings as rows of records; a file without one of the signals is an error that names it."""
    register(spark)
    read = spark.read.format("edf")
    return (read.option("signals", ",".join(signals)) if signals else read).load(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("edf").option("kind", "annotations").load(path)


def samples(records: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """Records as samples (file, channel, i, x). i counts a signal's own samples from the file's start."""
    names = signals or [c for c in records.columns if c not in ("file", "record", "t")]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), quoted(c).alias("xs")) for c in names])).alias("s")
    rows = records.select("file", "record", each).select("file", "record", "s.*")
    return rows.select("file", "channel", "record", F.size("xs").alias("n"), F.posexplode("xs").alias("k", "x")).select("file", "channel", (F.col("record") * F.col("n") + F.col("k")).alias("i"), "x")


def epochs(annotated: DataFrame, stages: dict[str, str], fs: float, seconds: float = 30.0, most: int | None = None) -> DataFrame:
    """Whole epochs inside annotations (file, onset, duration, description): (file, state, epoch, first sample, samples).

    An annotation whose text is no stage gives none; a state's epochs are numbered in order, and those from `most` on left out.
    """
    state = F.element_at(F.create_map(*[F.lit(x) for pair in stages.items() for x in pair]), F.col("description"))
    n = round(seconds * fs)
    spans = annotated.select("file", state.alias("state"), "onset", F.floor(F.floor("duration") / seconds).cast("int").alias("whole")).where("state is not null and whole > 0")
    each = spans.select("file", "state", "onset", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("k")).select("file", "state", (F.col("onset") + F.col("k") * seconds).alias("at"))
    order = F.row_number().over(Window.partitionBy("file", "state").orderBy("at")) - 1
    found = each.select("file", "state", order.alias("epoch"), F.rint(F.col("at") * fs).cast("bigint").alias("first"), F.lit(n).cast("bigint").alias("samples")).where("first >= 0")
    return found.where(F.col("epoch") < most) if most is not None else found


def cut(signal: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Samples (file, channel, i, x) inside epochs of `size` samples: (file, state, epoch, channel, k, x), k counting from the epoch's first.

    Both sides are filed under bins of an epoch's length, of which an epoch touches two at most, and meet by equality.
    """
    bins = F.array_distinct(F.array(F.floor(F.col("first") / size), F.floor((F.col("first") + size - 1) / size)))
    filed = spans.select("file", "state", "epoch", "first", F.explode(bins).alias("bin"))
    met = signal.withColumn("bin", F.floor(F.col("i") / size)).join(filed, ["file", "bin"])
    return met.where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("first") + size)).select("file", "state", "epoch", "channel", (F.col("i") - F.col("first")).alias("k"), "x")
