"""Recursive filters over records of any length: time chunks give affine maps of the filter's state, a scan over them the states to start from.

No row holds more than a chunk. A chunk's end state is T s + e for the state s it starts from; T depends on its length only,
and e is the end state from rest. Maps compose, so blocks of chunks are maps too, and the scan runs over blocks, then inside
them. A second pass over the chunks filters each from its own start state. The way back of a zero-phase filter needs no pass of
its own: its end state is linear in the chunk and in the state that the way forth starts from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.dsp import Cascade
from tideline.sources.written import written

#: Samples of a chunk and chunks of a block of the scan.
CHUNK, FAN = 1 << 16, 4096


def chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(ch, chunk, xs): samples (ch, i, x) in rows of `size` consecutive ones."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    grouped = samples.groupBy("ch", F.floor(F.col("i") / size).alias("chunk")).agg(pairs.alias("_p"))
    return grouped.select("ch", "chunk", F.transform("_p", lambda p: p["x"].cast("double")).alias("xs"))


def framed(samples: DataFrame, size: int, hop: int, frames: int = 256, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """(keys, block, xs): stretches of `frames` whole frames of `size` samples at multiples of `hop`; neighbours share the samples that both need.

    Frame f of a record is the (f % frames)th of block f // frames. A record shorter than a frame is one short stretch.
    """
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - (size - 1)) / hop)), F.floor(F.col("i") / hop)
    spread = samples.withColumns({"_a": first, "_b": last}).where("_a <= _b")
    dealt = spread.select(*keys, "i", "x", F.explode(F.sequence(F.floor(F.col("_a") / frames), F.floor(F.col("_b") / frames))).alias("block"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return dealt.groupBy(*keys, "block").agg(pairs.alias("_p")).select(*keys, "block", F.transform("_p", lambda p: p["x"].cast("double")).alias("xs"))


def sent(records: Iterator, rows: int = 1 << 15) -> Iterator:
    """Frames (ch, i, x) of about so many rows from (ch, places, values) of records or chunks."""
    import numpy as np
    import pandas as pd

    def frame():
        chs, places, values = zip(*own, strict=True)
        return pd.DataFrame({"ch": np.repeat(np.array(chs), [len(i) for i in places]), "i": np.concatenate(places), "x": np.concatenate(values)})

    own, size = [], 0
    for record in records:
        own.append(record)
        size += len(record[1])
        if size >= rows:
            yield frame()
            own, size = [], 0
    if own:
        yield frame()


def _schema(df: DataFrame, rest: str) -> str:
    return f"ch {df.schema['ch'].dataType.simpleString()}, {rest}"


def scan(steps: DataFrame, first: DataFrame, backwards: bool = False, fan: int = FAN) -> DataFrame:
    """(ch, k, s): the state before every step of s -> T s + e.

    steps: (ch, k, t, e), t by rows; first: (ch, s), the state before the first step, or behind the last when backwards. Steps are
    composed in blocks of `fan`, the blocks are passed one after another, and then the steps inside each block, so a group
    holds `fan` steps, or a row for `fan` of them.
    """
    import numpy as np
    import pandas as pd

    kind = _schema(steps, "block long, t array<double>, e array<double>")

    def matrices(frame):
        e = np.stack(frame["e"].to_list())
        return np.stack(frame["t"].to_list()).reshape(len(e), e.shape[1], e.shape[1]), e

    def compose(frame):
        frame = frame.sort_values("k", ascending=not backwards)
        t, e = matrices(frame)
        whole, end = np.eye(e.shape[1]), np.zeros(e.shape[1])
        for a, b in zip(t, e, strict=True):
            whole, end = a @ whole, a @ end + b
        return pd.DataFrame({"ch": frame["ch"].iloc[:1], "block": frame["block"].iloc[:1], "t": [whole.ravel()], "e": [end]})

    def along(frame, start, names):
        frame = frame.sort_values(names[-1], ascending=not backwards)
        t, e = matrices(frame)
        out, s = np.empty_like(e), np.asarray(start, float)
        for n in range(len(e)):
            out[n] = s
            s = t[n] @ s + e[n]
        return pd.DataFrame({n: frame[n] for n in names} | {"s": list(out)})

    def pass_blocks(frame, begun):
        return along(frame, begun["s"].iloc[0] if len(begun) else np.zeros(len(frame["e"].iloc[0])), ["ch", "block"]) if len(frame) else pd.DataFrame({"ch": [], "block": [], "s": []})

    def pass_steps(frame, begun):
        return along(frame, begun["s"].iloc[0], ["ch", "k"])

    filed = steps.withColumn("block", F.floor(F.col("k") / fan))
    blocks = filed.groupBy("ch", "block").applyInPandas(compose, kind)
    begun = blocks.groupBy("ch").cogroup(first.groupBy("ch")).applyInPandas(pass_blocks, _schema(steps, "block long, s array<double>"))
    return filed.groupBy("ch", "block").cogroup(begun.groupBy("ch", "block")).applyInPandas(pass_steps, _schema(steps, "k long, s array<double>"))


@lru_cache(maxsize=64)
def _maps(sections: tuple, n: int):
    """Of a chunk of n samples: the way forth's T, and of the way back T and the end state by the way forth's start state."""
    import numpy as np

    cascade = Cascade(sections)
    forth = np.linalg.matrix_power(cascade.a, n)
    free = cascade.free(n)  # outputs (n x states) that each start state gives by itself
    back = np.stack([cascade.run(free[::-1, j])[1] for j in range(cascade.size)], 1)
    return forth, back


def _filtered_rows(rows: DataFrame, turns: list[tuple], both_ways: bool, settled: bool) -> DataFrame:
    """The same where every record is one chunk: its start state is known, so no scan is needed. Cascades of several turns run one after another in one pass."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        cascades = [Cascade(fixed) for fixed in turns]
        rests = [c.settled() if settled else np.zeros(c.size) for c in cascades]
        for batch in batches:
            out = []
            for xs in batch["xs"]:
                y = np.asarray(xs, float)
                for cascade, rest in zip(cascades, rests, strict=True):
                    for _ in range(1 + both_ways):
                        y = cascade.run(y, rest * y[0])[0]
                        y = y[::-1] if both_ways else y
                out.append(y)
            yield pd.DataFrame({"ch": batch["ch"], "chunk": batch["chunk"], "xs": out})

    return rows.select("ch", "chunk", "xs").mapInPandas(run, _schema(rows, "chunk long, xs array<double>"))


def filtered_chunks(rows: DataFrame, sections: list[tuple], both_ways: bool = False, settled: bool = False) -> DataFrame:
    """(ch, chunk, xs): chunks filtered by a cascade of second-order sections (b0, b1, b2, a1, a2), a1 and a2 after the leading 1.

    both_ways: forth and then back, so without a shift of phase. settled: either way starts in the steady state of its first
    input instead of from rest. The numbers equal those of filtering the whole record at once, up to rounding, whatever the
    chunks' size. Chunks of a channel are numbered without gaps; values that aren't finite spread as they do in a whole record.
    """
    fixed = tuple(tuple(float(c) for c in s) for s in sections)
    if not rows.where("chunk > 0").limit(1).count():
        return _filtered_rows(rows, [fixed], both_ways, settled)
    return _scanned_rows(rows, fixed, both_ways, settled)


def filtered_in_turn(rows: DataFrame, sections: list[tuple], both_ways: bool = False) -> DataFrame:
    """(ch, chunk, xs): chunks filtered by one section after another, each from rest over the whole record, forth and back if both_ways.

    Where records are one chunk all sections run in one pass, in one Python worker a task; else each section's chunks are written, so that none is computed again for the next.
    """
    turns = [(tuple(float(c) for c in s),) for s in sections]
    if not turns:
        return rows.select("ch", "chunk", "xs")
    if not rows.where("chunk > 0").limit(1).count():
        return _filtered_rows(rows, turns, both_ways, False)
    for fixed in turns[:-1]:
        rows = written(_scanned_rows(rows, fixed, both_ways, False))
    return _scanned_rows(rows, turns[-1], both_ways, False)


def _scanned_rows(rows: DataFrame, fixed: tuple, both_ways: bool, settled: bool) -> DataFrame:
    """The same for records of several chunks, by a scan over their maps."""

    def ends(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        cascade = Cascade(fixed)
        for batch in batches:
            out = []
            for xs in batch["xs"]:
                x = np.asarray(xs, float)
                y, e = cascade.run(x)
                forth, cross = _maps(fixed, len(x))
                out.append((len(x), forth.ravel(), e, cascade.run(y[::-1])[1] if both_ways else np.zeros(0), cross.ravel() if both_ways else np.zeros(0), x[0], y[-1], cascade.free(len(x))[-1]))
            yield pd.DataFrame({"ch": batch["ch"], "k": batch["chunk"]} | dict(zip(["n", "t", "e", "back", "cross", "x0", "y1", "free"], map(list, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame(columns=["ch", "k", "n", "t", "e", "back", "cross", "x0", "y1", "free"])

    # A row a chunk, read by both scans; written once, so that the chunks are passed over twice in all.
    steps = written(rows.mapInPandas(ends, _schema(rows, "k long, n long, t array<double>, e array<double>, back array<double>, cross array<double>, x0 double, y1 double, free array<double>")))
    rest = [float(v) for v in Cascade(fixed).settled()] if settled else [0.0] * (2 * len(fixed))
    times = lambda value: F.array(*[F.lit(v) * value for v in rest])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    first = steps.groupBy("ch").agg(F.min_by("x0", "k").alias("x0")).select("ch", times(F.col("x0")).alias("s"))
    starts = scan(steps.select("ch", "k", "t", "e"), first)
    if both_ways:
        size = 2 * len(fixed)
        met = written(steps.join(starts, ["ch", "k"]))
        starts = met.select("ch", "k", "s")
        row = lambda i: F.slice("cross", F.lit(i * size + 1), F.lit(size))
        turned = F.array(*[F.col("back")[i] + dot(row(i), F.col("s")) for i in range(size)])
        last = met.groupBy("ch").agg(F.max_by(F.col("y1") + dot(F.col("free"), F.col("s")), "k").alias("y1")).select("ch", times(F.col("y1")).alias("s"))
        behind = scan(met.select("ch", "k", "t", turned.alias("e")), last, backwards=True)
        starts = starts.join(behind.select("ch", "k", F.col("s").alias("s2")), ["ch", "k"])
    else:
        starts = starts.withColumn("s2", F.array().cast("array<double>"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        cascade = Cascade(fixed)
        for batch in batches:
            out = []
            for xs, s, s2 in zip(batch["xs"], batch["s"], batch["s2"], strict=True):
                y, _ = cascade.run(np.asarray(xs, float), np.asarray(s, float))
                out.append(cascade.run(y[::-1], np.asarray(s2, float))[0][::-1] if both_ways else y)
            yield pd.DataFrame({"ch": batch["ch"], "chunk": batch["chunk"], "xs": out})

    met = rows.join(starts.withColumnRenamed("k", "chunk"), ["ch", "chunk"])
    return met.select("ch", "chunk", "xs", "s", "s2").mapInPandas(run, _schema(rows, "chunk long, xs array<double>"))


def unchunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(ch, i, x) of chunks."""
    return rows.select("ch", "chunk", F.posexplode("xs").alias("k", "x")).select("ch", (F.col("chunk") * size + F.col("k")).alias("i"), "x")


def filtered(samples: DataFrame, sections: list[tuple], both_ways: bool = False, size: int = CHUNK) -> DataFrame:
    """Samples (ch, i, x), i from 0 without gaps, filtered from rest: once, or forth and back."""
    return unchunked(filtered_chunks(chunks(samples, size), sections, both_ways), size)


def reflected(samples: DataFrame, edge: int) -> DataFrame:
    """Samples with `edge` more on either side, the record's ends turned about its first and last sample; i counts from the first of them.

    Channels of `edge` samples or fewer can't be reflected and are left out.
    """
    known = samples.groupBy("ch").agg(F.count("*").alias("_n"), F.min_by("x", "i").alias("_a"), F.max_by("x", "i").alias("_b")).where(F.col("_n") > edge)
    near = samples.join(known, "ch")
    left = near.where((F.col("i") >= 1) & (F.col("i") <= edge)).select("ch", (edge - F.col("i")).alias("i"), (2 * F.col("_a") - F.col("x")).alias("x"))
    right = near.where((F.col("i") >= F.col("_n") - 1 - edge) & (F.col("i") <= F.col("_n") - 2)).select("ch", (edge + 2 * (F.col("_n") - 1) - F.col("i")).alias("i"), (2 * F.col("_b") - F.col("x")).alias("x"))
    return near.select("ch", (F.col("i") + edge).alias("i"), "x").unionByName(left).unionByName(right)


def filtered_whole(samples: DataFrame, sections: list[tuple], size: int = CHUNK) -> DataFrame:
    """Zero-phase filtering of whole records with reflected ends and settled starts, as of a continuous recording before any epoch is cut.

    Records of no more samples than are reflected (3 (2 sections + 1)) give no row.
    """
    edge = 3 * (2 * len(sections) + 1)
    longer = reflected(samples, edge)
    out = unchunked(filtered_chunks(chunks(longer, size), sections, both_ways=True, settled=True), size)
    n = samples.groupBy("ch").agg(F.count("*").alias("_n"))
    return out.select("ch", (F.col("i") - edge).alias("i"), "x").join(n, "ch").where((F.col("i") >= 0) & (F.col("i") < F.col("_n"))).select("ch", "i", "x")
