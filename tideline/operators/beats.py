"""Heart beats in long recordings: peaks of the QRS band's energy, and whether their rate follows breathing."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import dsp
from tideline.operators import scans
from tideline.operators.stats import medians
from tideline.sources.written import written

#: Samples of level ground that a peak may have beyond a chunk's end.
LEVEL = 64
_PEAKS = "ch {}, i long, height double, left double, left_done boolean, right double, right_done boolean"
_CHUNKS = "ch {}, chunk long, low double, top double, ahead array<double>, ahead_low array<double>, behind array<double>, behind_low array<double>"


def haloed(samples: DataFrame, size: int, halo: int) -> DataFrame:
    """(ch, chunk, first, xs): chunks with up to `halo` samples (at most `size`) of either neighbour; first is the place of the first of xs."""
    if halo > size:
        raise ValueError("a chunk must be as long as its halo")
    own = F.floor(F.col("i") / size)
    at = F.array_compact(F.array(own, F.when(F.col("i") - own * size < halo, own - 1), F.when((own + 1) * size - F.col("i") <= halo, own + 1)))
    dealt = samples.select("ch", "i", "x", own.alias("own"), F.explode(at).alias("chunk"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    grouped = dealt.groupBy("ch", "chunk").agg(pairs.alias("_p"), F.max(F.col("own") == F.col("chunk")).alias("_real"))
    return grouped.where("_real").select("ch", "chunk", F.col("_p")[0]["i"].alias("first"), F.transform("_p", lambda p: p["x"].cast("double")).alias("xs"))


def smoothed(samples: DataFrame, width: int, size: int = scans.CHUNK) -> DataFrame:
    """(ch, i, x): mean of `width` samples about each, samples beyond the record's ends being 0; of an even width one more lies before."""
    before, after = width // 2, (width - 1) // 2
    kind = samples.schema["ch"].dataType.simpleString()

    def means(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for ch, chunk, first, xs in zip(batch["ch"], batch["chunk"], batch["first"], batch["xs"], strict=True):
                x, lead = np.asarray(xs, float), chunk * size - first
                wide = np.concatenate([np.zeros(before), x, np.zeros(after)])
                own = np.lib.stride_tricks.sliding_window_view(wide, width)[lead : lead + size].sum(1) / width
                yield ch, np.arange(len(own)) + chunk * size, own

    return haloed(samples, size, before + after + 1).mapInPandas(lambda batches: scans.sent(means(batches)), f"ch {kind}, i long, x double")


def _records(values):
    """(records, lows): from the start on every value above all before it, and the smallest value between the record before and it."""
    import numpy as np

    if not len(values):
        return np.zeros(0), np.zeros(0)
    top = np.maximum.accumulate(values)
    at = np.flatnonzero(np.r_[True, values[1:] > top[:-1]])
    lows = [np.inf if a + 1 == b else values[a + 1 : b].min() for a, b in zip(np.r_[-1, at[:-1]], at, strict=True)]
    return values[at], np.array(lows, float)


def _summaries(levels: DataFrame, bounds: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Peaks of chunks of at least the channel's height, with the lowest ground on either side as far as the chunk shows it, and the chunks' outlines."""
    kind = levels.schema["ch"].dataType.simpleString()
    rows = haloed(levels, size, min(size, LEVEL + 1)).join(bounds.select("ch", "height"), "ch")

    def own_part(chunk, first, xs):
        import numpy as np

        x, lead = np.asarray(xs, float), chunk * size - first
        return x, lead, x[lead : lead + size]

    def peaks(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            out = []
            for ch, chunk, first, xs, height in zip(batch["ch"], batch["chunk"], batch["first"], batch["xs"], batch["height"], strict=True):
                x, lead, own = own_part(chunk, first, xs)
                begins = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                ends = np.r_[begins[1:], len(x)] - 1
                v = x[begins]
                high = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= height)) + 1
                for p in ((begins[high] + ends[high]) // 2 - lead).tolist():
                    if 0 <= p < len(own):
                        h = own[p]
                        above, below = np.flatnonzero(own[:p] > h), np.flatnonzero(own[p + 1 :] > h)
                        a, b = (above[-1] + 1 if len(above) else 0), (p + 1 + below[0] if len(below) else len(own))
                        out.append((ch, chunk * size + p, h, own[a : p + 1].min(), len(above) > 0, own[p:b].min(), len(below) > 0))
            yield pd.DataFrame(out, columns=["ch", "i", "height", "left", "left_done", "right", "right_done"])

    def outline(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for ch, chunk, first, xs in zip(batch["ch"], batch["chunk"], batch["first"], batch["xs"], strict=True):
                own = own_part(chunk, first, xs)[2]
                out.append((ch, chunk, own.min(), own.max(), *_records(own), *_records(own[::-1])))
            yield pd.DataFrame(out, columns=["ch", "chunk", "low", "top", "ahead", "ahead_low", "behind", "behind_low"])

    return rows.mapInPandas(peaks, _PEAKS.format(kind)), rows.select("ch", "chunk", "first", "xs").mapInPandas(outline, _CHUNKS.format(kind))


def _carried(peaks: DataFrame, outlines: DataFrame, size: int) -> DataFrame:
    """Peaks whose ground goes on beyond their chunk, with the ground that the outlines of the others show.

    A pass over a channel's outlines keeps a stack of falling heights with the lowest ground between them: what a peak
    can't see over goes. A group has a row a chunk, and few peaks: those that no other of their chunk hides.
    """
    kind = peaks.schema["ch"].dataType.simpleString()

    def side(chunks, wanted, records, lows):
        """Lowest ground on one side of every wanted (place, chunk, height, low so far), chunks in order away from that side's end."""
        out, stack, at = {}, [(math.inf, math.inf)], 0  # heights falling towards the present end, with the lowest ground on each one's near side; first the record's end
        for c in chunks:
            while at < len(wanted) and wanted[at][1] == c["chunk"]:
                place, _, h, low = wanted[at]
                for height, after in reversed(stack):
                    low = min(low, after)
                    if height > h:
                        break
                    low = min(low, height)
                out[place] = low
                at += 1
            # The chunk's own records, seen from its far end, replace what is lower than its top.
            after = c["low"]
            while stack[-1][0] <= c["top"]:
                after = min(after, stack.pop()[1])
            stack[-1] = (stack[-1][0], min(stack[-1][1], after))
            stack += reversed(list(zip(c[records], c[lows], strict=True)))
        return out

    def merge(key, peaks, outlines):
        import pandas as pd

        chunks = outlines.sort_values("chunk").to_dict("records")
        peaks = peaks.sort_values("i").reset_index(drop=True)
        left = [(i, i // size, h, low) for i, h, low, done in zip(peaks["i"], peaks["height"], peaks["left"], peaks["left_done"], strict=True) if not done]
        right = [(i, i // size, h, low) for i, h, low, done in zip(peaks["i"], peaks["height"], peaks["right"], peaks["right_done"], strict=True) if not done]
        lefts, rights = side(chunks, left, "behind", "behind_low"), side(chunks[::-1], right[::-1], "ahead", "ahead_low")
        return pd.DataFrame({"ch": peaks["ch"], "i": peaks["i"], "height": peaks["height"], "left": [lefts.get(i, v) for i, v in zip(peaks["i"], peaks["left"], strict=True)], "right": [rights.get(i, v) for i, v in zip(peaks["i"], peaks["right"], strict=True)]})

    return peaks.groupBy("ch").cogroup(outlines.groupBy("ch")).applyInPandas(merge, f"ch {kind}, i long, height double, left double, right double")


def spaced(peaks: DataFrame, distance: int) -> DataFrame:
    """Peaks (ch, i, height, ...) at least `distance` apart: highest first, each takes away those nearer than that.

    Where no peak is near the one before, a group of its own begins, so only peaks in each other's way meet in a task.
    """
    w = Window.partitionBy("ch").orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(w) < distance, 0).otherwise(1)
    filed = peaks.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    filed = written(filed.withColumn("_lone", (F.col("_new") == 1) & (F.coalesce(F.lead("_new").over(w), F.lit(1)) == 1)).drop("_new"))
    # A peak that none is near stays as it is; it needs no task's Python.
    lone, grouped = filed.where("_lone").drop("_lone", "_group"), filed.where("not _lone").drop("_lone")

    def choose(rows):
        import numpy as np

        rows = rows.sort_values("i")
        at, keep = rows["i"].to_numpy(), np.ones(len(rows), bool)
        for j in np.argsort(rows["height"].to_numpy(), kind="stable")[::-1]:
            if keep[j]:
                near = slice(np.searchsorted(at, at[j] - distance, side="right"), np.searchsorted(at, at[j] + distance, side="left"))
                keep[near] = False
                keep[j] = True
        return rows[keep]

    return lone.unionByName(grouped.groupBy("ch", "_group").applyInPandas(choose, grouped.schema).drop("_group"))


def qrs_peaks(samples: DataFrame, fs: float, low: float = 8.0, high: float = 25.0, order: int = 3, smooth: float = 0.12, apart: float = 0.45, times: float = 8.0, size: int = scans.CHUNK) -> DataFrame:
    """(ch, i, height, prominence): beats in samples (ch, i, x) of whole records.

    The QRS band by a zero-phase Butterworth band-pass, squared and smoothed over `smooth` seconds; of its local maxima (the middle
    of level ones) those of at least median + `times` MAD, then of those nearer than `apart` seconds the highest, then those
    that rise `times` MAD above the higher of the two valleys beside them. A valley reaches to the next higher ground, or the
    record's end. Everything runs in time chunks of any size with the same result; median and MAD are exact. Level ground of
    more than LEVEL samples across a chunk's end is no peak. Records too short for the filter have none.
    """
    band = scans.filtered_whole(samples, dsp.butterworth_bandpass(order, low, high, fs), size)
    energy = written(smoothed(band.withColumn("x", F.col("x") * F.col("x")), max(1, round(smooth * fs)), size))
    centre = medians(energy.select(F.col("ch").alias("key"), "x")).select(F.col("key").alias("ch"), F.col("median").alias("centre"))
    off = energy.join(centre, "ch").select(F.col("ch").alias("key"), F.abs(F.col("x") - F.col("centre")).alias("x"))
    mad = medians(off).select(F.col("key").alias("ch"), F.col("median").alias("mad"))
    bounds = written(centre.join(mad, "ch").select("ch", (F.col("centre") + times * F.col("mad")).alias("height"), (times * F.col("mad")).alias("rise")))
    peaks, outlines = _summaries(energy, bounds, size)
    peaks = written(peaks)
    done = F.col("left_done") & F.col("right_done")
    # In a record of one chunk there is no ground beyond, so only longer ones are carried on.
    long = written(energy.where(F.col("i") >= size).select("ch").distinct())
    if long.limit(1).count():
        open_ = _carried(peaks.where(~done).join(long, "ch", "left_semi"), outlines.join(long, "ch", "left_semi"), size)
        done = done | F.col("_short")
        peaks = peaks.join(long.withColumn("_long", F.lit(True)), "ch", "left").withColumn("_short", F.col("_long").isNull())
        whole = peaks.where(done).select("ch", "i", "height", "left", "right").unionByName(open_)
    else:
        whole = peaks.select("ch", "i", "height", "left", "right")
    kept = spaced(whole.select("ch", "i", "height", (F.col("height") - F.greatest("left", "right")).alias("prominence")), math.ceil(round(apart * fs)))
    return kept.join(bounds.select("ch", "rise"), "ch").where(F.col("prominence") >= F.col("rise")).drop("rise")


def shuffled_phase_null(beats: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(ch, beats, depth, p95, present): how far the rate swings with the breathing phase, and the 95th percentile of that under random phases.

    beats: (ch, i, rate, phase). The mean rate is taken off first; depth is 2 |mean of the rest times e^(i phase)| over it. A
    replicate's phase of a beat is drawn from the hash of (seed, ch, replicate, i), so draws don't depend on partitions
    or retries; every replicate is one group of an aggregate with partial sums, and the percentile is exact.
    """
    mean = beats.groupBy("ch").agg(F.avg("rate").alias("mean"), F.count("*").alias("beats"))
    swing = beats.join(mean, "ch").withColumn("ac", F.col("rate") - F.col("mean"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("ch").cast("string"), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32) * (2 * math.pi)
    each = swing.withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn("at", F.when(F.col("rep") < 0, F.col("phase")).otherwise(drawn))
    depth = 2 * F.hypot(F.avg(F.col("ac") * F.cos("at")), F.avg(F.col("ac") * F.sin("at"))) / F.first("mean")
    got = each.groupBy("ch", "beats", "rep").agg(depth.alias("d"))
    out = got.groupBy("ch", "beats").agg(F.max(F.when(F.col("rep") < 0, F.col("d"))).alias("depth"), F.percentile(F.when(F.col("rep") >= 0, F.col("d")), 0.95).alias("p95"))
    return out.withColumn("present", F.col("depth") > F.col("p95"))
