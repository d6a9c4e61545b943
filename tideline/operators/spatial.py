"""How alike many channels are in a band: covariance of their spectra by blocks, its effective rank and typical correlation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.sources.written import written

#: Channels of a block and bins of a group.
BLOCK, BINS = 128, 4096
#: Channels of a block at most, where spectra are short; its rows that are judged at once; and buckets that likeness is counted in.
WIDE, STRIPE, BUCKETS = 2048, 256, 1 << 16


def band_covariance(spectra: DataFrame, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(a, b, c), a <= b: sums over bins of re re + im im, the real part of the cross-spectrum, of spectra (ch, k, re, im).

    Channels are dealt to blocks and bins to groups; a task has two blocks' bins of one group and gives their products, and an
    aggregate adds them up. A bin that a channel lacks counts as zero.
    """
    import numpy as np
    import pandas as pd

    count = max(1, -(-spectra.select("ch").distinct().count() // block))
    own = F.pmod(F.xxhash64("ch"), F.lit(count)).cast("int")
    filed = spectra.select("ch", F.col("k").cast("bigint").alias("k"), "re", "im", own.alias("own"), F.floor(F.col("k") / bins).alias("part"))
    dealt = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("ch", "k", "re", "im", "own", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind = spectra.schema["ch"].dataType.simpleString()

    def product(group):
        def matrix(rows):
            names = np.unique(rows["ch"].to_numpy())
            m = np.zeros((len(names), len(ks)), complex)
            np.add.at(m, (np.searchsorted(names, rows["ch"].to_numpy()), np.searchsorted(ks, rows["k"].to_numpy())), rows["re"].to_numpy() + 1j * rows["im"].to_numpy())
            return names, np.concatenate([m.real, m.imag], 1)

        ks = np.unique(group["k"].to_numpy())
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        left, x = matrix(group[group["own"] == lo])
        right, y = matrix(group[group["own"] == hi])
        c = x @ y.T
        i, j = np.nonzero(left[:, None] <= right[None]) if lo == hi else np.indices(c.shape).reshape(2, -1)
        a, b = left[i], right[j]
        return pd.DataFrame({"a": np.where(a <= b, a, b), "b": np.where(a <= b, b, a), "c": c[i, j]})

    return dealt.groupBy("lo", "hi", "part").applyInPandas(product, f"a {kind}, b {kind}, c double").groupBy("a", "b").agg(F.sum("c").alias("c"))


def _packed(spectra: DataFrame, block: int | None, bins: int) -> tuple[DataFrame, int]:
    """(ch, own, part, ks, re, im): a channel's bins of one group in a row, written; and the number of blocks, of more channels where spectra are short."""
    at = F.floor(F.col("k").cast("bigint") / bins)
    rows = written(spectra.groupBy("ch", at.alias("part")).agg(F.collect_list(F.struct(F.col("k").cast("bigint").alias("k"), "re", "im")).alias("_b")))
    size = rows.agg(F.count_distinct("ch").alias("n"), F.coalesce(F.max(F.size("_b")), F.lit(0)).alias("most")).first()
    count = max(1, -(-size["n"] // (block or min(WIDE, max(BLOCK, BLOCK * BINS // max(1, size["most"]))))))
    own = F.pmod(F.xxhash64("ch"), F.lit(count)).cast("int")
    return rows.select("ch", own.alias("own"), "part", *[F.col(f"_b.{n}").alias(f"{n}s") for n in ("k", "re", "im")]), count


def _each_likeness(rows: DataFrame, count: int, kernel, schema: str) -> DataFrame:
    """kernel(blocks) over (c, own, left, right) of two blocks at a time: stripes of covariances, whether both blocks are one, and the powers of both sides.

    A pair of blocks is read group of bins by group of bins and added up in its task, so neither the length of spectra nor the
    number of channels makes a task larger, and no pair leaves it.
    """
    import numpy as np

    def spread(rows):
        """Channels in order, and the bins that any of them has."""
        names = sorted({r[0] for r in rows}, key=lambda c: (c is None, c))
        ks = np.concatenate([r[2] for r in rows])
        return {c: i for i, c in enumerate(names)}, np.unique(ks)

    def filled(rows, places, ks):
        """Matrix of channels by bins, real and imaginary parts side by side."""
        shape = len(places), len(ks)
        if not rows:
            return np.zeros((shape[0], 2 * shape[1]))
        at = np.repeat([places[r[0]] for r in rows], [len(r[2]) for r in rows]) * shape[1] + np.searchsorted(ks, np.concatenate([r[2] for r in rows]))
        return np.concatenate([np.bincount(at, np.concatenate([r[n] for r in rows]), shape[0] * shape[1]).reshape(shape) for n in (3, 4)], 1)

    def blocks(batches: Iterator) -> Iterator:
        """(lo, hi, groups) with groups of rows of one part each, in order."""
        at, rows = None, []
        for batch in batches:
            columns = [batch[c].tolist() for c in ("lo", "hi", "part", "ch", "own")] + [batch[c] for c in ("ks", "res", "ims")]
            for lo, hi, part, ch, own, ks, re, im in zip(*columns, strict=True):
                if at != (lo, hi, part):
                    if rows:
                        yield *at, rows
                    at, rows = (lo, hi, part), []
                rows.append((ch, own, ks, re.astype(float), im.astype(float)))
        if rows:
            yield *at, rows

    def products(batches: Iterator) -> Iterator:
        for (lo, hi), parts in groupby(blocks(batches), key=lambda b: b[:2]):
            # Channels' places are kept from part to part: one that comes later has no bins before.
            places, c, power = ({}, {}), np.zeros((0, 0)), (np.zeros(0), np.zeros(0))
            for _, _, _, rows in parts:
                names, ks = spread(rows)
                sides = [[r for r in rows if r[1] == b] for b in (lo, hi)]
                for side, own in zip(places, sides, strict=True):
                    for ch in sorted({r[0] for r in own}, key=names.get):
                        side.setdefault(ch, len(side))
                x, y = (filled(own, side, ks) for own, side in zip(sides, places, strict=True))
                grown = [np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))]
                grown[0][: c.shape[0], : c.shape[1]] = c
                grown[1][: len(power[0])], grown[2][: len(power[1])] = power
                c, power = grown[0], (grown[1] + (x * x).sum(1), grown[2] + (y * y).sum(1))
                c += x @ y.T
            yield c, lo == hi, *power

    def run(batches: Iterator) -> Iterator:
        return kernel(products(batches))

    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "part", "ch", "own", "ks", "res", "ims")
    return sent.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "part", "ch").mapInPandas(run, schema)


def _likeness(c, same: bool, left, right) -> Iterator:
    """(covariances, |c_ab| / sqrt(c_aa c_bb) where there is one) of pairs of different channels, some rows of a block at a time."""
    import numpy as np

    for i in range(0, len(c), STRIPE):
        own = c[i : i + STRIPE]
        level = left[i : i + STRIPE, None] * right
        if same:
            upper = np.arange(c.shape[1]) > np.arange(i, i + len(own))[:, None]
            own, level = own[upper], level[upper]
        own, level = own.ravel(), level.ravel()
        some = level > 0
        v = np.abs(own[some]) / np.sqrt(level[some])
        yield own, v[np.isfinite(v)]


def spatial_summary(spectra: DataFrame, block: int | None = None, bins: int = BINS) -> DataFrame:
    """One row (channels, rank, correlation): (trace C)^2 / |C|^2 and the median of |c_ab| / sqrt(c_aa c_bb) over pairs a < b.

    Pairs are never written nor shuffled: every pass forms them in its tasks, block against block, and keeps sums and counts in BUCKETS.
    The first pass counts likeness between 0 and 1, later ones what lies in the bucket of the median, between its least and
    largest value, until one value is left on either side of the middle: the median is exact. Pairs with a silent channel have no correlation.
    """
    import numpy as np
    import pandas as pd

    rows, count = _packed(spectra, block, bins)

    def first_pass(products) -> Iterator:
        counts, square, trace, channels = np.zeros(BUCKETS, np.int64), 0.0, 0.0, 0
        for c, same, left, right in products:
            if same:
                channels, trace, square = channels + len(left), trace + left.sum(), square + (left * left).sum()
            for own, v in _likeness(c, same, left, right):
                square += 2 * (own * own).sum()
                counts += np.bincount(np.minimum((v * BUCKETS).astype(np.int64), BUCKETS - 1), minlength=BUCKETS)
        b = np.flatnonzero(counts)
        yield pd.DataFrame({"b": np.r_[-1, b], "n": np.r_[channels, counts[b]], "trace": np.r_[trace, np.zeros(len(b))], "square": np.r_[square, np.zeros(len(b))]})

    def next_pass(lo: float, hi: float):
        def run(products) -> Iterator:
            counts, least, largest = np.zeros(BUCKETS, np.int64), np.full(BUCKETS, np.inf), np.full(BUCKETS, -np.inf)
            for c, same, left, right in products:
                for _, v in _likeness(c, same, left, right):
                    v = np.sort(v[(v >= lo) & (v <= hi)])
                    if len(v):
                        # In order of values buckets are in order too.
                        at = np.minimum(((v - lo) / (hi - lo) * BUCKETS).astype(np.int64), BUCKETS - 1)
                        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                        ends = np.r_[begins[1:], len(v)]
                        b = at[begins]
                        counts[b] += ends - begins
                        least[b], largest[b] = np.minimum(least[b], v[begins]), np.maximum(largest[b], v[ends - 1])
            b = np.flatnonzero(counts)
            yield pd.DataFrame({"b": b, "n": counts[b], "lo": least[b], "hi": largest[b]})

        return run

    def middle(found, skip: int, n: int):
        """The buckets that hold the two middle values, and how many values lie below the first."""
        upto = skip + np.cumsum(found["n"].to_numpy())
        p, q = np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right")
        return found.iloc[p], found.iloc[q], int(upto[p] - found["n"].iloc[p])

    # At most BUCKETS rows reach the driver, whatever the number of pairs.
    sums = written(_each_likeness(rows, count, first_pass, "b long, n long, trace double, square double"))
    found = sums.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).orderBy("b").toPandas()
    n, median = int(found["n"].sum()), None
    if n:
        a, b, skip = middle(found, 0, n)
        lo, hi = a["b"] / BUCKETS, np.nextafter((b["b"] + 1) / BUCKETS, 0.0) if b["b"] < BUCKETS - 1 else 2.0
        while median is None:
            got = _each_likeness(rows, count, next_pass(float(lo), float(hi)), "b long, n long, lo double, hi double")
            found = got.groupBy("b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("b").toPandas()
            a, b, skip = middle(found, skip, n)
            if a["b"] != b["b"]:
                median = float(a["hi"] + b["lo"]) / 2
            elif a["lo"] == a["hi"]:
                median = float(a["lo"])
            lo, hi = a["lo"], a["hi"]
    rank = F.when(F.col("square") > 0, F.col("trace") * F.col("trace") / F.col("square"))
    total = sums.agg(F.coalesce(F.sum(F.when(F.col("b") < 0, F.col("n"))), F.lit(0)).cast("bigint").alias("channels"), F.sum("trace").alias("trace"), F.sum("square").alias("square"))
    return total.select("channels", rank.alias("rank"), F.lit(median).cast("double").alias("correlation"))
