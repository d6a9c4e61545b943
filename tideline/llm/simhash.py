"""Operator 6: SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, iterated, slices

#: Words a shingle, differing bits that still link, and rows a bucket may have before it is split.
WORDS, DISTANCE, BUCKET = 4, 4, 1 << 15
#: Cost of shuffling one key and of comparing one candidate, in the same unit.
KEY_COST, PAIR_COST = 1.0, 0.002
#: Keys of a fingerprint that a plan may have at most: more are never cheaper, and take long to write down.
KEYS = 4096
#: With `similar`: bands of smallest hashes, those a band has, and differing bits up to which a shared band makes a candidate. Sets of Jaccard 0.8
#: share no band with a chance of (1 - 0.8^5)^20, 0.04 %, and have fingerprints 10 bits apart on average, over 20 in 0.1 %.
BANDS, ROWS, NEAR = 20, 5, 20
#: Number of the first part that is a band.
BANDED = 1000
#: Buckets too large for one task that may be broadcast, and copies of a component's row.
SMALL, SALTS = 10_000, 8


def shingle_hashes(text: str | None, words: int = WORDS):
    """XXH64 (seed 42) of every shingle, repeats included; fewer words make one shingle, no word none."""
    import numpy as np
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    pairs = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, len(parts) - words + 1)


def majority(hashes) -> int:
    """Bit b is 1 if set in over half of the hashes; of none: 0."""
    import numpy as np

    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def simhash(text: str | None, words: int = WORDS) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row a document, fp as a signed 64-bit value."""

    @iterated("long")
    def of(texts: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in texts:
            yield pd.Series(np.fromiter((simhash(t, words) for t in batch), np.uint64, len(batch)).view(np.int64))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), of("text").alias("fp"))


def statistics(prints: DataFrame) -> tuple[int, object]:
    """Over all distinct fingerprints: their number and how often two bits are set together (64 x 64). Each task sends one
    row of fixed size."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            octets = batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 14):
                both += bits[at : at + (1 << 14)].T @ bits[at : at + (1 << 14)]
            n += len(bits)
        yield pd.DataFrame({"n": [n], "both": [both.ravel()]})

    n, both = 0, np.zeros(64 * 64)
    for row in prints.select("fp").mapInPandas(run, "n long, both array<double>").toLocalIterator():
        n += row["n"]
        both += np.array(row["both"])
    return n, both.reshape(64, 64)


def group_bits(n: int, both, parts: int) -> list[list[int]]:
    """Bits in `parts` partitions of nearly equal width, correlated bits together: each partition grows from the bit
    with the strongest correlations left by the bit that correlates most with it."""
    import numpy as np

    if n:
        p = np.diag(both) / n
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        related = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
        np.fill_diagonal(related, 0)
    else:
        related = np.zeros((64, 64))
    left, out = list(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def meeting_odds(n: int, both, bits: list[int], radius: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0..radius of these bits: a convolution over the bits of
    each bit's chance to differ, where a bit that follows another one in value adds only what it does not share with it."""
    import numpy as np

    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    odds = np.zeros(radius + 1)
    odds[0] = 1.0
    for i, b in enumerate(bits):
        differ = 2 * p[b] * (1 - p[b])
        if i:
            shared = max(abs(both[b, c] / max(1, n) - p[b] * p[c]) / (spread[b] * spread[c]) for c in bits[:i])
            differ *= 1 - min(1.0, shared)
        odds = odds * (1 - differ) + np.r_[0, odds[:-1]] * differ
    return np.cumsum(odds).tolist()


def allocate(n: int, both, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds (bits, t), t = -1 leaving a partition out, at the lowest estimated cost.

    Two fingerprints that differ in at most `distance` bits differ in at most t[i] bits of some partition i if the
    thresholds sum to distance - parts + 1. For each number of partitions a dynamic program over the partitions picks
    the thresholds: a key costs one unit for each value within t of a partition, and a candidate its comparison.
    """
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(2, distance + 2):
        groups, budget = group_bits(n, both, parts), distance - parts + 1
        tables = {0: (0.0, [])}
        for bits in groups:
            odds, fresh = meeting_odds(n, both, bits, distance), {}
            for used, (cost, chosen) in tables.items():
                for t in range(-1, min(distance, len(bits)) + 1):
                    keys = sum(comb(len(bits), r) for r in range(t + 1))
                    if keys > KEYS:
                        break
                    price = cost + (n * keys * KEY_COST + n * n * odds[t] * PAIR_COST if t >= 0 else 0)
                    if used + t not in fresh or price < fresh[used + t][0]:
                        fresh[used + t] = (price, [*chosen, t])
            tables = fresh
        if budget in tables and tables[budget][0] < best[0]:
            best = (tables[budget][0], list(zip(groups, tables[budget][1], strict=True)))
    return [(bits, t) for bits, t in best[1] if t >= 0]


def filed(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Every node under its fingerprint's value in each partition and, as a probe, under the values within the partition's threshold."""
    keys = []
    for i, (bits, t) in enumerate(plan):
        whole = sum(1 << b for b in bits)
        flips = [sum(1 << b for b in some) for r in range(t + 1) for some in combinations(bits, r)]
        keys += [F.struct(F.lit(i).alias("part"), F.lit(_signed(whole)).alias("whole"), F.lit(_signed(f)).alias("flip")) for f in flips]
    each = nodes.withColumn("at", F.explode(F.array(*keys)))
    value = F.col("fp").bitwiseAND(F.col("at.whole")).bitwiseXOR(F.col("at.flip"))
    return each.select(F.col("at.part").alias("part"), value.alias("value"), *nodes.columns, (F.col("at.flip") != 0).alias("probe"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bands_of(own, factors):
    """One value a band: the band's smallest hashes, mixed. An empty set has none."""
    import numpy as np

    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):  # blocks that stay in the cache
        np.minimum(least, (own[None, at : at + 512] * factors[:, None]).min(1), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * np.roll(factors, 1)
    return mixed.reshape(-1, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def banded(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Every node under each of its bands, in the form of `filed`."""
    each = nodes.select(*columns, F.posexplode("bands").alias("_band", "value"))
    return each.select((F.col("_band") + BANDED).cast("int").alias("part"), "value", *columns, F.lit(False).alias("probe"))


def meetings(rows: DataFrame, columns: list[str], scratch: Scratch, find, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: what `find` makes of each bucket (part, value) of filed rows: of its rows, sorted by fingerprint, as arrays by column.

    A bucket of more than `bucket` rows is split by hash into blocks, and every two of its blocks meet, so that no task
    holds a bucket; rows of other buckets are sent once.
    """
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    cut = scratch.save(sizes.select(F.col("part").alias("_part"), F.col("value").alias("_value"), F.ceil(F.col("n") / bucket).cast("int").alias("blocks")), "cut")
    if cut.limit(1).count():
        few = cut.limit(SMALL + 1).count() <= SMALL
        met = rows.join(F.broadcast(cut) if few else cut, (F.col("part") == F.col("_part")) & (F.col("value") == F.col("_value")), "left")
        blocks = F.coalesce("blocks", F.lit(1))
        blocked = met.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("lo"), F.greatest(other, F.col("block")).alias("hi")))
        dealt = blocked.withColumn("meet", F.explode(pairs)).select("part", "value", F.col("meet.lo").alias("lo"), F.col("meet.hi").alias("hi"), *columns, "probe", "block")
    else:
        zero = [F.lit(0).alias(c) for c in ("lo", "hi")]
        dealt = rows.select("part", "value", *zero, *columns, "probe", F.lit(0).alias("block"))

    def join(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held: list = []

        def close():
            frame = pd.concat(held) if len(held) > 1 else held[0]
            held.clear()
            own = {c: frame[c].to_numpy() for c in frame.columns}
            edge = np.r_[True, np.logical_or.reduce([own[c][1:] != own[c][:-1] for c in order])]
            bounds = np.r_[np.flatnonzero(edge), len(frame)]
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s > 1:
                    for a, b in find({c: v[s:e] for c, v in own.items()}):
                        yield np.minimum(a, b), np.maximum(a, b)

        def sent(found):
            a, b = [], []
            for x, y in found:
                a.append(x)
                b.append(y)
                if sum(map(len, a)) > 1 << 16:
                    yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                    a, b = [], []
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        def found():
            for batch in batches:
                if not len(batch):
                    continue
                same = np.logical_and.reduce([(batch[c] == batch[c].iloc[-1]).to_numpy() for c in order])
                at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if at:
                    held.append(batch.iloc[:at])
                    yield from close()
                held.append(batch.iloc[at:])
            if held:
                yield from close()

        yield from sent(found())

    order = ["part", "value", "lo", "hi"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "fp").mapInPandas(join, "a long, b long").distinct()


def _fits(rows: dict, x, y, distance: int):
    """Which of the rows x and y (indices that broadcast) are candidates: near, not both probes, of different blocks
    where two blocks meet, and of sizes that leave room for Jaccard 0.8 where they have any."""
    import numpy as np

    raw = rows["fp"].view(np.uint64)
    near = np.bitwise_count(raw[x] ^ raw[y]) <= distance
    if rows["probe"].any():
        near &= ~(rows["probe"][x] & rows["probe"][y])
    if rows["lo"][0] != rows["hi"][0]:
        near &= rows["block"][x] != rows["block"][y]
    if "size" in rows:
        sizes = rows["size"]
        near &= 5 * np.minimum(sizes[x], sizes[y]) >= 4 * np.maximum(sizes[x], sizes[y])
    return near


def _within(rows: dict, distance: int) -> int:
    """Differing bits that still make a candidate in this bucket."""
    return NEAR if rows["part"][0] >= BANDED else distance


def near_pairs(rows: dict, distance: int) -> Iterator:
    """All candidates of one bucket, as (x, y) index arrays, a part at a time."""
    import numpy as np

    n = len(rows["fp"])
    own, every = np.flatnonzero(~rows["probe"]), np.arange(n)
    step = max(1, (1 << 21) // n)
    for at in range(0, len(own), step):
        x = own[at : at + step]
        near = _fits(rows, x[:, None], every[None], distance)
        # Of two rows that are both no probes the pair comes once.
        near &= (x[:, None] < every[None]) | rows["probe"][None]
        i, j = np.nonzero(near)
        if len(i):
            yield x[i], j


def forest(distance: int):
    """Links that join whatever a bucket's candidates join: the closest first, so as many as members at most (Prim)."""

    def find(rows: dict) -> Iterator:
        import numpy as np

        reach = _within(rows, distance)
        if len(rows["fp"]) == 2:
            if _fits(rows, np.array([0]), np.array([1]), reach)[0] and rows["node"][0] != rows["node"][1]:
                yield rows["node"][:1], rows["node"][1:]
            return
        met = np.zeros(len(rows["fp"]), bool)
        for x, y in near_pairs(rows, reach):
            met[x] = met[y] = True
        some = np.flatnonzero(met)
        if not len(some):
            return
        few = {c: v[some] for c, v in rows.items()}
        raw, n = few["fp"].view(np.uint64), len(some)
        left, best, link = np.ones(n, bool), np.full(n, 255, np.uint8), np.zeros(n, np.int64)
        a, b, every = [], [], np.arange(n)
        for _ in range(n):
            x = int(np.argmin(np.where(left, best, 255)))
            if not left[x]:  # nothing within reach: begin anew
                x = int(np.argmax(left))
            left[x] = False
            if best[x] <= reach:
                a.append(link[x])
                b.append(x)
            apart = np.bitwise_count(raw ^ raw[x])
            closer = left & (apart < best) & _fits(few, every, np.full(n, x), reach)
            best[closer], link[closer] = apart[closer], x
        yield few["node"][np.array(a, np.int64)], few["node"][np.array(b, np.int64)]

    return find


def across(distance: int):
    """All candidates of a bucket that lie in different components."""

    def find(rows: dict) -> Iterator:
        for x, y in near_pairs(rows, _within(rows, distance)):
            other = rows["root"][x] != rows["root"][y]
            if other.any():
                yield rows["node"][x[other]], rows["node"][y[other]]

    return find


def links(prints: DataFrame, plan: list[tuple[list[int], int]], scratch: Scratch, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all distinct fingerprints which near ones join, though not every near pair."""
    return meetings(filed(prints.select("fp", F.col("fp").alias("node")), plan), ["fp", "node"], scratch, forest(distance), bucket)


def components(edges: DataFrame, scratch: Scratch, name: str = "e") -> DataFrame:
    """(node, root): the smallest node of every component, by alternating large-star and small-star steps (Kiveris et al.).

    Each step is a grouped minimum and a join back; a hub of any size is a row of the aggregate, and steps are written to
    the shared folder until nothing changes.
    """
    now, tag, before = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), f"{name}0"), 0, None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        tag += 1
        fresh = scratch.save(small, f"{name}{tag}")
        scratch.drop(f"{name}{tag - 1}")
        print_ = fresh.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.countDistinct("u").alias("k")).first()
        state = (print_["n"], print_["h"])
        if state == before:
            return fresh.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, now = state, fresh


def labelled(groups: DataFrame, found: DataFrame | None) -> DataFrame:
    """(node, component_id): for every node of groups (node, first) the smallest first of its component."""
    if found is None:
        return groups.select("node", F.col("first").alias("component_id"))
    root = groups.join(found.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    # A component may hold a third of all nodes: they are dealt by salt, and the component's row copied so often.
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    least = root.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return root.select("node", "root", salt).join(least, ["root", "salt"]).select("node", "component_id")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, distance: int = DISTANCE, similar: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach, the document itself included.

    Fingerprints are written once; distinct ones are filed, joined and traced to components; equal fingerprints never meet in
    pairs. With `similar`, fingerprints within `distance` only make candidates, and so do those within NEAR of
    texts that share a band of smallest hashes; documents are linked whose whole sets of shingles have Jaccard 0.8 or
    more (see `similar_links`).

    Null and empty texts have fingerprint 0 and link like any other. Null doc_ids get their component's smallest doc_id,
    or null where there is none. Repeated rows give a row each; long texts are read whole; an empty table gives none;
    extra columns are ignored.
    """
    if similar:
        prints = scratch.save(signed(docs, words), "prints")
        groups = scratch.save(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "row_hash")).alias("place"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")), "groups")
    else:
        prints = scratch.save(fingerprints(docs, words).withColumn("node", F.col("fp")), "prints")
        groups = scratch.save(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp")), "groups")
    n, both = statistics(groups)
    if n < 2:
        found = None
    elif similar:
        found = similar_links(docs, groups, allocate(n, both, distance), scratch, words, distance)
    else:
        found = components(links(groups, allocate(n, both, distance), scratch, distance), scratch)
    # Written, so that both sides of the join are plain exchanges: a fingerprint that many documents share is a skewed key, which the adaptive join then splits.
    label = scratch.save(labelled(groups, found), "labels")
    return prints.join(label, "node").select("doc_id", "fp", "component_id")


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_hash, fp, node, size, bands): one row a document; node hashes its whole set of shingles, of so many members."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import xxhash

        factors = np.random.default_rng(17).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
        for batch in batches:
            for part in slices(batch):
                hashes = [shingle_hashes(t, words) for t in part["text"]]
                sets = [np.unique(h) for h in hashes]
                fp = np.fromiter(map(majority, hashes), np.uint64, len(part)).view(np.int64)
                node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 8) for s in sets), np.uint64, len(part)).view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "row_hash": part["row_hash"].to_numpy(), "fp": fp, "node": node, "size": np.fromiter(map(len, sets), np.int32, len(part)), "bands": [bands_of(s, factors) for s in sets]})

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return slim.mapInPandas(run, "doc_id long, row_hash long, fp long, node long, size int, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, own): the sets of shingles of the wanted (node, place), from one document each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for part in slices(batch, 64):
                yield pd.DataFrame({"node": part["node"], "own": [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part["text"]]})

    at = wanted.select("node", F.col("place.doc_id").alias("_d"), F.col("place.row_hash").alias("_r"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    met = rows.join(at, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_hash") == F.col("_r"))).select("node", "text")
    return met.mapInPandas(run, "node long, own array<long>").groupBy("node").agg(F.first("own").alias("own"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have Jaccard 4/5 or more: o common shingles of n1 and n2 reach it if 9 o >= 4 (n1 + n2)."""
    x, y = (sets.select(F.col("node").alias(c), F.col("own").alias(f"{c}_own")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where(9 * F.size(F.array_intersect("a_own", "b_own")) >= 4 * (F.size("a_own") + F.size("b_own"))).select("a", "b")


def similar_links(docs: DataFrame, groups: DataFrame, plan: list[tuple[list[int], int]], scratch: Scratch, words: int, distance: int) -> DataFrame | None:
    """(node, root): components of the sets of shingles that have Jaccard 0.8 or more.

    Candidates are fingerprints within `distance`, by the pigeonhole plan, and fingerprints within NEAR of sets that share a
    band: at a distance that Jaccard 0.8 needs, the plan alone would have to compare a share of all pairs. First each bucket's candidates are joined by as few and as close pairs as will do, so a group of near copies gives as
    many pairs as members. What their whole sets confirm makes components; then all candidates that lie in different
    components are compared too. No link is wrong (up to 64-bit hashes), and none between candidates is lost.
    """
    columns = ["fp", "node", "size"]
    in_buckets = lambda nodes, columns: filed(nodes.select(*columns), plan).union(banded(nodes, columns))
    close = scratch.save(meetings(in_buckets(groups, columns), columns, scratch, forest(distance)), "close")
    if not close.limit(1).count():
        return None
    needed = close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct()
    sets = scratch.save(sets_of(docs, groups.join(needed, "node"), words), "sets")
    near = scratch.save(verified(close, sets), "near")
    found = components(near, scratch)
    rooted = groups.join(needed, "node").join(found, "node", "left").select(*columns, "bands", F.coalesce("root", "node").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    scratch.drop("cut")
    rest = scratch.save(meetings(in_buckets(rooted, [*columns, "root"]), [*columns, "root"], scratch, across(distance)).join(close, ["a", "b"], "left_anti"), "rest")
    more = scratch.save(verified(rest, sets), "more")
    for done in ("sets", "rest", "close", "rooted"):
        scratch.drop(done)
    return components(near.union(more), scratch, "again") if more.limit(1).count() else found


