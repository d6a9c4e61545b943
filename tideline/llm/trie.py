"""Operator 12: the prefix trie of rebuilt conversations, built family by family and then merged."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Conversations c - c % FAMILY to c form a family; at most MOST - 1 turns are taken over from the first.
FAMILY, MOST = 5, 9
#: Turns of a conversation that its family's task holds (MOST at least); later ones are hashed in chunks of CHUNK turns. Ids in a part of a node's list.
HEAD, CHUNK, LISTED = 64, 4096, 4096
#: Keys with so large a share of the rows (1 / HOT) are joined by broadcast; there are HOT of them at most.
HOT = 4096
MADE = "kind int, conv_id long, depth long, xa long, xb long, pa long, pb long, n long, bytes long"
NODE, PATH, END, HEAD_END = range(4)
KEY = ["xa", "xb", "depth"]


def _met(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """The rows joined with the table's row of their keys. The rows of `hot` keys, HOT at most, are broadcast; the others meet by an exchange."""
    values = [c for c in table.columns if c not in keys]
    few = table.where(hot).select(*keys, F.struct(*values, F.lit(True).alias("on")).alias("_hot"))
    marked = rows.join(F.broadcast(few), keys, "left")
    warm = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in values])
    cold = marked.where("_hot is null").drop("_hot").join(table.where(~hot), keys)
    return warm.unionByName(cold.select(*rows.columns, *values))


def ordered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, a, b, bytes): every turn's place in its conversation, two hashes of its role and text, and the text's UTF-8 bytes.

    Rows are dealt by ranges of (conv_id, turn, role, text), so that a conversation of any length spreads over tasks; equal
    turns go by role and text. Tasks number their own runs; only conversations that cross from one range to the next need
    more, two a range at most, and their offsets are broadcast.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "row"]
    slim = ["conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.octet_length("text").cast("bigint").alias("bytes")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*slim).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            pos = np.arange(len(conv)) - np.repeat(begins, np.diff(np.r_[begins, len(conv)]))
            if conv[0] == last:
                pos[: begins[1] if len(begins) > 1 else len(conv)] += held
            last, held = conv[-1], pos[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64())], names=[*batch.schema.names, "pos"])

    numbered = scratch.save(dealt.mapInArrow(number, "conv_id long, a long, b long, bytes long, part int, pos long"), "turns")
    sizes = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    several = sizes.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = several.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = numbered.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "bytes")


def _at(pos: Column) -> list[Column]:
    """Two hashes of a turn at a depth; a node is the exclusive or of its turns' hashes, whose order their places keep."""
    return [F.xxhash64("a", pos.cast("bigint")).alias("fa"), F.xxhash64("b", pos.cast("bigint"), F.lit(3)).alias("fb")]


def _families(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every family's trie as rows: its combined nodes, and of every conversation the path and the end.

    The base's first turns and the members' own are cogrouped by base id. A family's task holds HEAD turns a member.
    """
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    base = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST - 1)).select(family, F.col("pos").alias("base_pos"), *_at(F.col("pos")), F.col("bytes").alias("base_bytes"))
    own = turns.where(F.col("pos") < HEAD).join(convs, "conv_id").select(family, "conv_id", "pos", *_at(F.col("pos") - F.col("h") + F.col("taken")), "bytes", "h", "taken", "rebuilt")

    def build(base, own):
        import pyarrow as pa

        first = list(zip(*[base.sort_by("base_pos").column(c).to_pylist() for c in ("fa", "fb", "base_bytes")], strict=True))
        rows = own.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
        members: dict = {}
        for c, pos, fa, fb, size, h, taken, rebuilt in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "pos", "fa", "fb", "bytes", "h", "taken", "rebuilt")], strict=True):
            turns = members.setdefault(c, (rebuilt, first[:taken]))[1]
            if pos >= h:
                turns.append((fa, fb, size))
        nodes, out = {}, []
        for c, (rebuilt, turns) in members.items():  # ascending, so that a node's first member is its smallest
            path, at = [], (0, 0, 0)
            for d, (fa, fb, size) in enumerate([(0, 0, 0), *turns]):
                before, at = (at[0], at[1]) if d else (None, None), (at[0] ^ fa, at[1] ^ fb, d)
                node = nodes.setdefault(at, [c, *before, 0, size])
                node[3] += 1
                path.append((c, d, *at[:2]))
            cut = len(turns) < rebuilt
            if cut or nodes[at][0] == c:  # the path of a copy is that of its original
                out += [(PATH, *p, None, None, None, None) for p in path]
            out.append((HEAD_END if cut else END, c, at[2], *at[:2], None, None, None, None))
        out += [(NODE, c, d, xa, xb, pa_, pb, n, size) for (xa, xb, d), (c, pa_, pb, n, size) in nodes.items()]
        kinds = [pa.int32()] + [pa.int64()] * 8
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in MADE.split(", ")])

    return base.groupBy("family").cogroup(own.groupBy("family")).applyInArrow(build, MADE)


def _tails(turns: DataFrame, convs: DataFrame, heads: DataFrame, total: int) -> DataFrame:
    """Nodes, paths and ends beyond the HEAD turns that families hold: running hashes in chunks, so that no task needs a whole conversation."""
    rows = turns.where(F.col("pos") >= HEAD)
    rows = _met(rows, convs.select("conv_id", "h", "taken", "rebuilt", "len"), ["conv_id"], F.col("len") * HOT >= total)
    at = F.col("pos") - F.col("h") + F.col("taken")
    rows = rows.select("conv_id", (at + 1).alias("depth"), *_at(at), "bytes", "rebuilt", F.floor(F.col("pos") / CHUNK).alias("chunk"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("fa").alias("ca"), F.bit_xor("fb").alias("cb")).join(heads.select("conv_id", F.col("xa").alias("ha"), F.col("xb").alias("hb")), "conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = chunks.select("conv_id", "chunk", *[F.col(h).bitwiseXOR(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0))).alias(h) for h, c in (("ha", "ca"), ("hb", "cb"))])
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(begun, ["conv_id", "chunk"])
    nodes = met.select("conv_id", "depth", "rebuilt", "fa", "fb", "bytes", *[F.bit_xor(f).over(so_far).bitwiseXOR(F.col(h)).alias(x) for x, f, h in (("xa", "fa", "ha"), ("xb", "fb", "hb"))])
    kinds = F.explode(F.when(F.col("depth") == F.col("rebuilt"), F.array(F.lit(NODE), F.lit(PATH), F.lit(END))).otherwise(F.array(F.lit(NODE), F.lit(PATH)))).alias("kind")
    before = [F.col(x).bitwiseXOR(F.col(f)).alias(p) for p, x, f in (("pa", "xa", "fa"), ("pb", "xb", "fb"))]
    return nodes.select(kinds, "conv_id", "depth", "xa", "xb", *before, F.lit(1).cast("bigint").alias("n"), "bytes")


def _ends(ends: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ended conversations, ascending and joined by commas: (xa, xb, depth, sha).

    Ids are dealt by ranges and become parts of LISTED ids; a task then passes over a node's parts in order, without holding
    them. (The hash of a list can only be taken in its order.)
    """

    def part(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, ids = None, []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*key, ids[0], ",".join(map(str, ids))], [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*KEY, "first", "ids"])
        for batch in batches:
            for *own, c in zip(*[batch.column(k).to_pylist() for k in [*KEY, "conv_id"]], strict=True):
                if ids and (own != key or len(ids) == LISTED):
                    yield rows()
                    ids = []
                key = own
                ids.append(c)
        if ids:
            yield rows()

    def close(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        key, digest = None, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "sha"])
        for batch in batches:
            done = []
            for *own, ids in zip(*[batch.column(k).to_pylist() for k in [*KEY, "ids"]], strict=True):
                if own == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield made(done)
        if key is not None:
            yield made([(*key, digest.hexdigest())])

    schema = "xa long, xb long, depth long"
    order = [*KEY, "conv_id"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(part, f"{schema}, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(close, f"{schema}, sha string")


def prefix_trie(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """A row a node of the trie of rebuilt conversations, of `turns` (conv_id, turn, role, text).

    A conversation's turns are ordered by turn, nulls first, equal ones by role and text; a null role or text is empty.
    Conversation c is rebuilt from the first h turns of conversation c - c % 5 (c % 5 has c's sign), h being the CRC-32 of
    c's digits modulo 9, and its own turns after its first h. Every distinct sequence of first turns is a node; a row has
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Family first: base and members are cogrouped by base id, each family builds its own small trie, and only its combined
    nodes are shuffled for the global merge, as 128-bit hashes. A node's smallest member also is that of the nodes
    below on that member's path, so nodes form chains, one a member, and sums over subtrees are sums over chains: every
    chain sends its own totals to the last node of every other chain on its member's path, and a running sum from below
    adds them up along each chain. All of it grows with the number of turns, whatever the trie's depth.

    Rows without a conv_id take no part; repeated rows are turns each; long texts are only hashed; a conversation of any
    length is spread over tasks; an empty table gives no row. Extra columns are ignored.
    """
    rows = scratch.save(ordered(turns, scratch), "ordered")
    scratch.drop("turns")
    lens = rows.groupBy("conv_id").agg(F.count("*").alias("len"))
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("bigint")
    bases = lens.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.col("len").alias("base_len"))
    convs = lens.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(bases, "family", "left").withColumn("h", h)
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0)))).withColumn("rebuilt", F.col("taken") + F.greatest(F.lit(0), F.col("len") - F.col("h")))
    convs = scratch.save(convs.select("conv_id", "len", "h", "taken", "rebuilt"), "convs")
    made = scratch.save(_families(rows, convs), "families")
    heads = made.where(F.col("kind") == HEAD_END)
    if heads.limit(1).count():
        total = convs.agg(F.sum("len").alias("n")).first()["n"]
        made = made.unionByName(scratch.save(_tails(rows, convs, heads, total), "tails"))
    nodes = made.where(F.col("kind") == NODE).groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("bytes", "pa", "pb")])
    nodes = scratch.save(nodes, "merged")
    count, members = nodes.agg(F.count("*"), F.sum("n")).first()
    above = [F.col("pa").alias("xa"), F.col("pb").alias("xb"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").select(*above).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    known = scratch.save(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "known")
    scratch.drop("merged")
    # Parents' smallest members: a node of very many children is met by broadcast.
    below = known.where("depth > 0").select(*above, F.struct(*[c for c in known.columns]).alias("own"))
    parents = known.select(*KEY, F.col("rep").alias("parent"), F.col("n_children").alias("of"))
    owned = _met(below, parents, KEY, F.col("of") * HOT >= (count or 0)).select("own.*", "parent")
    whole = known.where("depth = 0").withColumn("parent", F.lit(None).cast("bigint")).unionByName(owned)
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n") - 1) * F.col("bytes")
    # Chains on the paths: of each conversation and each smallest member on its path the last depth.
    paths = made.where(F.col("kind") == PATH).select("conv_id", *KEY)
    segments = _met(paths, known.select(*KEY, "rep", "n"), KEY, F.col("n") * HOT >= (members or 0)).groupBy("conv_id", "rep").agg(F.max("depth").alias("depth"))
    totals = known.groupBy(F.col("rep").alias("conv_id")).agg(F.sum(leaf).alias("more_leaves"), F.sum(saved).alias("more_saved"))
    sent = segments.where("conv_id <> rep").join(totals, "conv_id").groupBy("rep", "depth").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    own = [(leaf + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (saved + F.coalesce("more_saved", F.lit(0))).alias("saved")]
    valued = whole.join(sent, ["rep", "depth"], "left").select("rep", *KEY, "parent", "n", "n_children", *own, F.floor(F.col("depth") / CHUNK).alias("chunk"))
    valued = scratch.save(valued, "valued")
    # Sums from below along each chain, chunk by chunk.
    later = Window.partitionBy("rep").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = valued.groupBy("rep", "chunk").agg(F.sum("leaves").alias("cl"), F.sum("saved").alias("cs")).select("rep", "chunk", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("cl", "cs")])
    down = Window.partitionBy("rep", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = valued.join(chunks, ["rep", "chunk"]).select(*KEY, "rep", "parent", "n", "n_children", *[(F.sum(v).over(down) + F.col(c)).alias(v) for v, c in (("leaves", "cl"), ("saved", "cs"))])
    listed = summed.join(_ends(made.where(F.col("kind") == END)), KEY, "left")
    names = {"rep": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "n_children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    return listed.select(*[F.col(c).cast("bigint").alias(n) for c, n in names.items()], F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
