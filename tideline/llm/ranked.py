"""Operator 11: ranked lexical search over dual-sorted wavelet trees, one a shard of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: A shard closes at so many documents (a power of two) or words; one longer document is a shard of its own.
DOCS, WORDS = 8192, 1 << 21
#: Items of a query block, of those that are searched at a time, and tree nodes that each of them expands in a round.
ITEMS, AT_ONCE, NODES = 256, 32, 16
#: Terms of query blocks that may be broadcast; beyond that blocks and shards meet by an exchange, in which a block is dealt to so many groups of shards.
SMALL, GROUPS = 1 << 18, 64
#: Bytes of a row group of shards and trees, which are some megabytes each.
GROUP = 1 << 24
#: Shares of BM25's length part, in hundredths, and its scale.
LENGTH_SHARE = 75
#: Bytes that are no part of a term become blanks, A-Z become a-z; all bytes of other characters stay.
_TERMS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
SHARD = "shard long, ids array<long>, known binary, lengths array<int>, terms array<binary>, counts array<int>, docs binary, tfs binary"
TREE = "shard long, ids array<long>, known binary, terms array<binary>, counts array<int>, sizes array<int>, bits array<binary>, impacts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TERMS).split() if text else []


@dataclass
class Index:
    """trees: a row a shard. documents: those with a term (N); words: all their terms (L)."""

    trees: DataFrame
    documents: int
    words: int


def _rows(frame, schema: str):
    """A dict of lists as a record batch of the schema's types."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(frame[n], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def _shards(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text as bytes) as shards: ids in ascending order, null ids last, and the postings term after term, terms in order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        vocabulary, ids, known, lengths, held = _Numbers(), [], [], [], []

        def shard():
            order = np.lexsort((np.array(ids, np.int64), ~np.array(known, bool)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            n = np.array(lengths, np.int64)
            words = np.concatenate(held) if held else np.zeros(0, np.int64)
            names = sorted(vocabulary)
            place = np.empty(len(names), np.int64)
            place[np.fromiter(map(vocabulary.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
            keys, tfs = np.unique(place[words] * DOCS + np.repeat(rank, n), return_counts=True)
            out = {"shard": [None], "ids": [np.array(ids, np.int64)[order]], "known": [np.array(known, np.uint8)[order].tobytes()], "lengths": [n[order].astype(np.int32)], "terms": [names], "counts": [np.bincount(keys // DOCS, minlength=len(names)).astype(np.int32)], "docs": [(keys % DOCS).astype(np.uint16).tobytes()], "tfs": [tfs.astype(np.int32).tobytes()]}
            vocabulary.clear()
            for x in (ids, known, lengths, held):
                x.clear()
            return _rows(out, SHARD)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = terms_of(text.as_py())
                if ids and (len(ids) == DOCS or size + len(words) > WORDS):
                    yield shard()
                    size = 0
                size += len(words)
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                lengths.append(len(words))
                held.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SHARD)


class _Numbers(dict):
    """Numbers of terms in the order in which they are first met."""

    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


def impacts_of(tfs, lengths, documents: int, words: int):
    """(10^9 tf) div (1000 tf + 8 m) with m = 100 - 75 + (75 n N) div L, in 64-bit integers."""
    import numpy as np

    m = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths.astype(np.int64) * documents // max(1, words)
    tfs = tfs.astype(np.int64)
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def levels_of(docs: int) -> int:
    return max(1, math.ceil(math.log2(max(2, docs))))


def build(docs: DataFrame, scratch: Scratch) -> Index:
    """Indexes every document (doc_id, text): a dual-sorted wavelet tree a shard, written to the scratch folder.

    Tasks turn their own documents into shards, nothing is shuffled: each has its documents in the order of doc_id and all
    postings, term after term. N and L are summed over the shards' rows. Then every term's postings are put in
    falling order of their impact (equal ones by document), and the sequence of all postings' documents becomes a wavelet
    tree: a level a bit of the document's rank, each node holding its postings in the sequence's order. So a term's
    postings are one range in every node, whose first posting has the greatest impact in the node's documents, and going
    down a node halves its range of documents.

    Null texts have no terms, null doc_ids rank last among equals, repeated rows are documents each. Long texts are read
    whole: the longest makes a shard of its own. An empty table gives an index without shards; extra columns are ignored.
    """
    shards = scratch.save(_shards(docs).withColumn("shard", F.monotonically_increasing_id()), "shards", GROUP)
    total = shards.select(F.sum(F.size(F.filter("lengths", lambda n: n > 0))).alias("documents"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("words")).first()
    documents, words = total["documents"] or 0, total["words"] or 0

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a batch may have dozens
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: v.values if c == "terms" else v.as_py() for c, v in row.items()}
                docs, tfs = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["tfs"], np.int32)
                lengths, counts = np.array(row["lengths"], np.int64), np.array(row["counts"], np.int64)
                impacts = impacts_of(tfs, lengths[docs], documents, words)
                order = np.lexsort((docs, -impacts, np.repeat(np.arange(len(counts)), counts)))
                sequence, height = docs[order], levels_of(len(lengths))
                out = {k: [row[k]] for k in ("shard", "ids", "known", "terms", "counts")} | {"impacts": [impacts[order].astype(np.int32).tobytes()], "sizes": [np.bincount(docs, minlength=len(lengths)).astype(np.int32)]}
                bits = []
                for level in range(height):
                    bits.append(np.packbits((sequence >> (height - 1 - level)) & 1).tobytes())
                    sequence = sequence[np.argsort(sequence >> (height - 1 - level), kind="stable")]
                yield _rows(out | {"bits": [bits]}, TREE)

    trees = scratch.save(shards.mapInArrow(run, TREE), "trees", GROUP)
    scratch.drop("shards")
    return Index(trees, documents, words)


class Tree:
    """A shard's wavelet tree in memory: the number of zeros before each place of each level, and the impacts in each level's order."""

    def __init__(self, row: dict):
        import numpy as np

        self.ids, self.known, self.terms = np.array(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8).astype(bool), row["terms"]
        counts, sizes = np.array(row["counts"], np.int64), np.array(row["sizes"], np.int64)
        self.begins = np.r_[0, np.cumsum(counts)]
        self.height = len(row["bits"])
        n = int(self.begins[-1])
        self.of_docs = np.r_[0, np.cumsum(np.r_[sizes, np.zeros((1 << self.height) - len(sizes), np.int64)])]  # postings of lower documents
        self.zeros = np.zeros((self.height, n + 1), np.int32)
        self.impacts = np.empty((self.height + 1, n), np.int32)
        self.impacts[0] = np.frombuffer(row["impacts"], np.int32)
        for level, raw in enumerate(row["bits"]):
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
            np.cumsum(~bit, out=self.zeros[level, 1:])
            place = self._down(level, np.arange(n), bit)
            self.impacts[level + 1][place] = self.impacts[level]

    def _down(self, level: int, at, bit):
        """Where a level's postings lie one level below."""
        import numpy as np

        width = self.of_docs[:: 1 << (self.height - level)]
        node = np.searchsorted(width, at, side="right") - 1
        start = width[node]
        zeros = self.zeros[level]
        ahead = zeros[at] - zeros[start]
        return np.where(bit, start + (zeros[width[node + 1]] - zeros[start]) + (at - start - ahead), start + ahead)

    def ranges(self, terms: list[bytes]):
        """(lo, hi) of the terms' postings in the sequence; 0, 0 of a term that the shard hasn't."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(pa.array(terms, pa.binary()), value_set=self.terms)
        at = np.asarray(pc.fill_null(at, -1), np.int64)
        return np.where(at >= 0, self.begins[at], 0), np.where(at >= 0, self.begins[at + 1], 0)


def search_tree(tree: Tree, queries, weights, lo, hi, least, k: int):
    """The (query, document rank, score) that may be among the k best of each query, from its entries in order of query:
    (queries, weights, lo, hi), a row a term. least: each query's k-th best score so far.

    Best first: in a round every query's NODES nodes of the highest bounds are expanded. A node's bound is the sum over its
    terms of the weight times the impact of the first posting in the term's range, the greatest of the node's documents; a
    leaf is a document, and its bound the score. Nodes below the k-th best score go, and so do those that reach it
    just so when k documents of lower rank have it.
    """
    import numpy as np

    n = len(least)
    least = least.copy()
    on = hi > lo
    owner, weight, lo, hi = queries[on], weights[on], lo[on], hi[on]
    who, inverse = np.unique(owner, return_inverse=True)
    level, prefix, bound = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.bincount(inverse, minlength=len(who)) * 0
    np.add.at(bound, inverse, weight * tree.impacts[0][lo])
    node = inverse
    found_q, found_d, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(who):
        order = np.lexsort((-bound, who))
        begin = np.searchsorted(who[order], who[order])
        chosen = np.zeros(len(who), bool)
        chosen[order[np.arange(len(who)) - begin < NODES]] = True
        take = chosen[node]
        renamed = np.cumsum(chosen) - 1
        e_node, e_weight, e_lo, e_hi = renamed[node[take]], weight[take], lo[take], hi[take]
        e_who, e_level, e_prefix = who[chosen], level[chosen], prefix[chosen]
        left, shift = ~chosen, np.cumsum(~chosen) - 1
        who, level, prefix, bound = who[left], level[left], prefix[left], bound[left]
        node, weight, lo, hi = shift[node[~take]], weight[~take], lo[~take], hi[~take]
        # Down to both children: ranks of zeros map a range of a node to one of its child.
        rise = tree.height - e_level
        start, end = tree.of_docs[e_prefix << rise], tree.of_docs[(e_prefix + 1) << rise]
        z_start, z_end = tree.zeros[e_level, start], tree.zeros[e_level, end]
        s, zs, ze, lv = start[e_node], z_start[e_node], z_end[e_node], e_level[e_node]
        z_lo, z_hi = tree.zeros[lv, e_lo] - zs, tree.zeros[lv, e_hi] - zs
        ones = s + ze - zs
        c_lo = np.concatenate([s + z_lo, ones + (e_lo - s - z_lo)])
        c_hi = np.concatenate([s + z_hi, ones + (e_hi - s - z_hi)])
        c_node = np.concatenate([2 * e_node, 2 * e_node + 1])
        c_weight = np.concatenate([e_weight, e_weight])
        some = c_hi > c_lo
        c_lo, c_hi, c_node, c_weight = c_lo[some], c_hi[some], c_node[some], c_weight[some]
        c_who, c_level, c_prefix = np.repeat(e_who, 2), np.repeat(e_level + 1, 2), np.repeat(e_prefix * 2, 2) + np.tile([0, 1], len(e_who))
        c_bound = np.zeros(len(c_who), np.int64)
        np.add.at(c_bound, c_node, c_weight * tree.impacts[c_level[c_node], c_lo])
        leaf = (c_level == tree.height) & (c_bound > 0)
        if leaf.any():
            found_q, found_d, found_s = np.r_[found_q, c_who[leaf]], np.r_[found_d, c_prefix[leaf]], np.r_[found_s, c_bound[leaf]]
            order = np.lexsort((found_d, -found_s, found_q))
            order = order[np.arange(len(order)) - np.searchsorted(found_q[order], found_q[order]) < k]
            found_q, found_d, found_s = found_q[order], found_d[order], found_s[order]
            full = np.flatnonzero(np.bincount(found_q, minlength=n) == k)
            last = np.searchsorted(found_q, full, side="right") - 1
            least[full] = np.maximum(least[full], found_s[last])
        goes = (c_level < tree.height) & (c_bound > 0)
        shift = np.cumsum(goes) - 1
        live = goes[c_node]
        node = np.r_[node, len(who) + shift[c_node[live]]]
        weight, lo, hi = np.r_[weight, c_weight[live]], np.r_[lo, c_lo[live]], np.r_[hi, c_hi[live]]
        who, level, prefix, bound = np.r_[who, c_who[goes]], np.r_[level, c_level[goes]], np.r_[prefix, c_prefix[goes]], np.r_[bound, c_bound[goes]]
        # What can't reach the k best any more goes.
        lowest, worst = np.full(n, -1), np.zeros(n, np.int64)
        if len(found_q):
            full = np.flatnonzero(np.bincount(found_q, minlength=n) == k)
            last = np.searchsorted(found_q, full, side="right") - 1
            lowest[full], worst[full] = found_d[last], found_s[last]
        first = prefix << (tree.height - level)
        stays = (bound > least[who]) | ((bound == least[who]) & ~((worst[who] == least[who]) & (lowest[who] >= 0) & (first > lowest[who])))
        if not stays.all():
            shift = np.cumsum(stays) - 1
            keep = stays[node]
            node, weight, lo, hi = shift[node[keep]], weight[keep], lo[keep], hi[keep]
            who, level, prefix, bound = who[stays], level[stays], prefix[stays], bound[stays]
    return found_q, found_d, found_s


def _asked(items: DataFrame, trees: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Query blocks (part, and lists of keys, item ids, and of entries by item: term, repeats, df), their number and their entries."""

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for key, item, text in zip(batch.column("key").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                own: dict = {}
                for t in terms_of(text.as_py()):
                    own[t] = own.get(t, 0) + 1
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.int64()), pa.array([item] * len(own), pa.int64()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["key", "item_id", "term", "qtf"])

    keyed = items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    entries = scratch.save(keyed.mapInArrow(split, "key long, item_id long, term binary, qtf long"), "entries")
    terms = entries.select("term").distinct()
    if terms.limit(SMALL + 1).count() <= SMALL:
        terms = F.broadcast(terms)
    counted = trees.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = counted.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    parts = -(-max(1, entries.select("key").distinct().count()) // ITEMS)
    met = entries.join(df, "term").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    # An item's entries are its own; a block holds about ITEMS items.
    fields = ["key", "item_id", "term", "qtf", "df"]
    blocks = met.groupBy("part").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("e")).select("part", *[F.col(f"e.{f}").alias(f"q_{f}") for f in fields])
    saved = scratch.save(blocks, "asked")
    return saved, parts, saved.agg(F.sum(F.size("q_key")).alias("n")).first()["n"] or 0


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = 10, small: int = SMALL) -> DataFrame:
    """Each item's (item_id, text) k highest-scoring documents: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    Items become blocks of terms with their document frequencies, counted over all shards. Every shard meets every block:
    blocks are broadcast if they have at most `small` entries, else both are dealt to (block, group of shards). A task
    searches its shards' trees one after another, starting each from the k-th best score of those before, and sends
    k rows an item. A window over the item's row merges them, cut again before the exchange.

    Items of null or termless text find nothing; repeated items are searched each; a null item_id is returned as such.
    Documents of score 0 or less are never found. Without documents there is no row.
    """
    asked, parts, entries = _asked(items, index.trees, scratch)
    documents = index.documents
    fields = ["q_key", "q_item_id", "q_term", "q_qtf", "q_df"]
    # Bounded rows for Arrow: a shard's tree is some megabytes.
    trees = index.trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if entries <= small:
        pairs = trees.join(F.broadcast(asked), "part")
    else:
        grouped = trees.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(GROUPS)).cast("int"))
        copies = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
        pairs = grouped.join(copies.hint("shuffle_hash"), ["part", "group"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: dict = {}  # of a query's key: its item id and at most k rows (score, known, id), best first
        tree, loaded = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if loaded != row["shard"].as_py():
                    plain = {c: row[c].as_py() for c in ("ids", "known", "counts", "sizes", "bits", "impacts")}
                    tree, loaded = Tree(plain | {"terms": row["terms"].values}), row["shard"].as_py()
                keys, item_ids = np.array(row["q_key"].values, np.int64), row["q_item_id"].as_py()
                qtf, df = np.array(row["q_qtf"].values, np.int64), row["q_df"].as_py()
                weights = qtf * np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df], np.int64)
                lo, hi = tree.ranges(row["q_term"].as_py())
                own, first = np.unique(keys, return_index=True)
                query = np.searchsorted(own, keys)
                for a in range(0, len(own), AT_ONCE):
                    b = min(len(own), a + AT_ONCE)
                    at = (query >= a) & (query < b) & (weights > 0)
                    least = np.array([best[q][1][-1][0] if q in best and len(best[q][1]) == k else 1 for q in own[a:b].tolist()], np.int64)
                    q, d, s = search_tree(tree, query[at] - a, weights[at], lo[at], hi[at], least, k)
                    for j in np.unique(q).tolist():
                        mine = q == j
                        rows = [(int(x), bool(tree.known[y]), int(tree.ids[y])) for x, y in zip(s[mine], d[mine], strict=True)]
                        held = best.setdefault(int(own[a + j]), (item_ids[first[a + j]], []))[1]
                        held.extend(rows)
                        held.sort(key=lambda r: (-r[0], not r[1], r[2]))
                        del held[k:]
        rows = [(key, item, i if known else None, s) for key, (item, held) in best.items() for s, known, i in held]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "item_id", "doc_id", "score"])

    kept = ["shard", "ids", "known", "terms", "counts", "sizes", "bits", "impacts"]
    partial = pairs.select(*kept, *fields).mapInArrow(run, "key long, item_id long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
