"""Operator 3: token-id files under Re-Pair grammar compression, one grammar a block, with random access."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, encoder, slices

#: The first nonterminal; every tokenizer's ids lie below it.
NONTERMINAL = 1 << 20
#: Ids a block holds before it is closed, and how often a pair must occur in a block to be replaced.
BLOCK, FREQUENT = 1 << 19, 8
FORMAT = "task long, block long, task_start long, total long, doc_ids array<long>, counts binary, ends binary, rules binary, lengths binary, stream binary"


def compress(ids, last, frequent: int = FREQUENT):
    """Re-Pair in rounds: (stream, which symbols end a document, rules as pairs).

    Each round counts adjacent pairs that lie within a document and replaces every pair that occurs at least `frequent`
    times; where two of them overlap the more frequent one goes first, of equal symbols the left. A pair that has just
    become frequent holds a symbol of the round before, so a round looks beside those only. Pairs are counted in a table
    by hash, of another hash each round; of pairs that share a slot one is taken. When a round finds none, all pairs are counted once more, those in full slots one by
    one, so that it ends only when no pair is frequent (of equal symbols: so frequent that overlaps don't matter).
    """
    import numpy as np

    seq, rules, made, fresh, turn = ids.astype(np.uint32), [], 0, None, 0
    while len(seq) >= 2 * frequent:
        if fresh is None:
            place, left, right, closed = None, seq[:-1], seq[1:], np.flatnonzero(last[:-1])
        else:
            near = np.zeros(len(seq), bool)
            near[fresh] = True
            near[fresh[fresh > 0] - 1] = True
            near[-1] = False
            place = np.flatnonzero(near & ~last)
            left, right, closed = seq[place], seq[place + 1], place[:0]
        bits = max(10, min(20, len(left).bit_length()))
        none = 1 << bits
        m, k = np.random.default_rng(turn).integers(1 << 30, 1 << 32, 2, np.uint32) | np.uint32(1)
        slot = ((left * m + right * k) >> np.uint32(32 - bits)).astype(np.int32)
        slot[closed] = none
        turn += 1
        counts = np.bincount(slot, minlength=none + 1)
        counts[none] = 0
        at = np.flatnonzero((counts >= frequent)[slot])
        at_all, here, holder = at, slot[at], np.zeros(none + 1, np.intp)
        holder[here] = at
        own = holder[here]
        same = (left[own] == left[at]) & (right[own] == right[at])
        at, here = at[same], here[same]
        times = np.bincount(here, minlength=none + 1)
        enough = times[here] >= np.where(left[at] == right[at], 2 * frequent, frequent)
        at, here = at[enough], here[enough]
        where = at if place is None else place[at]
        # Of two pairs that overlap the rarer loses its place; the most frequent pair loses none.
        rank = times[here] * (none + 1) + here
        beside = where[1:] == where[:-1] + 1
        lost = np.zeros(len(where), bool)
        lost[1:] |= beside & (rank[1:] < rank[:-1])
        lost[:-1] |= beside & (rank[:-1] < rank[1:])
        where, here = where[~lost], here[~lost]
        # What still overlaps is a run of equal symbols: every second pair from the left.
        begin = np.flatnonzero(np.append(True, where[1:] != where[:-1] + 1)) if len(where) else where
        even = (np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where))))) % 2 == 0
        where, here = where[even], here[even]
        chosen = np.flatnonzero(np.bincount(here, minlength=none + 1) >= frequent)
        if not len(chosen):
            if fresh is None and not _frequent(left[at_all], right[at_all], frequent):
                break
            fresh = None
            continue
        number = np.zeros(none + 1, np.uint32)
        number[chosen] = np.arange(len(chosen), dtype=np.uint32) + np.uint32(NONTERMINAL + made)
        names = number[here]
        where, names = where[names > 0], names[names > 0]
        rules.append(np.stack([left[holder[chosen]], right[holder[chosen]]], 1))
        made += len(chosen)
        seq[where] = names
        last[where] |= last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        fresh = where - np.arange(len(where))  # where the new symbols now are
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _frequent(left, right, frequent: int) -> bool:
    """Whether one of these pairs is frequent, counted one by one."""
    import numpy as np

    pairs, n = np.unique(left.astype(np.uint64) << np.uint64(32) | right, return_counts=True)
    equal = pairs >> np.uint64(32) == pairs & np.uint64(0xFFFFFFFF)
    return bool((n >= np.where(equal, 2 * frequent, frequent)).any())


def batches(rules) -> Iterator[tuple[int, int]]:
    """Runs of rules (from, to) that only use symbols made before the run."""
    import numpy as np

    newest, first = np.maximum.accumulate(rules.max(1).astype(np.int64) - NONTERMINAL), 0
    while first < len(rules):
        end = max(first + 1, int(np.searchsorted(newest, first)))
        yield first, end
        first = end


def rule_lengths(rules):
    """The number of ids of every rule."""
    import numpy as np

    lengths = np.ones(len(rules) + 1, np.int64)  # the last one stands for an id
    parts = rules.astype(np.int64) - NONTERMINAL
    parts[parts < 0] = len(rules)
    for s, e in batches(rules) if len(rules) else ():
        lengths[s:e] = lengths[parts[s:e, 0]] + lengths[parts[s:e, 1]]
    return lengths[:-1]


def expansions(rules):
    """All rules written out: (ids, starts, lengths). Each run of rules is written from those before it."""
    import numpy as np

    lengths = rule_lengths(rules)
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    for s, e in batches(rules) if len(rules) else ():
        done = int(starts[s])
        flat[done : int(starts[e - 1] + lengths[e - 1])] = expand(rules[s:e].reshape(-1), flat[:done], starts, lengths)
    return flat, starts, lengths


def expand(stream, flat, starts, lengths):
    """The ids of a part of a stream: one gather from the rules' ids followed by the stream itself, whose ids stand for themselves."""
    import numpy as np

    if not len(stream):
        return stream.copy()
    ruled = np.flatnonzero(stream >= NONTERMINAL)
    rule = stream[ruled] - np.uint32(NONTERMINAL)
    sizes, source = np.ones(len(stream), np.int32), np.arange(len(flat), len(flat) + len(stream), dtype=np.int64)
    sizes[ruled], source[ruled] = lengths[rule], starts[rule]
    ends = np.cumsum(sizes, dtype=np.int64)
    kind = np.int32 if len(flat) + len(stream) + int(ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((source - ends + sizes).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return np.concatenate([flat, stream])[at]


def write_tokens(docs: DataFrame, scratch: Scratch, tag: str = "tokens", tokenizer: str = "byte_bpe_50k.json", end: int = 0, block: int = BLOCK) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order and returns the table of blocks, read back.

    A block row has its documents' ids, id counts, the ends of their symbols in the stream, the grammar's rules, each
    rule's expansion length, and the stream: all binary little-endian unsigned 32-bit. Rows are dealt by ranges of
    doc_id (ties by the text's hash), so a hot doc_id doesn't land in one task unless its rows are equal; a task holds one
    block at a time. Null texts are empty documents, null doc_ids come first, repeated rows are written as often as
    they occur, extra columns are ignored, and an empty table gives no block.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        task, number, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        raws: list[bytes] = []
        held = 0

        def close():
            nonlocal number, before, held
            counts = np.array([len(r) // 4 for r in raws], np.uint32)
            ids = np.frombuffer(b"".join(raws), "<u4")
            last = np.zeros(len(ids), bool)
            last[np.cumsum(counts) - 1] = True
            stream, closes, rules = compress(ids, last)
            lengths = rule_lengths(rules)
            row = (task, number, before, len(ids), list(names), counts.tobytes(), (np.flatnonzero(closes) + 1).astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), stream.astype("<u4").tobytes())
            number, before, held = number + 1, before + len(ids), 0
            names.clear()
            raws.clear()
            return pd.DataFrame([row], columns=[c.split()[0] for c in FORMAT.split(", ")])

        for batch in batches:
            for part in slices(batch):
                raws_here = encoder(tokenizer).encode(part["text"], end)
                for name, raw in zip(part["doc_id"], raws_here, strict=True):
                    names.append(None if pd.isna(name) else int(name))
                    raws.append(raw)
                    held += len(raw) // 4
                    if held >= block:
                        yield close()
        if raws:
            yield close()

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    tie = F.xxhash64("text")
    return scratch.save(slim.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInPandas(run, FORMAT), tag)


def read_tokens(blocks: DataFrame, include_ids: bool = False) -> DataFrame:
    """Every document from its block: doc_id, start (ids before it in the whole corpus), n_tokens, ids_crc32, and its ids if asked for.

    Only the number of ids of each writing task comes to the driver: as many rows as the write had tasks.
    """
    totals = sorted((r["task"], r["n"]) for r in blocks.groupBy("task").agg(F.sum("total").alias("n")).collect())
    bases, so_far = {}, 0
    for task, n in totals:
        bases[task], so_far = so_far, so_far + n

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                counts = np.frombuffer(b.counts, "<u4").astype(np.int64)
                ends = np.frombuffer(b.ends, "<u4").astype(np.int64)
                stream = np.frombuffer(b.stream, "<u4")
                flat, starts, lengths = expansions(np.frombuffer(b.rules, "<u4").reshape(-1, 2))
                if not np.array_equal(lengths, np.frombuffer(b.lengths, "<u4")):
                    raise ValueError("a block's expansion lengths don't fit its rules")
                first = bases[b.task] + b.task_start + np.cumsum(counts) - counts
                ids = expand(stream, flat, starts, lengths).astype("<u4").tobytes()
                cuts = np.r_[0, np.cumsum(counts)].tolist()
                raw = [ids[4 * s : 4 * e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                if len(ends) != len(counts) or cuts[-1] * 4 != len(ids):
                    raise ValueError("a block's documents don't fit its stream")
                out = pd.DataFrame({"doc_id": pd.array(list(b.doc_ids), "Int64"), "start": first, "n_tokens": counts, "ids_crc32": [zlib.crc32(r) for r in raw]})
                if include_ids:
                    out["ids"] = raw
                yield out

    return blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * include_ids)


def read_range(block, document: int, start: int, n: int):
    """Random access: n ids of one document of a block row from its id `start`. Only the rules that hold them are followed: expansion lengths say
    which halves lie before them, so the work is n plus the grammar's depth."""
    import numpy as np

    ends = np.frombuffer(block["ends"], "<u4")
    lengths, rules = np.frombuffer(block["lengths"], "<u4"), np.frombuffer(block["rules"], "<u4").reshape(-1, 2)
    part = np.frombuffer(block["stream"], "<u4")[int(ends[document - 1]) if document else 0 : int(ends[document])].astype(np.int64)
    whole = part >= NONTERMINAL
    sizes = np.ones(len(part), np.int64)
    sizes[whole] = lengths[part[whole] - NONTERMINAL]
    reach = np.cumsum(sizes)
    first = int(np.searchsorted(reach, start, "right"))
    last = int(np.searchsorted(reach, start + n, "left")) + 1
    skip, out, stack = start - (int(reach[first - 1]) if first else 0), [], part[first:last][::-1].tolist()
    while stack and len(out) < n:
        symbol = stack.pop()
        size = int(lengths[symbol - NONTERMINAL]) if symbol >= NONTERMINAL else 1
        if skip >= size:
            skip -= size
        elif symbol < NONTERMINAL:
            out.append(symbol)
        else:
            left, right = rules[symbol - NONTERMINAL].tolist()
            stack += [right, left]
    return np.array(out, np.int64)


def token_table(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Written, then read back from the files."""
    return read_tokens(write_tokens(docs, Scratch(spark, "token-files"), **options))
