"""Operator 1: packing token sequences into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import encoder, slices

WINDOW = 4096
#: Windows that are levelled together, tokens a window given as fine filler, and tokens a window left free.
WINDOWS, FILLER, SLACK = 64, 256, 2
#: Ids that a task holds at most before it levels what it has (a longer document is held alone).
HELD = 1 << 22


def difference(sizes: list[int], k: int) -> list[int]:
    """The window of each item: k near-equal windows by multiway differencing.

    Each partial partition holds k sums, largest first. The two partitions with the largest spreads merge, the largest
    sum of one with the smallest of the other, until one partition is left. How the sums of each merge are reordered is
    kept, and read backwards it gives every item's window.
    """
    import numpy as np

    if not sizes:
        return []
    if k == 1:
        return [0] * len(sizes)
    heap, made = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-int(size), i, sums))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = x + y[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        made.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), n + len(made) - 1, both))
    windows = {heap[0][1]: np.arange(k)}
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, order = made[node - n]
        here = windows.pop(node)
        left, right = np.empty(k, np.int64), np.empty(k, np.int64)
        left[order] = here
        right[k - 1 - order] = here
        windows[a], windows[b] = left, right
    return [int(windows[i][0]) for i in range(n)]


def powers(n: int, window: int) -> list[int]:
    """n as full windows and falling powers of two: sequences that need no padding."""
    out = [window] * (n // window)
    rest = n % window
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def plan(lengths: list[int], window: int = WINDOW, filler: int = FILLER, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length).

    Full windows of long documents stand alone. Of the rests, as many windows as can be filled to within `slack` are
    levelled by differencing; the largest rests are cut into filler for that. Ids beyond those windows make sequences
    at powers of two. If a window exceeds its capacity, the window count rises by one and differencing starts again.
    """
    sequences, rests = [], []
    for d, n in enumerate(lengths):
        full = n // window * window
        sequences += [[(d, s, window)] for s in range(0, full, window)]
        if n > full:
            rests.append((d, full, n - full))
    total = sum(r[2] for r in rests)
    k = total // window
    tail = total - k * (window - slack) if k else total
    rests.sort(key=lambda r: (r[2], r[0]))

    def take(amount: int) -> list[tuple[int, int, int]]:
        """Pieces of so many ids in all, from the largest rests."""
        out = []
        while amount > 0 and rests:
            d, s, n = rests.pop()
            used = min(n, amount)
            out.append((d, s + n - used, used))
            if n > used:
                rests.append((d, s, n - used))
            amount -= used
        return out

    stock = take(tail)[::-1]
    for size in powers(tail, window):
        one = []
        while size:
            d, s, n = stock.pop()
            used = min(n, size)
            one.append((d, s, used))
            if n > used:
                stock.append((d, s + used, n - used))
            size -= used
        sequences.append(one)
    if not k:
        return sequences
    items = []
    for d, s, n in take(min(k * filler, sum(r[2] for r in rests))):
        step = filler // 2
        while n:
            size = min(step, n)
            items.append((d, s, size))
            s, n, step = s + size, n - size, max(1, step // 2) if step > 1 else filler // 2
    items += rests
    while True:
        places = difference([i[2] for i in items], k)
        sums = [0] * k
        for w, item in zip(places, items, strict=True):
            sums[w] += item[2]
        if max(sums) <= window:
            break
        k += 1
    windows: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for w, item in zip(places, items, strict=True):
        windows[w].append(item)
    return sequences + [sorted(w) for w in windows if w]


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 2, window: int = WINDOW, windows: int = WINDOWS, include_ids: bool = False) -> DataFrame:
    """Every document's ids, cut and placed into sequences of at most `window` ids.

    One pass without a shuffle: a task encodes its rows, and levels a shard of about `windows` windows of documents' rests
    at a time, or sooner once it holds `HELD` ids; it never holds more than that and one document. Sequences are numbered by task and shard, so a repeated task
    writes the same rows. Repeated rows are packed as often as they occur; a null text has only its end id; a null
    doc_id stays null; extra columns are ignored; an empty table gives no row. `include_ids` adds the ids themselves
    (binary, little-endian unsigned 32-bit).
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list = []
        waiting = held = 0

        def flush():
            nonlocal shard, waiting, held
            rows = []
            for local, sequence in enumerate(plan([len(x) // 4 for x in ids], window)):
                offset, number = 0, task << 40 | shard << 20 | local
                for d, start, n in sequence:
                    raw = ids[d][4 * start : 4 * (start + n)]
                    rows.append((names[d], start, n, zlib.crc32(raw), len(ids[d]) // 4, number, offset, *([raw] if include_ids else [])))
                    offset += n
            shard, waiting, held = shard + 1, 0, 0
            ids.clear()
            names.clear()
            out = pd.DataFrame(rows, columns=COLUMNS + ["ids"] * include_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for batch in batches:
            for part in slices(batch):
                for name, raw in zip(part["doc_id"], encoder(tokenizer).encode(part["text"], end), strict=True):
                    ids.append(raw)
                    names.append(None if pd.isna(name) else int(name))
                    waiting += len(raw) // 4 % window
                    held += len(raw) // 4
                    if waiting >= windows * window or len(ids) >= 1 << 14 or held >= HELD:
                        yield flush()
        if ids:
            yield flush()

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return slim.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * include_ids)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
