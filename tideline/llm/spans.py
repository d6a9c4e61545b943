"""Operator 8: substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, iterated, slices

#: Consecutive sentences that a span has at least, and words that it must reach: it takes in further sentences until it does.
SENTENCES, LEAST_WORDS = 2, 12
#: A sentence of so many words counts as several, of half as many words each, so that a passage of few long ones is met too.
LONG = 20
#: Characters that stand for a word where a text has few blanks.
UNSPACED = 10
# Latin, Arabic and Urdu stops need white space behind them; Chinese, Japanese, Devanagari and Ethiopic ones don't.
_ENDS = re.compile("[.!?؟۔]+[\"')\\]]*\\s+|[。！？｡।॥።]+[\"')\\]」』’”]*\\s*|\\n+")


def sentences(text: str | None, long: int = LONG) -> list[tuple[int, int]]:
    """The sentences' bounds (code points), gapless: each ends after its full stop and the white space behind it, or at a line's end.
    One of `long` words or more is cut behind every (long / 2)-th."""
    if not text:
        return []
    cuts = [m.end() for m in _ENDS.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    whole = list(zip([0, *cuts[:-1]], cuts, strict=True))
    if not any(b - a >= 2 * long - 1 for a, b in whole):
        return whole
    pieces, out = _pieces(long), []
    for a, b in whole:
        if b - a >= 2 * long - 1 and len(text[a:b].split()) >= long:
            ends = [m.end() for m in pieces(text, a, b)]
            out += zip([a, *ends[:-1]], ends, strict=True)
        else:
            out.append((a, b))
    return out


_PIECES: dict = {}


def _pieces(long: int):
    if long not in _PIECES:
        _PIECES[long] = re.compile(rf"\s*\S+(?:\s+\S+){{0,{max(1, long // 2) - 1}}}\s*").finditer
    return _PIECES[long]


def counted(words: list[str]) -> bool:
    """Whether a sentence counts: it has more than a lone sign."""
    return len(words) > 1 or bool(words) and any(map(str.isalnum, words[0]))


def span_hashes(text: str | None, size: int = SENTENCES, least: int = LEAST_WORDS, long: int = LONG) -> list[tuple[int, int, int]]:
    """(first, last, hash): from each counted sentence on, the run of at least `size` counted sentences that reaches `least` words.

    Case and white space don't matter. A text of fewer counted sentences than `size` is one run, if it has so many words. A
    sentence's words are those between white space, or one for UNSPACED characters if that is more.
    """
    import xxhash

    digest, weights, prints = xxhash.xxh64_digest, [], []
    low = text.lower() if text else ""
    # Lower case may change a text's length; sentences are then lowered one by one.
    same = low if text and len(low) == len(text) else None
    for a, b in sentences(text, long):
        words = same[a:b].split() if same is not None else text[a:b].lower().split()
        if counted(words):
            plain = " ".join(words)
            weights.append(max(len(words), len(plain) // UNSPACED))
            prints.append(digest(plain.encode("utf-8", "surrogatepass"), 5))
    n, out, last, total = len(prints), [], -1, 0
    for first in range(max(1, n - size + 1) if n else 0):
        floor = min(first + size, n) - 1
        while last + 1 < n and (last < floor or total < least):
            last += 1
            total += weights[last]
        if total < least:
            break
        out.append((first, last, int.from_bytes(digest(b"".join(prints[first : last + 1]), 6), "little", signed=True)))
        total -= weights[first]
    return out


def span_table(docs: DataFrame, size: int = SENTENCES, least: int = LEAST_WORDS, long: int = LONG) -> DataFrame:
    """(doc_id, row_hash, span, hash): every document's spans, the span as first sentence above 32 bits of the last one."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for part in slices(batch):
                sizes, spans, hashes = [], [], []
                for text in part["text"]:
                    got = span_hashes(text, size, least, long)
                    sizes.append(len(got))
                    spans += [g[0] << 32 | g[1] for g in got]
                    hashes += [g[2] for g in got]
                at = np.repeat(np.arange(len(part)), sizes)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array[at], "row_hash": part["row_hash"].to_numpy()[at], "span": np.array(spans, np.int64), "hash": np.array(hashes, np.int64)})

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return slim.mapInPandas(run, "doc_id long, row_hash long, span long, hash long")


def repeated_spans(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row_hash, spans): for every document with any, the spans that occur before elsewhere or earlier in it.

    "Before" is the order of (doc_id, text hash, span). Each hash's first place comes from an aggregate with map-side
    combine, and only hashes that occur twice or more are written and meet the spans again. Both sides of that join are
    plain exchanges, so the adaptive join splits the rows of a span that a third of all documents share.
    """
    place = F.struct("doc_id", "row_hash", "span")
    firsts = found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    repeated = scratch.save(firsts, "repeated")
    later = found.join(repeated, "hash").where(place != F.col("first"))
    gone = scratch.save(later.groupBy("doc_id", "row_hash").agg(F.collect_set("span").alias("spans")), "gone")
    scratch.drop("repeated")
    return gone


def cut_text(text: str | None, spans, long: int = LONG) -> tuple:
    """(text without the spans' counted sentences, sentences, sentences cut, [start, end) of each part cut)."""
    bounds = sentences(text, long)
    if spans is None or not len(spans):
        return text, len(bounds), 0, []
    kept = [i for i, (a, b) in enumerate(bounds) if counted(text[a:b].split())]
    gone = sorted({kept[i] for s in map(int, spans) for i in range(s >> 32, (s & 0xFFFFFFFF) + 1)})
    ranges: list[list[int]] = []
    for i in gone:
        a, b = bounds[i]
        if ranges and ranges[-1][1] == a:
            ranges[-1][1] = b
        else:
            ranges.append([a, b])
    left, at = [], 0
    for a, b in ranges:
        left.append(text[at:a])
        at = b
    return "".join([*left, text[at:]]), len(bounds), len(gone), ranges


def dedup_spans(docs: DataFrame, scratch: Scratch, size: int = SENTENCES, least: int = LEAST_WORDS, long: int = LONG) -> DataFrame:
    """Documents without the sentences that any non-first repeated span covers.

    Returns all columns, with text cut, and n_sentences, n_removed and removed (the cut parts as [start, end) code
    points of the old text). The first occurrence of every span stays. Every text is split and hashed once, into a
    written table of slim rows. Rows equal in doc_id and text can't be told apart, share one decision and count as one. A
    null doc_id comes before all others; null and empty texts, and texts under `least` words, have no span and stay
    as they are; very long texts are handled whole, a part of a batch at a time. An empty table gives no row. Extra
    columns are kept whatever their names, those named as the added ones replaced.
    """
    row, id_, d, r, spans_, cut_ = free(docs, "_row", "_id", "_d", "_r", "_spans", "_cut")
    keyed = docs.withColumn(row, F.xxhash64("text")).withColumn(id_, F.col("doc_id").cast("bigint"))
    found = scratch.save(span_table(docs, size, least, long), "spans")
    spans = repeated_spans(found, scratch).select(F.col("doc_id").alias(d), F.col("row_hash").alias(r), F.col("spans").alias(spans_))
    scratch.drop("spans")
    met = keyed.join(spans, F.col(id_).eqNullSafe(F.col(d)) & (F.col(row) == F.col(r)), "left")

    @iterated("text string, n_sentences int, n_removed int, removed array<array<int>>")
    def cut(parts: Iterator) -> Iterator:
        import pandas as pd

        for texts, gone in parts:
            for at in range(0, len(texts), 256):
                rows = [cut_text(t, s, long) for t, s in zip(texts.iloc[at : at + 256], gone.iloc[at : at + 256], strict=True)]
                yield pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "removed"])

    done = met.withColumn(cut_, cut(F.col("text"), F.col(spans_))).drop(row, id_, d, r, spans_)
    return done.withColumns({c: F.col(f"{cut_}.{c}") for c in ("text", "n_sentences", "n_removed", "removed")}).drop(cut_)
