"""Operator 10: language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, iterated, slices

#: Characters a gram, hash functions, and how many distinct labelled texts of a language a fit uses.
GRAM, HASHES, SAMPLE = 5, 3, 2000
#: A language has the grams that this share of its sampled texts hold, one text at least: texts quote other languages.
SUPPORT = 0.01
#: Slots of the filters at most, and bytes that all languages' filters may take together: of more languages each has fewer slots.
SLOTS, BYTES = 1 << 20, 1 << 26
UNDECIDED = "und"


@dataclass
class LanguageFilters:
    """words[slot, i]: bit l of word i is set if language 64 i + l may contain a gram of that slot; false_positive: each language's odds.

    Languages are in order of their number of learned texts, most first, so that ties go to the commoner one.
    """

    languages: list[str]
    words: object
    false_positive: object


def gram_hashes(text: str):
    """64-bit hashes of the character n-grams of a text: letters in lower case, anything else one blank, words padded by blanks."""
    import numpy as np

    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(_letters()[np.minimum(codes, 0x10FFFF)], codes, 32)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]].astype(np.uint64)
    n = len(codes) - GRAM + 1
    if n < 1:
        codes, n = np.r_[codes, np.full(1 - n, 32, np.uint64)], 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x100000001B3) ^ (codes[k : k + n] + np.uint64(0x9E37))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


_LETTERS: list = []


def _letters():
    """Whether each code point is a letter; made once a process."""
    if not _LETTERS:
        import numpy as np

        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def slots(hashes, size: int):
    """HASHES slots of each gram by double hashing; size is a power of two."""
    import numpy as np

    step = hashes >> np.uint64(40) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def filter_size(languages: int) -> int:
    """Slots for so many languages: SLOTS, or as many as BYTES allow."""
    size = SLOTS
    while size > 1024 and size * 8 * max(1, -(-languages // 64)) > BYTES:
        size //= 2
    return size


def filters(languages: list[str], words) -> LanguageFilters:
    import numpy as np

    full = np.array([np.count_nonzero(words[:, i // 64] & np.uint64(1 << i % 64)) / len(words) for i in range(len(languages))])
    return LanguageFilters(languages, words, full**HASHES)


def learn(docs: DataFrame, sample: int = SAMPLE, support: float = SUPPORT) -> LanguageFilters:
    """Learns from (text, lang): of every language all its distinct texts, or about `sample` of them, those with the smallest hashes.

    Every gram that the share `support` of a language's sampled texts holds, or one of up to 1 / support texts, goes into
    its filter, whatever other languages hold it. Tasks turn grams into the filters' slots; bits are joined by an
    aggregate over slots, and the driver gets that table: at most BYTES, whatever the numbers of rows, grams and
    languages. Copies of a text count once, so a language of many copies of few texts keeps them all. Null texts and
    null languages teach nothing; an empty table gives no language; extra columns are ignored; long texts are read whole.
    """
    import numpy as np

    rated = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("own"))
    sizes = [(r["lang"], r["n"], r["texts"]) for r in rated.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("own").alias("texts")).collect()]
    languages = [lang for lang, _, _ in sorted(sizes, key=lambda r: (-r[1], r[0]))]
    size, width = filter_size(len(languages)), max(1, -(-len(languages) // 64))
    words = np.zeros((size, width), np.uint64)
    if not languages:
        return filters([], words)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for part in slices(batch):
                for lang, own in part.groupby("lang")["text"]:
                    grams, n = np.unique(np.concatenate([np.unique(gram_hashes(t)) for t in own]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    def mark(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        at = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            for lang, grams in batch.groupby("lang")["gram"]:
                where, i = np.unique(np.concatenate(slots(grams.to_numpy(np.int64).view(np.uint64), size))), at[lang]
                yield pd.DataFrame({"word": np.full(len(where), i // 64, np.int32), "slot": where, "mask": np.full(len(where), np.array(1 << i % 64, np.uint64).view(np.int64))})

    # The share of a language's distinct texts that is taken, a little over what the estimated number asks for, and how many of them must hold a gram.
    share = {lang: min(1.0, 1.1 * sample / texts) if texts > sample else 1.0 for lang, _, texts in sizes}
    least = {lang: max(1, math.ceil(support * share[lang] * texts)) for lang, _, texts in sizes}
    table = lambda of: F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(of[lang]))])[F.col("lang")]
    scale = 1 << 24
    distinct = rated.where(F.pmod(F.col("own"), F.lit(scale)) < table(share) * scale).groupBy("lang", "own").agg(F.first("text").alias("text"))
    grams = distinct.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= table(least))
    bits = grams.select("lang", "gram").mapInPandas(mark, "word int, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    got = bits.toPandas()
    words[got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return filters(languages, words)


def decide(text: str | None, model: LanguageFilters) -> tuple[str, float]:
    """The language whose filter holds the most of the text's grams beyond its false positives; score: that share, in 0..1.

    `und` and 0 without a letter or without a learned language; ties, and texts of which no filter holds a gram, go to
    the language with most learned documents.
    """
    import numpy as np

    if not model.languages or not has_letter(text):
        return UNDECIDED, 0.0
    hashes = gram_hashes(text)
    hits = np.zeros(len(model.languages))
    for at in range(0, len(hashes), 1 << 16):
        part = slots(hashes[at : at + (1 << 16)], len(model.words))
        masks = model.words[part[0]]
        for s in part[1:]:
            masks = masks & model.words[s]
        for i in range(len(model.languages)):
            hits[i] += np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64))
    share = np.clip((hits / len(hashes) - model.false_positive) / np.maximum(1e-9, 1 - model.false_positive), 0, 1)
    best = int(np.argmax(share))
    return model.languages[best], float(share[best])


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """Adds lang_pred and score to the documents' columns; only the text is looked at, long ones whole. Repeated rows get the
    same result each; an empty table gives no row. Extra columns are kept whatever their names, those named as the added ones replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @iterated("lang_pred string, score double")
    def of(texts: Iterator) -> Iterator:
        import pandas as pd

        model = shared.value
        for batch in texts:
            yield pd.DataFrame([decide(t, model) for t in batch], columns=["lang_pred", "score"])

    (both,) = free(docs, "_lang")
    named = docs.withColumn(both, of("text"))
    return named.withColumns({"lang_pred": F.col(f"{both}.lang_pred"), "score": F.col(f"{both}.score")}).drop(both)
