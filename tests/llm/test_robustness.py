"""Clashing column names, hot rows and tiny tables; mixing, likeness, language filters and the ordinal fit against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tideline.llm")
from pyspark.sql import functions as F

from tests.llm.test_operators import COLUMNS, ODD, brute_winnow, words_of
from tideline.llm import langid, lines, mixing, quality, simhash, spans, winnowing
from tideline.llm.common import Scratch

HIDDEN = ["_row", "_d", "_r", "_text", "_gone", "_id", "_spans", "_cut", "_scored", "_lang", "_source", "_own", "_epochs", "_blocks", "_turn", "_place"]


def test_hidden_names_of_other_columns_are_kept(spark):
    docs = spark.createDataFrame([r for r in ODD if r[0] != 5], COLUMNS).withColumns({c: F.lit(9) for c in HIDDEN})
    model, text = quality.fit([]), langid.learn(docs)
    made = [lines.dedup_lines(docs, Scratch(spark, "t")), spans.dedup_spans(docs, Scratch(spark, "t")), mixing.mix(docs, Scratch(spark, "t")), quality.score(docs, model), langid.predict(docs, text)]
    for df in made:
        rows = df.collect()
        assert set(docs.columns) <= set(df.columns) and len(rows) >= 7
        assert all(r[c] == 9 for r in rows for c in HIDDEN)


def test_dotted_and_quoted_names_are_kept(spark):
    import corpus_pipeline

    odd = {"a.b": F.lit(1), "c`d": F.lit(2), "text.x": F.lit(3)}
    docs = spark.createDataFrame([(i, f"the text number {i} of a few good ones", "en", f"s{i % 2}", 9) for i in range(6)], COLUMNS).withColumns(odd)
    for df in [lines.dedup_lines(docs, Scratch(spark, "t")), spans.dedup_spans(docs, Scratch(spark, "t")), mixing.mix(docs, Scratch(spark, "t")), quality.score(docs, quality.fit([])), langid.predict(docs, langid.learn(docs))]:
        assert set(odd) <= set(df.columns) and df.count() >= 6
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.count() >= 1, name


def test_copies_of_a_row_are_dealt_over_blocks(spark):
    rows = [(1, "a b c d e", "en", "hot", 1)] * 4000 + [(i, f"x{i} y", "en", f"s{i % 2}", 1) for i in range(2, 40)]
    got = mixing.mix(spark.createDataFrame(rows, COLUMNS).repartition(3), Scratch(spark, "t"), block=1000).groupBy("doc_id", "block").count().collect()
    hot = [r["count"] for r in got if r["doc_id"] == 1]
    assert sum(hot) == 4000 and len(hot) == 20 and max(hot) < 400


def test_mixing_takes_each_block_in_order_and_within_its_budget(spark):
    rng, rows = random.Random(2), []
    for i in range(700):
        rows.append((i, " ".join(words_of(rng.randint(1, 60), i)), "en", "big" if i % 3 else f"s{i % 5}", 1))
    got = mixing.mix(spark.createDataFrame(rows, COLUMNS), Scratch(spark, "t"), entropy=None, repetition=1.7, block=1500).collect()
    tokens = {r[0]: len(r[1].split()) for r in rows}
    totals, source = Counter(), {r[0]: r[3] for r in rows}
    for d, n in tokens.items():
        totals[source[d]] += n
    largest = max(totals.values())
    a = next(a for a in np.linspace(0, 1, 200_001) if (largest / min(totals.values())) ** (1 - a) <= 1.7)
    blocks = defaultdict(list)
    for r in got:
        blocks[r["source"], r["block"]].append(r)
    assert {s: len({b for t, b in blocks if t == s}) for s in totals} == {s: math.ceil(n / 1500) for s, n in totals.items()}
    for (s, _), rs in blocks.items():
        once = sorted((r for r in rs if r["copy"] == 0), key=lambda r: r["position"])
        assert [r["position"] for r in once] == list(range(1, len(once) + 1))
        epochs = (largest / totals[s]) ** (1 - a)
        budget, before = (epochs - math.floor(epochs)) * sum(r["tokens"] for r in once), 0
        copies = Counter(r["doc_id"] for r in rs)
        for r in once:
            edge = abs(before + r["tokens"] / 2 - budget) < 0.05
            assert edge or copies[r["doc_id"]] == math.floor(epochs) + (before + r["tokens"] / 2 <= budget)
            before += r["tokens"]


def xx(words):
    """Spark's xxhash64 of several strings: each one's hash seeds the next."""
    import xxhash

    seed = 42
    for w in words:
        if w is not None:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def xx_long(value):
    import xxhash

    return xxhash.xxh64_intdigest(value.to_bytes(8, "little"), 42)


def plain_winnow(text):
    """Places and 31-bit hashes of the chosen grams, by the definition."""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").lower()).split(" ") if w]
    grams = []
    for i in range(max(1, len(words) - winnowing.GRAM + 1)) if words else []:
        value = 0
        for k in range(winnowing.GRAM):
            value = (value * winnowing.BASE + (xx(words[i + k : i + k + 1]) >> 33 if i + k < len(words) else 0)) % winnowing.MODULUS
        grams.append(xx_long(value) >> 33)
    chosen = set()
    for at in range(max(1, len(grams) - winnowing.WINDOW + 1) if grams else 0):
        window = range(at, min(len(grams), at + winnowing.WINDOW))
        chosen.add(min(window, key=lambda p: (grams[p], -p)))
    return [(p, grams[p]) for p in sorted(chosen)]


def test_fingerprints_and_likeness_by_the_definition(spark):
    rng = random.Random(6)
    texts = [" ".join(words_of(n, n, 60)) for n in (*range(1, 24), 200)] + [None, "", "one two three four five six seven eight nine ten", "x " * 300]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in winnowing.edited_likeness(spark.createDataFrame(rows, COLUMNS), Scratch(spark, "t")).collect()}
    write = lambda chosen: " ".join(f"{h:08x}:{p}" for p, h in chosen)

    def near(a, b):
        a, b = ({h for _, h in c} for c in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for d, text in enumerate(texts):
        text, after = text or "", texts[d - 1] or ""  # the next by descending id; after the last the first
        n = len(text)
        own, changed = plain_winnow(text), plain_winnow(text[: n - n // 3] + after[: n // 3])
        assert got[d]["fingerprint"] == write(own) and got[d]["edited_fingerprint"] == write(changed)
        assert got[d]["near_edited"] == pytest.approx(near(own, changed)) and got[d]["near_next"] == pytest.approx(near(own, plain_winnow(after)))
    assert len(brute_winnow(texts[23])) == 198


def test_languages_of_one_document_each(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a", 1), (2, "der schnelle braune fuchs springt über den faulen hund", "de", "a", 1)]
    rows += [(10 + i, "le renard brun saute", "fr", "a", 1) for i in range(300)] + [(3, None, "es", "a", 1), (4, "texto", None, "a", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = langid.learn(docs, sample=20)
    assert model.languages == ["fr", "de", "en"]
    assert [langid.decide(t, model)[0] for t in ("the lazy fox", "der faule hund", "le renard", "中文", "123 !", None)] == ["en", "de", "fr", "fr", "und", "und"]
    # The filters' bits and the corrected counts, by the definition.
    for i, lang in enumerate(model.languages):
        grams = {int(h) for r in rows if r[2] == lang for h in langid.gram_hashes(r[1])}
        size = len(model.words)
        bits = {(h + k * (h >> 40 | 1)) % (1 << 64) % size for h in grams for k in range(langid.HASHES)}
        assert {int(s) for s in np.flatnonzero(model.words[:, 0] >> np.uint64(i) & np.uint64(1))} == bits
        text = langid.gram_hashes("the fox and der hund le")
        hit = sum(all((int(h) + k * (int(h) >> 40 | 1)) % (1 << 64) % size in bits for k in range(langid.HASHES)) for h in text) / len(text)
        odds = (len(bits) / size) ** langid.HASHES
        assert model.false_positive[i] == pytest.approx(odds)
        if i == 0:
            assert langid.decide("le renard", model)[1] <= 1 and hit >= 0
    best = max((((sum(all(model.words[(int(h) + k * (int(h) >> 40 | 1)) % (1 << 64) % size, 0] >> np.uint64(i) & np.uint64(1) for k in range(langid.HASHES)) for h in text) / len(text)) - model.false_positive[i]) / (1 - model.false_positive[i])) for i in range(3))
    assert langid.decide("the fox and der hund le", model)[1] == pytest.approx(best)


def test_only_the_sample_comes_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i % 50}", "en", "a", 1) for i in range(5000)], COLUMNS)
    rated = spark.createDataFrame([(1, 2), (1, 1)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, size: seen.append([r[2] for r in rows]))
    quality.learn(docs, rated, sample=7, size=1 << 12)
    quality.learn(docs, rated, sample=1000, size=1 << 12)
    quality.learn(docs.limit(0), rated, size=1 << 12)
    assert seen == [[1] * 7, [1] * 50, []]


def test_ordinal_fit_comes_near_the_best_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)).astype(np.float32)
    grades = np.digitize(x @ [1.5, -1.0, 0.0] + rng.logistic(size=600), [-1.0, 1.0])
    model = quality.fit([(np.zeros(0, np.int32), v, int(g)) for v, g in zip(x, grades)], size=128)
    cost = np.array([min(2.0, 600 / (3 * (grades == g).sum())) for g in range(3)])[grades]

    def loss(w, t):
        below = 1 / (1 + np.exp(-(np.r_[-40.0, t, 40.0][None] - (x @ w)[:, None])))
        return -(cost * np.log(below[np.arange(600), grades + 1] - below[np.arange(600), grades])).mean()

    w, t = np.zeros(3), np.array([-1.0, 1.0])
    for _ in range(1500):  # a plain optimiser: gradient steps by differences
        p = np.r_[w, t]
        step = np.array([(loss((p + e)[:3], (p + e)[3:]) - loss((p - e)[:3], (p - e)[3:])) / 2e-4 for e in np.eye(5) * 1e-4])
        w, t = w - 0.5 * step[:3], t - 0.5 * step[3:]
    assert loss(model.weights[:3], model.thresholds) < loss(w, t) + 0.02
    assert model.thresholds[0] < model.thresholds[1] and np.abs(model.weights[:3] - w).max() < 0.3


def test_simhash_of_a_hot_component(spark):
    rows = [(i, "same words in every one of these documents", "en", "a", 1) for i in range(500)] + [(900, "another text", "en", "a", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, COLUMNS), Scratch(spark, "t"))
    assert Counter(r["component_id"] for r in got.collect()) == {0: 500, 900: 1}


def test_scratch_goes(spark):
    import os

    scratch = Scratch(spark, "gone")
    scratch.save(spark.range(3), "a")
    path = scratch.root.removeprefix("file://")
    assert os.path.isdir(path)
    scratch.close()
    assert not os.path.isdir(path)
