"""The near-duplicate stage against brute-force Jaccard of word shingles."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("tideline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import COLUMNS, ODD, words_of
from tideline.llm import simhash


def shingles(text, words=5):
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def groups_of(texts):
    """Components of the pairs of Jaccard 0.8; those pairs. Empty sets are equal."""
    sets, root, near = [shingles(t) for t in texts], list(range(len(texts))), []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                near.append((i, j))
                root[top(i)] = top(j)
    return [top(i) for i in range(len(sets))], near


def made(rng):
    rows = [r for r in ODD if r[0] is not None]
    for d in range(60):
        base = words_of(rng.randint(60, 200), 70 + d, 4000)
        for k in range(4):  # each copy is edited anew: on both sides of 0.8 against the first and against one another
            text = list(base)
            for _ in range(rng.randint(0, 5) if k else 0):
                text[rng.randrange(len(text))] = f"edit{rng.random()}"
            rows.append((100 + 10 * d + k, " ".join(text), "en", "s0", 1))
    chain = words_of(120, 5, 4000)
    for k in range(30):  # neighbours are near, the ends are not
        chain[4 * k] = f"link{k}"
        rows.append((5000 + k, " ".join(chain), "en", "s0", 1))
    return rows


@pytest.mark.parametrize("bucket", [8, simhash.BUCKET])
def test_candidates_of_jaccard_0_8_are_linked(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash.meetings, "__defaults__", (bucket,))
    rows = made(random.Random(8))
    root, near = groups_of([r[1] for r in rows])
    assert sum(rows[i][1] != rows[j][1] for i, j in near) > 150
    first = defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        first[g].append(r[0])
    got = corpus_pipeline.keep_one(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(map(min, first.values()))


def test_candidates_grow_with_the_texts_and_not_with_their_pairs(spark):
    """Texts that have half of their words from a common stock, and a near copy each: compared pairs stay in proportion."""
    rng, compared = random.Random(6), []
    for n in (100, 400):
        rows = []
        for d in range(n):
            text = words_of(120, 900 + d, 3000)
            rows += [(2 * d, " ".join(text), "en", "s0", 1), (2 * d + 1, " ".join([*text[:-2], f"x{rng.random()}"]), "en", "s0", 1)]
        scratch = simhash.Scratch(spark, "t")
        got = simhash.near_duplicates(spark.createDataFrame(rows, COLUMNS), scratch, words=5, distance=4, similar=True)
        assert sorted(r["component_id"] for r in got.collect()) == sorted(2 * (d // 2) for d in range(2 * n))
        prints = simhash.signed(spark.createDataFrame(rows, COLUMNS), 5)
        columns = ["fp", "node", "size"]
        compared.append(simhash.meetings(simhash.banded(prints, columns), columns, simhash.Scratch(spark, "t"), simhash.forest(4)).count())
    assert compared[1] <= 4.4 * compared[0]


def test_one_large_group_of_near_copies(spark):
    rng, base = random.Random(3), words_of(150, 1, 4000)
    rows = []
    for k in range(400):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = f"edit{rng.random()}"
        rows.append((k, " ".join(text), "en", "s0", 1))
    root, _ = groups_of([r[1] for r in rows])
    got = simhash.near_duplicates(spark.createDataFrame(rows, COLUMNS), simhash.Scratch(spark, "t"), words=5, distance=corpus_pipeline.DISTANCE, similar=True)
    assert got.select("component_id").distinct().count() == len(set(root))
    assert corpus_pipeline.keep_one(spark, spark.createDataFrame([], COLUMNS), "").count() == 0
