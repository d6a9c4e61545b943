"""The prefix trie, the ranked search and the toxicity network against brute force, gradients by differences and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tideline.llm")
from pyspark.sql import functions as F

from tideline.llm import ranked, toxicity, trie
from tideline.llm.common import Scratch

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        rebuilt[c] = own.get(base, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for k, members in nodes.items():
        below = [q for q in nodes if q[: len(k)] == k]
        leaves = sum(not any(r[:-1] == q for r in nodes if r) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(q) == len(k) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(tuple(-99 if x is None else x for x in r) for r in rows)


def conversations(seed, convs, long=0):
    rng, rows = random.Random(seed), []
    for c in convs:
        for t in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é", "same words"])))
    return rows + [(convs[0], 100 + t, "user", rng.choice("ab")) for t in range(long)] + [(convs[1], 100 + t, "user", "a") for t in range(long)] + [(convs[2], 100 + t, "user", "a") for t in range(long)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, monkeypatch, seed):
    for name, value in (("HEAD", 9), ("CHUNK", 4), ("LISTED", 2), ("HOT", 8)):
        monkeypatch.setattr(trie, name, value)
    convs = [5, 6, 7, 8, 9, 10, 12, 14, -3, -5, -6, 0, 2, 21, 22, 23] + list(range(40, 60))
    rows = conversations(seed, convs, long=30) + [(None, 1, "user", "lost"), (7, 1, "user", "a"), (7, 1, "user", "a"), (99, None, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("depth", "a", "pos", "kind", "len", "a.b")}).repartition(5)
    got = trie.prefix_trie(df, Scratch(spark, "t")).select(*NAMES).collect()
    assert order(got) == order(brute_trie(rows))


def test_trie_of_copies_and_tiny_tables(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(11)]
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS), Scratch(spark, "t")).select(*NAMES).collect()
    assert order(got) == order(brute_trie(rows))
    for tiny in ([], [(None, 1, "user", "x")], [(4, 0, "user", "x")], [(0, None, None, None)]):
        got = trie.prefix_trie(spark.createDataFrame(tiny, TURNS), Scratch(spark, "t")).select(*NAMES).collect()
        assert order(got) == order(brute_trie(tiny))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    texts = [[low(w) for w in TERM.findall(t or "")] for _, t in docs]
    n, total = sum(map(bool, texts)), sum(map(len, texts))
    df = {}
    for t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for (doc, _), t in zip(docs, texts):
            s = 0
            for w in map(low, TERM.findall(text or "")):
                if tf := t.count(w):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * (25 + 75 * len(t) * n // total)))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return out


def search_case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "中文", "THE", "the", "x9"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([5, 46])]) for _ in range(n)) + rng.choice(["", ".", "\x00_"])
    docs = [(i * 3 % 101, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(150)] + [(500 + i, "w1 w2 w3 w30") for i in range(40)] + [(7, None), (8, ""), (None, "w1 w2 the"), (9, "w7 " * 3000)]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(20)] + [(50, None), (51, ""), (None, "w1 w30"), (52, "nowhere w1"), (3, "w30 w30 w30")]
    return docs, items


@pytest.mark.parametrize("small", [ranked.SMALL, 0])
def test_ranked_search_against_brute_force(spark, monkeypatch, small):
    for name, value in (("DOCS", 32), ("WORDS", 900), ("AT_ONCE", 7), ("ITEMS", 6), ("NODES", 3)):
        monkeypatch.setattr(ranked, name, value)
    docs, items = search_case(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "terms", "part", "a.b")}).repartition(3)
    index = ranked.build(df, Scratch(spark, "t"))
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1)), Scratch(spark, "t"), small=small).collect()
    assert order(got) == order(brute_search(docs, items))


def test_ranked_search_of_tiny_tables(spark):
    items = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    for docs in ([], [(1, None)], [(1, "")], [(1, "a")], [(1, "a"), (1, "a"), (2, "b c")]):
        index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"))
        got = ranked.search(index, items, Scratch(spark, "t"))
        assert order(got.collect()) == order(brute_search(docs, [(1, "a b")]))
        assert ranked.search(index, items.limit(0), Scratch(spark, "t")).count() == 0


def test_ranked_search_prunes_nodes(monkeypatch):
    """Most of a shard's documents are never reached when one stands out."""
    n = 4096
    docs = np.arange(n)
    impacts = ranked.impacts_of(np.where(docs == 77, 50, 1), np.full(n, 60), n, 60 * n)
    sequence = docs[np.lexsort((docs, -impacts))].astype(np.uint16)
    bits = [np.packbits((sequence[np.argsort(sequence >> (12 - level), kind="stable")] >> (11 - level)) & 1).tobytes() for level in range(12)]
    row = {"ids": docs, "known": np.ones(n, np.uint8).tobytes(), "terms": None, "counts": [n], "sizes": np.ones(n, int), "bits": bits, "impacts": np.sort(impacts)[::-1].astype(np.int32).tobytes()}
    tree = ranked.Tree(row)
    reached = []
    plain = np.add.at
    monkeypatch.setattr(ranked, "NODES", 1)

    class Counted:
        at = staticmethod(lambda *a: (reached.append(len(a[1])), plain(*a))[1])

    monkeypatch.setattr(np, "add", Counted())
    q, d, s = ranked.search_tree(tree, np.array([0]), np.array([5]), np.array([0]), np.array([n]), np.array([1]), 1)
    assert (q.tolist(), d.tolist(), s.tolist()) == ([0], [77], [5 * int(impacts.max())]) and sum(reached) < 60


INSULTS = ["dolt", "oaf", "ninny"]


def toxic_case(n, seed, clean=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["la", "re", "mi", "to", "nu", "sa"]) for _ in range(rng.randint(1, 4))) for _ in range(clean)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((" ".join(text), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def network():
    return toxicity.fit(toxic_case(400, 1), passes=4)


def test_network_tells_held_out_texts_apart(network):
    rows = toxic_case(300, 2)
    odds = toxicity.Scorer(network).odds([t for t, _ in rows])
    right = [(o >= 0.5) == bool(y) for o, (_, y) in zip(odds, rows)]
    assert np.mean(right) > 0.97


def test_one_window_of_a_long_text_decides(network):
    clean = " ".join(t for t, y in toxic_case(800, 3) if not y)
    half = len(clean) // 2
    low, high = toxicity.Scorer(network).odds([clean, clean[:half] + " oaf dolt " + clean[half:]])
    assert high >= 0.5 and high > low


def test_spelling_decides_for_unknown_words(network):
    s = toxicity.Scorer(network)
    assert s.odds(["la re dolts oafish mi to"])[0] > s.odds(["la re remito saremi mi to"])[0]


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    weights = {k: np.asarray(v, np.float64) for k, v in toxicity._new_weights(rng).items()}
    gates = rng.normal(size=(5, 3, 6 * toxicity.HIDDEN))
    live = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [1, 0, 0], [1, 0, 0]], bool)
    up = rng.normal(size=3)
    loss = lambda: float((toxicity.forward(weights, gates, live)[0] * up).sum())
    _, kept = toxicity.forward(weights, gates, live)
    grads, d_gates = toxicity.backward(weights, gates, live, kept, up)
    for name, g in [*grads.items(), ("gates", d_gates)]:
        table = gates if name == "gates" else weights[name]
        for at in [tuple(rng.integers(0, n) for n in table.shape) for _ in range(6)] if table.ndim else [()]:
            old = float(table[at])
            table[at] = old + 1e-4
            more = loss()
            table[at] = old - 1e-4
            less = loss()
            table[at] = old
            assert (more - less) / 2e-4 == pytest.approx(float(np.asarray(g)[at]), abs=2e-4), name


def test_scores_are_those_of_the_training_network(network):
    """The quick form of the network, over all windows, is the one that was trained."""
    texts = [t for t, _ in toxic_case(40, 5)] + ["", None, "中" * 300, "w " * 70, "!!"]
    got = toxicity.Scorer(network).highest(texts)
    for text, best in zip(texts, got):
        words, logits = toxicity.words_of(text), []
        for s in toxicity.starts_of(len(words)):
            own = words[s : s + toxicity.WINDOW]
            gates = np.zeros((toxicity.WINDOW, 1, 6 * toxicity.HIDDEN), np.float32)
            if own:
                gates[: len(own), 0] = network.inputs(own) @ network.weights["x"] + network.weights["x_b"]
            live = np.arange(toxicity.WINDOW)[:, None] < len(own)
            logits.append(float(toxicity.forward(network.weights, gates, live)[0][0]))
        assert best == pytest.approx(max(logits), abs=1e-3)
        covered = {i for s in toxicity.starts_of(len(words)) for i in range(s, min(len(words), s + toxicity.WINDOW))}
        assert covered == set(range(len(words)))


def test_remembered_words_do_not_change_scores(network, monkeypatch):
    texts = [t for t, _ in toxic_case(60, 6)]
    want = toxicity.Scorer(network).odds(texts)
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    monkeypatch.setattr(toxicity, "AT_ONCE", 3)
    assert toxicity.Scorer(network).odds(texts) == pytest.approx(want, abs=1e-5)


def test_learn_and_score_on_odd_rows(spark):
    docs = [(i, t, y) for i, (t, y) in enumerate(toxic_case(60, 7))]
    df = spark.createDataFrame([d[:2] for d in docs] + [(None, "x"), (900, None), (901, ""), (0, docs[0][1])], "doc_id long, text string").withColumns({"score": F.lit(7), "own": F.lit(8), "a.b": F.lit(9), "_scored": F.lit(5)})
    rated = spark.createDataFrame([(i, y) for i, _, y in docs] + [(None, 1), (900, None), (5000, 1), (3, 0)], "doc_id long, toxic int")
    net = toxicity.learn(df, rated, sample=20)
    got = toxicity.score(df, net)
    assert set(df.columns) <= set(got.columns) and {r["own"] for r in got.collect()} == {8}
    rows = got.collect()
    assert len(rows) == 64 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    assert toxicity.score(df.limit(0), net).count() == 0
    assert toxicity.score(df, toxicity.learn(df.limit(0), rated)).where("score = 0.5").count() == 64
    only = toxicity.learn(df, rated.where("toxic = 0"))
    assert toxicity.score(df, only).where("score < 0.1").count() == 64


def test_a_fit_takes_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append([(len(t), y) for t, y in rows]))
    docs = spark.createDataFrame([(i, "word " * (i % 50 + 1)) for i in range(400)], "doc_id long, text string")
    toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), sample=25, longest=200)
    assert len(seen[0]) == 50 and sum(y for _, y in seen[0]) == 25 and max(n for n, _ in seen[0]) <= 200
