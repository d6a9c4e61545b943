"""Operator 13: toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, iterated

#: Words of a window and from one window to the next: neighbours share an eighth.
WINDOW, STRIDE = 32, 28
#: Sizes: numbers of a word's and of a character gram's vector, of a direction's state, of the attention's layer; known words; slots of grams.
WORD, CHAR, HIDDEN, ATTENTION, VOCABULARY, GRAMS = 8, 8, 6, 4, 50_000, 1 << 16
#: Labelled texts of each label that a fit uses at most, bytes of such a text, passes over them, and the step size.
SAMPLE, LONGEST, PASSES, STEP = 1000, 1 << 15, 5, 0.01
#: Bytes at which words are cut (scripts without blanks), words whose inputs a task remembers, and windows that run at a time.
CUT, REMEMBERED, AT_ONCE = 32, 200_000, 2048
#: ASCII without letters and digits separates words; other characters belong to them.
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A text's words in lower case, cut into pieces of CUT bytes at most."""
    found = text.lower().encode("utf-8", "replace").translate(_SPLIT).split() if text else []
    if max(map(len, found), default=0) > CUT:
        found = [w[i : i + CUT] for w in found for i in range(0, len(w), CUT)]
    return found


def starts_of(n: int):
    """Where the windows over n words begin: every STRIDE words, and so that the last ends with the text. No words: one empty window."""
    import numpy as np

    last = max(0, n - WINDOW)
    return np.unique(np.r_[np.arange(0, last, STRIDE), last])


def grams_of(words: list[bytes]):
    """The slots of the words' three-byte grams with marks at both ends, one after another, and where each word's begin."""
    import numpy as np

    raw = np.frombuffer(b"\x01" + b"\x02\x01".join(words) + b"\x02", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 2)
    inside = np.ones(len(raw), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    codes = raw[at] << np.uint32(16) | raw[at + 1] << np.uint32(8) | raw[at + 2]
    return ((codes * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % GRAMS, np.cumsum(lengths) - lengths, lengths


@dataclass
class Network:
    """words: known words to rows of `word` (row 0: unknown); gram vectors; weights by name; logits are scaled and shifted to odds."""

    words: dict
    word: object
    gram: object
    weights: dict
    scale: float = 1.0
    shift: float = 0.0

    def rows(self, words: list[bytes]):
        import numpy as np

        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))

    def inputs(self, words: list[bytes]):
        """A word's input: its vector beside the mean of its grams' vectors."""
        import numpy as np

        slots, begins, lengths = grams_of(words)
        chars = np.add.reduceat(self.gram[slots], begins, axis=0) / lengths[:, None]
        return np.concatenate([self.word[self.rows(words)], chars], 1).astype(np.float32)


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run_direction(gates, u, live, order):
    """States (steps x windows x HIDDEN) of a gated recurrent unit over its gates' inputs; where a step isn't live the state stays."""
    import numpy as np

    h, two = HIDDEN, 2 * HIDDEN
    state, states, kept = np.zeros((gates.shape[1], h), np.float32), np.empty((*gates.shape[:2], h), np.float32), {}
    for t in order:
        x, own = gates[t], state @ u
        zr = _sigmoid(x[:, :two] + own[:, :two])
        new = np.tanh(x[:, two:] + zr[:, h:] * own[:, two:])
        z = zr[:, :h] if live is None else np.where(live[t][:, None], zr[:, :h], 1)
        kept[t] = (state, zr, new, own[:, two:])
        state = new + z * (state - new)
        states[t] = state
    return states, kept


def forward(weights: dict, gates, live):
    """Logits of windows from their gates' inputs (steps x windows x 6 HIDDEN: forwards, then backwards), and what the gradient needs.

    live: (steps x windows), or None if every step has a word. Attention weighs the states of live steps; a window without words has the logit's bias.
    """
    import numpy as np

    steps = range(len(gates))
    ahead, kept_a = _run_direction(gates[..., : 3 * HIDDEN], weights["ahead_u"], live, steps)
    back, kept_b = _run_direction(gates[..., 3 * HIDDEN :], weights["back_u"], live, reversed(steps))
    states = np.concatenate([ahead, back], 2)
    hidden = np.tanh(states @ weights["attend"] + weights["attend_b"])
    energy = hidden @ weights["query"]
    share = np.exp(energy - energy.max(0))
    if live is not None:
        share = share * live
    share = share / np.maximum(share.sum(0), 1e-20)
    pooled = np.einsum("tb,tbh->bh", share, states)
    return pooled @ weights["out"] + weights["out_b"], (states, hidden, share, pooled, kept_a, kept_b)


def backward(weights: dict, gates, live, kept, slope):
    """Gradients of the weights and of the gates' inputs, given the loss's slope by logit."""
    import numpy as np

    states, hidden, share, pooled, kept_a, kept_b = kept
    grads = {"out": pooled.T @ slope, "out_b": np.array(slope.sum())}
    d_pooled = slope[:, None] * weights["out"]
    d_states = share[..., None] * d_pooled[None]
    d_share = np.einsum("bh,tbh->tb", d_pooled, states)
    d_energy = share * (d_share - (share * d_share).sum(0))
    grads["query"] = np.einsum("tb,tbk->k", d_energy, hidden)
    d_hidden = d_energy[..., None] * weights["query"] * (1 - hidden**2)
    grads["attend"], grads["attend_b"] = np.einsum("tbh,tbk->hk", states, d_hidden), d_hidden.sum((0, 1))
    d_states = d_states + d_hidden @ weights["attend"].T
    d_gates, h, two = np.zeros_like(gates), HIDDEN, 2 * HIDDEN
    for name, own, order, at in (("ahead_u", kept_a, reversed(range(len(gates))), 0), ("back_u", kept_b, range(len(gates)), 1)):
        u, d_u, d_state = weights[name], np.zeros_like(weights[name]), np.zeros_like(d_pooled[:, :h])
        for t in order:
            state, zr, new, inner = own[t]
            z, r = zr[:, :h], zr[:, h:]
            d = d_state + d_states[t, :, at * h : (at + 1) * h]
            on = np.ones_like(d) if live is None else np.broadcast_to(live[t][:, None], d.shape)
            d_new = on * d * (1 - z) * (1 - new**2)
            d_z, d_r = on * d * (state - new) * z * (1 - z), d_new * inner * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_new * r], 1)
            d_gates[t, :, at * 3 * h : at * 3 * h + two], d_gates[t, :, at * 3 * h + two : (at + 1) * 3 * h] = d_own[:, :two], d_new
            d_u += state.T @ d_own
            d_state = np.where(on > 0, d * z, d) + d_own @ u.T
        grads[name] = d_u
    return grads, d_gates


def _new_weights(rng) -> dict:
    import numpy as np

    size, h = WORD + CHAR, HIDDEN
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {"x": draw(size, 6 * h), "x_b": np.zeros(6 * h, np.float32), "ahead_u": draw(h, 3 * h), "back_u": draw(h, 3 * h), "attend": draw(2 * h, ATTENTION), "attend_b": np.zeros(ATTENTION, np.float32), "query": draw(ATTENTION), "out": draw(2 * h), "out_b": np.array(-1.0, np.float32)}


def _odds(present: list[list], labels, size: int):
    """Log odds of a text being toxic if it has a thing, by the things that each text has; nearer 0 the fewer texts have it."""
    import numpy as np

    n = np.zeros((2, size))
    for things, label in zip(present, labels, strict=True):
        n[int(label), things] += 1
    counts = np.bincount(np.asarray(labels, int), minlength=2)
    odds = np.log((n[1] + 0.5) / (counts[1] + 1)) - np.log((n[0] + 0.5) / (counts[0] + 1))
    return odds * n.sum(0) / (n.sum(0) + 5)


def _windows(rows: list, which):
    """Windows (text, start) as an array of word numbers, steps x windows; -1 past a text's end."""
    import numpy as np

    out = np.full((WINDOW, len(which)), -1, np.int64)
    for b, (i, s) in enumerate(which):
        own = rows[i][s : s + WINDOW]
        out[: len(own), b] = own
    return out


def fit(labelled: list[tuple[str | None, int]], seed: int = 5, passes: int = PASSES) -> Network:
    """Trains on whole texts with labels 0 and 1, in numpy, on the driver.

    A toxic text need not be toxic throughout: of its windows only the one with the highest logit (at first, with the
    highest odds of its words) is taught as toxic, while a clean text teaches its highest window and two drawn ones as
    clean. The first number of a word's or gram's vector starts at its log odds over the texts. A third of the words
    is hidden in each step, so that spelling alone also decides. In the end logits are scaled and shifted so that the
    highest window's gives the odds of the text. Without texts of both labels every text gets that label's share.
    """
    import numpy as np

    rng, labels = np.random.default_rng(seed), np.array([y for _, y in labelled], float)
    texts = [words_of(t) for t, _ in labelled]
    known = [w for w, n in sorted(Counter(w for t in texts for w in set(t)).items(), key=lambda x: (-x[1], x[0])) if n > 1][:VOCABULARY]
    weights = _new_weights(rng)
    net = Network({w: i + 1 for i, w in enumerate(known)}, rng.normal(0, 0.03, (len(known) + 1, WORD)).astype(np.float32), rng.normal(0, 0.03, (GRAMS, CHAR)).astype(np.float32), weights)
    net.word[0] = 0
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        net.scale, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    every = sorted({w for t in texts for w in t})
    at = {w: i for i, w in enumerate(every)}
    rows = [np.fromiter((at[w] for w in t), np.int64, len(t)) for t in texts]
    words = net.rows(every)
    slots, begins, lengths = grams_of(every)
    whose = np.repeat(np.arange(len(every)), lengths)
    of = lambda r: np.concatenate([slots[begins[w] : begins[w] + lengths[w]] for w in np.unique(r)]) if len(r) else np.zeros(0, np.int64)
    net.word[:, 0] = np.clip(_odds([np.unique(words[r]) for r in rows], labels, len(known) + 1), -3, 5)
    net.word[0] = 0
    net.gram[:, 0] = np.clip(_odds([np.unique(of(r)) for r in rows], labels, GRAMS), -3, 5)
    windows = [(i, int(s)) for i, r in enumerate(rows) for s in starts_of(len(r))]
    first = np.cumsum([0] + [len(starts_of(len(r))) for r in rows])
    slope2 = {k: np.zeros_like(v, np.float64) for k, v in weights.items()} | {"word": np.full_like(net.word, 1e-3, np.float64), "gram": np.full_like(net.gram, 1e-3, np.float64)}
    slope1 = {k: np.zeros_like(v, np.float64) for k, v in weights.items()}
    turn = 0

    def step(which, wanted):
        nonlocal turn
        turn += 1
        ids = _windows(rows, which)
        live, safe = ids >= 0, np.maximum(ids, 0)
        own, place = np.unique(safe, return_inverse=True)
        place = place.reshape(ids.shape)
        hidden = rng.random(ids.shape) < 1 / 3
        vectors = np.where(hidden[..., None], 0, net.word[words[safe]])
        mine = np.concatenate([np.arange(begins[w], begins[w] + lengths[w]) for w in own])
        back = np.repeat(np.arange(len(own)), lengths[own])
        chars = np.zeros((len(own), CHAR), np.float32)
        np.add.at(chars, back, net.gram[slots[mine]])
        chars /= lengths[own][:, None]
        x = np.concatenate([vectors, chars[place]], 2).astype(np.float32)
        gates = x @ weights["x"] + weights["x_b"]
        logits, kept = forward(weights, gates, live)
        slope = ((_sigmoid(logits) - wanted) / len(which)).astype(np.float32)
        grads, d_gates = backward(weights, gates, live, kept, slope)
        grads["x"], grads["x_b"] = np.einsum("tbi,tbj->ij", x, d_gates), d_gates.sum((0, 1))
        for k, g in grads.items():  # Adam
            slope1[k] = 0.9 * slope1[k] + 0.1 * g
            slope2[k] = 0.99 * slope2[k] + 0.01 * g**2
            weights[k] -= (STEP * (slope1[k] / (1 - 0.9**turn)) / (np.sqrt(slope2[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
        d_x = d_gates @ weights["x"].T
        d_word = np.zeros_like(net.word)
        np.add.at(d_word, words[safe][~hidden & live], d_x[~hidden & live][:, :WORD])
        d_word[0] = 0
        d_chars = np.zeros((len(own), CHAR), np.float32)
        np.add.at(d_chars, place[live], d_x[live][:, WORD:])
        d_gram = np.zeros_like(net.gram)
        np.add.at(d_gram, slots[mine], (d_chars / lengths[own][:, None])[back])
        for name, table, d in (("word", net.word, d_word), ("gram", net.gram, d_gram)):  # steps shrink with each vector's own past slopes
            on = np.flatnonzero(np.abs(d).sum(1))
            slope2[name][on] += d[on] ** 2
            table[on] -= (STEP * d[on] / np.sqrt(slope2[name][on])).astype(np.float32)

    lead = np.clip(net.word[words, 0], 0, None) + np.add.reduceat(np.clip(net.gram[slots, 0], 0, None), begins) / lengths
    best = np.array([lead[rows[i][s : s + WINDOW]].sum() for i, s in windows])
    for n in range(passes):
        if n:
            best = _logits_of(net, every, rows, windows)
        tops = [windows[a + int(np.argmax(best[a:b]))] for a, b in zip(first, first[1:])]
        chosen = [(w, labels[w[0]]) for w in tops]
        chosen += [(windows[int(rng.integers(first[i], first[i + 1]))], 0.0) for i in np.repeat(np.flatnonzero(labels == 0), 2)]
        order = rng.permutation(len(chosen))
        for part in np.array_split(order, max(1, len(order) // 128)):
            step([chosen[j][0] for j in part], np.array([chosen[j][1] for j in part], np.float32))
    top = np.maximum.reduceat(_logits_of(net, every, rows, windows), first[:-1])
    net.scale, net.shift = _calibrated(top, labels)
    return net


def _calibrated(logits, labels) -> tuple[float, float]:
    """Scale and shift by logistic regression on the highest logits, held near 1 and 0 by a weak prior."""
    import numpy as np

    a, b = 1.0, 0.0
    for _ in range(25):
        p = _sigmoid(a * logits + b)
        v = p * (1 - p) + 1e-6
        g = np.array([((p - labels) * logits).sum() + (a - 1), (p - labels).sum() + 0.01 * b])
        hess = np.array([[(v * logits**2).sum() + 1, (v * logits).sum()], [(v * logits).sum(), v.sum() + 0.01]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = max(0.05, a - move[0]), b - move[1]
    return float(a), float(b)


def _logits_of(net: Network, every: list[bytes], rows: list, windows: list):
    import numpy as np

    logits = Logits(net.weights)
    tables = logits.rows(net.inputs(every) @ net.weights["x"] + net.weights["x_b"])
    return np.concatenate([logits(tables, _windows(rows, windows[i : i + AT_ONCE])) for i in range(0, len(windows), AT_ONCE)])


class _Numbers(dict):
    """Numbers of words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class Logits:
    """Windows' logits from numbers of words, as `forward` gives them, without what a gradient needs.

    Gates' inputs lie in a row a word and direction, those of the two sigmoid gates negated for 1 / (1 + exp(-x)); the last
    row, number -1, is of steps without a word, whose update gate keeps the state.
    """

    def __init__(self, weights: dict):
        import numpy as np

        self.w, two = weights, 2 * HIDDEN
        sign = np.r_[-np.ones(two), np.ones(HIDDEN)].astype(np.float32)
        self.signs = np.r_[sign, sign]
        self.u = [weights["ahead_u"] * sign, weights["back_u"] * sign]

    def rows(self, gates):
        """The table of a number's gates: (words + 1) x 3 HIDDEN for either direction."""
        import numpy as np

        none = np.zeros((1, 6 * HIDDEN), np.float32)
        none[0, :HIDDEN] = none[0, 3 * HIDDEN : 4 * HIDDEN] = -1e4  # exp(-1e4) is 0: the update gate is 1
        both = np.concatenate([gates * self.signs, none])
        return [np.ascontiguousarray(both[:, : 3 * HIDDEN]), np.ascontiguousarray(both[:, 3 * HIDDEN :])]

    def __call__(self, tables, ids):
        import numpy as np

        h, two, (steps, n) = HIDDEN, 2 * HIDDEN, ids.shape
        states = np.empty((steps, n, two), np.float32)
        with np.errstate(over="ignore"):
            for at, (table, u) in enumerate(zip(tables, self.u, strict=True)):
                state = np.zeros((n, h), np.float32)
                for t in range(steps) if at == 0 else range(steps - 1, -1, -1):
                    x, own = table[ids[t]], state @ u
                    zr = x[:, :two] + own[:, :two]
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    new = own[:, two:] * zr[:, h:]
                    new += x[:, two:]
                    np.tanh(new, out=new)
                    state = state - new
                    state *= zr[:, :h]
                    state += new
                    states[t, :, at * h : (at + 1) * h] = state
        hidden = states.reshape(-1, two) @ self.w["attend"]
        hidden += self.w["attend_b"]
        energy = (np.tanh(hidden, out=hidden) @ self.w["query"]).reshape(steps, n)
        share = np.exp(energy - energy.max(0))
        share *= ids >= 0
        total = np.maximum(share.sum(0), 1e-20)
        # The output is linear in the states, so they are weighed after it.
        return ((states.reshape(-1, two) @ self.w["out"]).reshape(steps, n) * share).sum(0) / total + self.w["out_b"]


class Scorer:
    """Scores texts. A word's gates' inputs are computed once and remembered, for REMEMBERED words at a time."""

    def __init__(self, net: Network):
        self.net, self.logits = net, Logits(net.weights)
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.numbers, self.gates = _Numbers(), np.zeros((0, 6 * HIDDEN), np.float32)
        self.tables = self.logits.rows(self.gates)

    def learn_new(self) -> None:
        """Gates' inputs of the words that have a number and none yet."""
        import numpy as np

        fresh = list(islice(self.numbers, len(self.gates), None))
        if fresh:
            made = self.net.inputs(fresh) @ self.net.weights["x"] + self.net.weights["x_b"]
            self.gates = np.concatenate([self.gates, made])
            self.tables = self.logits.rows(self.gates)

    def highest(self, texts):
        """Each text's highest logit over all its windows, AT_ONCE windows at a time."""
        import numpy as np

        best = np.full(len(texts), -np.inf)
        held, whose, steps = [], [], np.arange(WINDOW)[:, None]

        def flush():
            if held:
                self.learn_new()
                ids, own = np.concatenate(held, 1), np.concatenate(whose)
                for j in range(0, len(own), AT_ONCE):
                    np.maximum.at(best, own[j : j + AT_ONCE], self.logits(self.tables, ids[:, j : j + AT_ONCE]))
                held.clear()
                whose.clear()
            if len(self.numbers) > REMEMBERED:
                self.forget()

        n = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            begins = starts_of(len(words))
            # A long text is dealt out in parts of whole windows.
            for j in range(0, len(begins), 8 * AT_ONCE):
                own = begins[j : j + 8 * AT_ONCE]
                low = int(own[0])
                part = words[low : int(own[-1]) + WINDOW]
                numbers = np.fromiter(map(self.numbers.__getitem__, part), np.int64, len(part))
                at = own - low + steps
                held.append(np.where(at < len(part), numbers[np.minimum(at, len(part) - 1)], -1) if len(part) else np.full((WINDOW, 1), -1))
                whose.append(np.full(len(own), i))
                n += len(own)
                if n >= 8 * AT_ONCE:
                    flush()
                    n = 0
        flush()
        return best

    def odds(self, texts):
        return _sigmoid(self.net.scale * self.highest(texts) + self.net.shift)


def learn(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Network:
    """Fits on at most `sample` texts of either label, those with the smallest hashes of doc_id, of at most `longest` bytes each.

    ratings: (doc_id, toxic). The candidates, four times as many doc_ids, and then the chosen texts by hash are tables
    of a bounded number of slim rows and are broadcast, so no text is shuffled, and the driver gets 2 * sample * longest
    bytes at most. Rows equal in doc_id and text count once; of several labels of a doc_id the highest counts. Null
    doc_ids, null labels and ratings without a document teach nothing; a null text is an empty one. Empty tables give
    a network that answers 0.5. Extra columns are ignored.
    """
    place = F.xxhash64("doc_id")
    rated = ratings.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = None
    for label in (0, 1):
        own = rated.where(F.col("toxic") == label).orderBy(place, "doc_id").limit(4 * sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("own", F.xxhash64("text"))
    met = slim.where(F.octet_length("text") <= longest).select("doc_id", "own").join(F.broadcast(chosen), "doc_id").distinct()
    taken = None
    for label in (0, 1):
        own = met.where(F.col("toxic") == label).orderBy(place, "doc_id", "own").limit(sample)
        taken = own if taken is None else taken.unionByName(own)
    rows = slim.join(F.broadcast(taken), ["doc_id", "own"]).select("doc_id", "own", "text", "toxic").dropDuplicates(["doc_id", "own"])
    found = sorted(((r["doc_id"], r["own"], r["text"], r["toxic"]) for r in rows.toLocalIterator()), key=lambda r: r[:2])
    return fit([(text, toxic) for _, _, text, toxic in found])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Adds score, the odds that a text is toxic by its most toxic window, and predicted, 1 from 0.5 on, to the documents' columns.

    Every text is read whole, in overlapping windows; a null or empty text is one window without words. Repeated rows
    get the same score each; an empty table gives no row. Extra columns are kept whatever their names, those named as
    the added ones replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        scorer = Scorer(shared.value)
        for texts in batches:
            odds = scorer.odds(list(texts)) if len(texts) else np.zeros(0)
            yield pd.DataFrame({"score": odds, "predicted": (odds >= 0.5).astype(np.int32)})

    fields = iterated("score double, predicted int")(run)
    (scored,) = free(docs, "_scored")
    return docs.withColumn(scored, fields(F.col("text"))).withColumns({c: F.col(f"{scored}.{c}") for c in ("score", "predicted")}).drop(scored)
