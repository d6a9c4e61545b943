"""Operator 7: an ordinal cumulative-link quality classifier over hashed text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, iterated, slices

#: Hashed features, labelled rows that a fit may use at most, passes over them, and the step size.
FEATURES, SAMPLE, PASSES, STEP = 1 << 18, 20_000, 20, 0.5
#: Grades: 0 toxic, 1 poor, 2 good. Standard errors by which a feature's share of graded texts must stand out to be used.
GRADES, STANDS_OUT = 3, 4.0
#: The first features describe a text's shape; hashed ones begin behind them.
SHAPE, HASHED = 7, 64
_PIECES = re.compile(r"\w+|[^\w\s]+|\n").findall


@dataclass
class OrdinalModel:
    """weights shared by all grades, thresholds rising: P(grade > g) = 1 / (1 + exp(threshold[g] - score))."""

    weights: object
    thresholds: object


class Features:
    """A text's features: which words and runs of signs it has, hashed, and its shape. Both take the whole text."""

    def __init__(self, size: int = FEATURES):
        self.size, self.kept = size, {}

    def slot(self, piece: str) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), 7) % (self.size - HASHED) + HASHED
        if len(self.kept) < 500_000:
            self.kept[piece] = found
        return found

    def of(self, text: str | None):
        """(slots of the distinct pieces, SHAPE shares); a null or empty text has only a constant."""
        import numpy as np

        pieces = _PIECES(text.lower()) if text else []
        own = Counter(pieces)
        kept, slot = self.kept, self.slot
        slots = np.fromiter((kept[p] if p in kept else slot(p) for p in own), np.int32, len(own))
        n = max(1, len(pieces))
        most = max(own.values(), default=0) / n
        signs = sum(1 for p in pieces if not (p[0].isalnum() or p[0] == "\n")) / n
        shouted = sum(map(str.isupper, text)) / len(text) if text else 0.0
        return slots, np.array([1.0, len(own) / n, most, signs, own["\n"] / n, shouted, min(1.0, n / 500)], np.float32)


def chosen_features(slots, owners, graded, size: int, grades: int):
    """Features whose share among the texts above some grade stands out from its share among all, by STANDS_OUT standard errors."""
    import numpy as np

    n, met, best = len(graded), np.bincount(slots, minlength=size), np.zeros(size)
    for g in range(grades - 1):
        share = (graded <= g).mean() if n else 0.0
        low = np.bincount(slots[graded[owners] <= g], minlength=size)
        best = np.maximum(best, np.abs(low - met * share) / np.sqrt(met * share * (1 - share) + 1))
    best[:HASHED] = np.inf
    return best >= STANDS_OUT


def fit(rows: list[tuple[object, object, int]], grades: int = GRADES, size: int = FEATURES, passes: int = PASSES, step: float = STEP) -> OrdinalModel:
    """Cumulative-link (proportional odds) likelihood by mini-batch AdaGrad; thresholds are kept in order.

    rows: (slots, shape, grade). Features that don't stand out keep weight 0. Rare grades count up to twice. Without rows
    all weights are 0.
    """
    import numpy as np

    weights, thresholds = np.zeros(size), np.linspace(-1.0, 1.0, grades - 1)
    if not rows:
        return OrdinalModel(weights.astype(np.float32), thresholds)
    graded = np.array([r[2] for r in rows])
    for g in range(grades - 1):
        above = np.clip((graded > g).mean(), 0.01, 0.99)
        thresholds[g] = -np.log(above / (1 - above))
    thresholds = np.maximum.accumulate(thresholds) + np.arange(grades - 1) * 1e-3
    sizes = np.array([len(r[0]) for r in rows])
    slots, owners = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
    used = chosen_features(slots, owners, graded, size, grades)[slots]
    slots, owners = slots[used], owners[used]
    starts = np.searchsorted(owners, np.arange(len(rows) + 1))
    shapes = np.stack([r[1] for r in rows]).astype(np.float64)
    g_w, g_t, rng = np.full(size, 1e-8), np.full(grades - 1, 1e-8), np.random.default_rng(11)
    cost = np.array([min(2.0, len(rows) / max(1, grades * (graded == g).sum())) for g in range(grades)])[graded]
    head = np.arange(shapes.shape[1])
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            index = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            own, y = np.repeat(np.arange(len(batch)), starts[batch + 1] - starts[batch]), graded[batch]
            score = np.bincount(own, weights[slots[index]], len(batch)) + shapes[batch] @ weights[head]
            below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-40.0], thresholds, [40.0]])[None] - score[:, None], -40, 40)))
            lo, hi = below[np.arange(len(batch)), y], below[np.arange(len(batch)), y + 1]
            p, d_lo, d_hi = np.maximum(hi - lo, 1e-9), lo * (1 - lo), hi * (1 - hi)
            d_score = (d_hi - d_lo) / p * cost[batch] / len(batch)
            some, back = np.unique(slots[index], return_inverse=True)
            for where, part in ((some, np.bincount(back, d_score[own], len(some))), (head, d_score @ shapes[batch])):
                part = part + 1e-5 * weights[where]
                g_w[where] += part * part
                weights[where] -= step * part / np.sqrt(g_w[where])
            d_t = np.array([(np.where(y == g + 1, d_lo / p, 0) - np.where(y == g, d_hi / p, 0)) @ cost[batch] / len(batch) for g in range(grades - 1)])
            g_t += d_t * d_t
            thresholds = np.maximum.accumulate(thresholds - step / 4 * d_t / np.sqrt(g_t)) + np.arange(grades - 1) * 1e-9
    return OrdinalModel(weights.astype(np.float32), thresholds)


def grade(toxic: Column, quality: Column) -> Column:
    """The rating: 0 if toxic, 1 if of poor quality, 2 if good; null where neither label decides."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def learn(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, size: int = FEATURES) -> OrdinalModel:
    """Fits on at most `sample` rated documents, those with the smallest hashes of doc_id; only their features come to the driver.

    The chosen doc_ids, and then the chosen texts by hash, are tables of at most `sample` slim rows and are broadcast, so no
    text is shuffled. Rows equal in doc_id and text count once; a doc_id with several texts gives each of them, up to
    `sample` in all; of several grades of a doc_id the lowest counts, and of equal hashes the smaller doc_id comes first.
    Null doc_ids, null grades and ratings without a document teach nothing; null and empty texts have only their shape;
    long texts are read whole. Empty tables give weights of 0. Extra columns are ignored.
    """

    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        features = Features(size)
        for batch in batches:
            for part in slices(batch):
                got = [features.of(t) for t in part["text"]]
                yield pd.DataFrame({"place": part["place"], "own": part["own"], "slots": [g[0].tobytes() for g in got], "shape": [g[1].tobytes() for g in got], "grade": part["grade"].astype(int)})

    place = F.xxhash64("doc_id")
    rated = ratings.where("grade is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(place, "doc_id").limit(sample)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    texts = slim.select("doc_id", "own").join(F.broadcast(chosen), "doc_id").distinct().orderBy(place, "doc_id", "own").limit(sample)
    rows = slim.join(F.broadcast(texts), ["doc_id", "own"]).select(place.alias("place"), "own", "text", "grade")
    found = rows.mapInPandas(run, "place long, own long, slots binary, shape binary, grade int").dropDuplicates(["place", "own"]).toLocalIterator()
    taken = sorted(((r["place"], r["own"], bytes(r["slots"]), bytes(r["shape"]), r["grade"]) for r in found), key=lambda r: r[:2])
    return fit([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), g) for _, _, s, v, g in taken], size=size)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Adds expected_grade (0 to 2), p_good (of the best grade) and p_toxic (of the worst) to the documents' columns.

    A null or empty text is scored from its shape alone; long texts are read whole. Repeated rows get the same scores each; an
    empty table gives no row. Extra columns are kept whatever their names, those named as the added ones replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        weights, thresholds = shared.value
        features = Features(len(weights))
        for texts in batches:
            scores = np.empty(len(texts))
            for i, text in enumerate(texts):
                slots, shape = features.of(text)
                scores[i] = float(weights[slots].sum() + shape @ weights[: len(shape)])
            above = 1 / (1 + np.exp(np.clip(thresholds[None] - scores[:, None], -40, 40)))
            yield pd.DataFrame({"expected_grade": above.sum(1), "p_good": above[:, -1], "p_toxic": 1 - above[:, 0]})

    fields = iterated("expected_grade double, p_good double, p_toxic double")(run)
    (scored,) = free(docs, "_scored")
    return docs.withColumn(scored, fields(F.col("text"))).withColumns({c: F.col(f"{scored}.{c}") for c in ("expected_grade", "p_good", "p_toxic")}).drop(scored)


#: A document is accepted if its odds of being toxic, and of being less than good, are no higher than these.
TOXIC_AT_MOST, POOR_AT_MOST = 0.5, 0.5


def accepted() -> Column:
    """Whether scored documents are kept."""
    return (F.col("p_toxic") <= TOXIC_AT_MOST) & (1 - F.col("p_good") <= POOR_AT_MOST)
