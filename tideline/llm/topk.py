"""Operator 5: exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Rows of a candidate block and of a query block, and queries that are accumulated at a time.
CANDIDATES, QUERIES, AT_ONCE = 4096, 4096, 64
#: Components of query blocks that may be broadcast (12 bytes each); beyond that blocks meet by an exchange, in which a query block is dealt to so many groups of candidate blocks.
SMALL, GROUPS = 1 << 22, 64
BLOCK = "keys array<long>, ids array<long>, rows array<int>, terms array<int>, weights array<long>"


def quantized(column: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(column: str) -> Column:
    """Vectors that are not null and hold neither nulls nor non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, finite), F.lit(False))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors (key, vec_id, v) as blocks of at most `size` rows: keys, ids, and the nonzero components as (row, term, weight).

    A task fills its blocks from its own rows, so there are at most as many part-filled ones as tasks.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held: list = []

        def block(part):
            lengths = np.array([len(v) for v in part["v"]], np.int64)
            flat = np.concatenate([np.asarray(v, np.int64) for v in part["v"]]) if lengths.sum() else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(part)), lengths)
            terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            on = flat != 0
            return pd.DataFrame({"keys": [part["key"].to_numpy(np.int64)], "ids": [part["vec_id"].to_numpy(np.int64)], "rows": [rows[on].astype(np.int32)], "terms": [terms[on].astype(np.int32)], "weights": [flat[on]]})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= size:
                whole = pd.concat(held, ignore_index=True)
                full = len(whole) // size * size
                for i in range(0, full, size):
                    yield block(whole.iloc[i : i + size])
                held = [whole.iloc[full:]]
        if sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    return vectors.select("key", "vec_id", "v").mapInPandas(run, BLOCK)


def accumulate(n: int, postings: dict, rows, terms, weights, scores) -> None:
    """Scatters the sparse query rows, term after term, through the terms' postings into the dense scores (queries x n)."""
    import numpy as np

    order = np.argsort(terms, kind="stable")
    met, starts = np.unique(terms[order], return_index=True)
    for t, part in zip(met.tolist(), np.split(order, starts)[1:], strict=True):
        if t not in postings:
            continue
        at, w = postings[t]
        q = rows[part]
        # A query has a term once, so q has no repeats; likewise at.
        if len(at) == n:
            scores[q] += weights[part][:, None] * w[None]
        else:
            scores[q[:, None], at[None]] += weights[part][:, None] * w[None]


def best(scores, ids, keys, own, k: int):
    """Each query's k best of a dense score array: partition at the k-th score, then order what reaches it by (-score, id)."""
    import numpy as np

    for q in range(len(scores)):
        row = scores[q]
        allowed = np.flatnonzero(keys != own[q])
        if len(allowed) > k:
            least = np.partition(row[allowed], len(allowed) - k)[len(allowed) - k]
            allowed = allowed[row[allowed] >= least]
        yield allowed[np.lexsort((ids[allowed], -row[allowed]))[:k]]


def top_k(vectors: DataFrame, queries: Column, scratch: Scratch, k: int = 10, column: str = "embedding", scale: int = 1024, small: int = SMALL) -> DataFrame:
    """Each query row's k highest integer inner products with all other rows, ties to the smaller vec_id.

    Rows get a key of their own and are written once, so that both sides read the same keys whatever fails. Candidates
    become blocks of postings by term, queries blocks of sparse rows. Every candidate block meets every query block: the
    query blocks are broadcast if they are small, which leaves the candidates where they lie and every task of their scan
    at work; else both are dealt to (query block, group of candidate blocks). There the weights of the queries are
    scattered, term after term, through the terms' postings into dense score arrays, whose k best rows leave. A window
    over the query row's key then merges what the blocks sent, k rows each, cut again before the exchange.

    Null ids take no part, as null vectors and those with null or non-finite components. Missing components count as zero,
    so empty vectors score 0. A row isn't its own candidate; other rows are, also those with the same vec_id or all
    values equal, and each repeated query row has its own k rows (of equal candidates any). An empty table gives no row; extra
    columns are ignored; a block of very long vectors is held whole, CANDIDATES of them at most.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & usable(column))
    slim = good.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("bigint").alias("vec_id"), quantized(column, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = scratch.save(slim, "vectors")
    names = [c.split()[0] for c in BLOCK.split(", ")]
    parts = -(-max(1, rows.where("q").count()) // QUERIES)
    dealt = rows.where("q").repartition(parts, "key")
    asked = scratch.save(blocks(dealt, QUERIES).select(F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part"), *[F.col(c).alias(f"q_{c}") for c in names]), "queries")
    candidates = blocks(rows, CANDIDATES).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if (asked.agg(F.sum(F.size("q_weights")).alias("n")).first()["n"] or 0) <= small:
        pairs = candidates.join(F.broadcast(asked), "part")
    else:
        grouped = candidates.withColumn("group", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(GROUPS)).cast("int"))
        copies = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
        pairs = grouped.join(copies.hint("shuffle_hash"), ["part", "group"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for b in batch.itertuples():
                order = np.argsort(b.terms, kind="stable")
                terms, starts = np.unique(b.terms[order], return_index=True)
                postings = {t: (b.rows[p], b.weights[p]) for t, p in zip(terms.tolist(), np.split(order, starts)[1:], strict=True)}
                q_order = np.argsort(b.q_rows, kind="stable")
                q_rows, q_terms, q_weights = b.q_rows[q_order], b.q_terms[q_order], b.q_weights[q_order]
                for at in range(0, len(b.q_ids), AT_ONCE):
                    own = b.q_keys[at : at + AT_ONCE]
                    lo, hi = np.searchsorted(q_rows, [at, at + AT_ONCE])
                    scores = np.zeros((len(own), len(b.ids)), np.int64)
                    accumulate(len(b.ids), postings, q_rows[lo:hi] - at, q_terms[lo:hi], q_weights[lo:hi], scores)
                    found = list(best(scores, b.ids, b.keys, own, k))
                    sizes = [len(f) for f in found]
                    took = np.concatenate(found) if sizes else np.zeros(0, np.int64)
                    who = np.repeat(np.arange(len(own)), sizes)
                    yield pd.DataFrame({"key": own[who], "query_id": b.q_ids[at : at + AT_ONCE][who], "vec_id": b.ids[took], "score": scores[who, took]})

    partial = pairs.select(*names, *[f"q_{c}" for c in names]).mapInPandas(run, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
