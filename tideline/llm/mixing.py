"""Operator 4: mixing sources to target weights by temperature, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free
from .common import named as columns_named

#: Share of the sources' largest entropy to meet, copies of a token that are allowed on average, and tokens a block has.
ENTROPY, REPETITION, BLOCK = 0.97, 2.0, 1 << 16
#: Source rows that may be broadcast, and salts of the join beyond that.
SMALL, SALTS = 10_000, 64


def token_count(column: str = "text") -> Column:
    """Words between white space; a null or empty text has none, and counts as one token so that it keeps a place."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(column, F.lit("[^ \\t-\\r]+")), F.lit(0))).cast("bigint")


def source_totals(docs: DataFrame) -> DataFrame:
    """Tokens of every source over all documents; null is a source of its own."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("total"))


def _at(totals: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: the entropy of the weights share^a as a share of the largest possible, and the ratio of most to least repeated.

    One pass over the sources' rows (log shares), one output row an exponent, whatever the number of sources.
    """
    grid = F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a")
    w = F.exp(F.col("a") * F.col("ls"))
    rows = totals.select("ls", grid).groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * F.col("ls")).alias("e"), F.count("*").alias("n"), F.min("ls").alias("lo"), F.max("ls").alias("hi"))
    out = {}
    for r in rows.collect():
        entropy = (math.log(r["z"]) - r["e"] / r["z"]) / math.log(r["n"]) if r["n"] > 1 else 1.0
        out[r["a"]] = (entropy, math.exp((1 - r["a"]) * (r["hi"] - r["lo"])))
    return out


def exponent(totals: DataFrame, entropy: float | None = ENTROPY, repetition: float | None = REPETITION, passes: int = 6, cuts: int = 16) -> float:
    """The exponent in 0..1 nearest 1 that reaches the target entropy (without one: 0), raised as far as the repetition limit asks.

    Entropy falls and repetition shrinks as the exponent rises, so each is bisected; a pass tries `cuts` exponents at once.
    """

    def solve(fits) -> float:
        """The largest exponent for which `fits` holds, which holds up to some point; 0 if for none."""
        lo, hi = 0.0, 1.0
        for _ in range(passes):
            grid = sorted({lo + (hi - lo) * i / cuts for i in range(cuts + 1)})
            if not (got := _at(totals, grid)):
                return hi
            good = [a for a in grid if fits(*got[a])]
            lo = max(good, default=grid[0])
            hi = min([a for a in grid if a > lo], default=lo)
            if hi - lo < 1e-7:
                break
        return lo

    a = 0.0
    if entropy is not None:
        a = solve(lambda e, _: e >= entropy)
    if repetition is not None:
        low = solve(lambda _, r: r > repetition)
        a = max(a, low if _at(totals, [low]).get(low, (1.0, 1.0))[1] <= repetition else min(1.0, low + 1e-6))
    return a


def plan(docs: DataFrame, scratch: Scratch, entropy: float | None = ENTROPY, repetition: float | None = REPETITION, block: int = BLOCK) -> DataFrame:
    """(source, total, weight, epochs, blocks): each source's normalised weight share^a / sum, the budget being the
    smallest that leaves no document out, and how often its tokens are then taken."""
    # Written once: every pass of the search reads a row a source, and not the texts again.
    totals = scratch.save(source_totals(docs), "totals")
    whole = totals.agg(F.sum("total").alias("s")).first()["s"] or 1
    shares = totals.withColumn("ls", F.log(F.col("total") / F.lit(float(whole))))
    a = exponent(shares, entropy, repetition)
    top = shares.agg(F.max("ls").alias("m"), F.sum(F.exp(F.col("ls") * a)).alias("z")).first()
    m, z = top["m"] or 0.0, top["z"] or 1.0
    epochs = F.exp((F.col("ls") - m) * (a - 1)) if a < 1 else F.lit(1.0)
    return shares.select("source", "total", (F.exp(F.col("ls") * a) / z).alias("weight"), epochs.alias("epochs"), F.greatest(F.lit(1), F.ceil(F.col("total") / block)).cast("bigint").alias("blocks"))


def mix(docs: DataFrame, scratch: Scratch, entropy: float | None = ENTROPY, repetition: float | None = REPETITION, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The documents as often as the mixture takes them, with tokens, copy (from 0), block, position and weight.

    Source totals cover all documents. The temperature's exponent is bisected on them; the largest source is taken
    once, so nothing is dropped, and smaller sources up to `repetition` times. A source's documents are dealt by hash to
    blocks of about `block` tokens; each block is permuted by a seeded hash for every epoch, and of the last, partial epoch
    a block takes the first documents of its permutation within its budget (the one that crosses it is taken if at
    least half of it fits). A block bounds what a window task holds, so a hot source is many small groups.

    Null sources make one source; null and empty texts count as one token; long texts are counted whole; an empty table
    gives no row. Repeated rows would share a hash, and so a block: where copies fill more than a block, they are dealt by
    their place in the table too, for which the table is written first. Extra columns are kept
    whatever their names, those named as the added ones replaced.
    """
    src, epochs_, blocks_, own_, turn_, before_, budget_, place_, many_, salt_, part_ = free(docs, "_source", "_epochs", "_blocks", "_own", "_turn", "_before", "_budget", "_place", "_many", "_salt", "_part")
    named = [c for c in docs.columns if c.lower() not in ("tokens", "weight", "block", "position", "copy")]
    own = F.xxhash64(*columns_named(*[c for c in named if not isinstance(docs.schema[c].dataType, _unhashable())]), F.lit(seed))
    keyed = docs.select(*columns_named(*named), token_count().alias("tokens"), own.alias(own_))
    crowds = keyed.groupBy(own_).agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")).where((F.col("n") > block) & (F.col("rows") > 1)).select(F.col(own_).alias(many_))
    crowds = scratch.save(crowds, "crowds")
    if crowds.limit(1).count():
        few = crowds.limit(SMALL + 1).count() <= SMALL
        placed_rows = scratch.save(keyed, "input").withColumn(place_, F.monotonically_increasing_id())  # a place that a repeated task finds again
        met = placed_rows.join(F.broadcast(crowds) if few else crowds, F.col(own_) == F.col(many_), "left")
        keyed = met.withColumn(own_, F.when(F.col(many_).isNull(), F.col(own_)).otherwise(F.xxhash64(own_, place_))).drop(many_, place_)
    totals = docs.select("source", token_count().alias("tokens"))
    planned = plan(totals, scratch, entropy, repetition, block).select(F.col("source").alias(src), "weight", F.col("epochs").alias(epochs_), F.col("blocks").alias(blocks_))
    if planned.limit(SMALL + 1).count() <= SMALL:
        joined = keyed.join(F.broadcast(planned), F.col("source").eqNullSafe(F.col(src)))
    else:
        spread = planned.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = keyed.withColumn(part_, F.pmod(own_, F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col(src)) & (F.col(part_) == F.col(salt_))).drop(part_, salt_)
    blocked = joined.withColumn("block", F.pmod(F.xxhash64(own_, F.lit(1)), F.col(blocks_)))
    full = F.floor(epochs_).cast("int")
    turn = F.xxhash64(own_, F.lit(2))
    group = Window.partitionBy("source", "block")
    before = F.sum("tokens").over(group.orderBy(turn_, own_).rowsBetween(Window.unboundedPreceding, -1))
    budget = (F.col(epochs_) - full) * F.sum("tokens").over(group.orderBy(turn_, own_).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = blocked.withColumn(turn_, turn).withColumns({before_: F.coalesce(before, F.lit(0)), budget_: budget, "position": F.row_number().over(group.orderBy(turn_, own_)).cast("bigint")})
    more = F.when(F.col(before_) + F.col("tokens") / 2 <= F.col(budget_), 1).otherwise(0)
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), full + more - 1)))
    return copies.drop(src, own_, turn_, before_, budget_, epochs_, blocks_)


def _unhashable():
    from pyspark.sql.types import MapType, VariantType

    return (MapType, VariantType)
