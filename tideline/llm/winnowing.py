"""Operator 9: document fingerprints by winnowing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, let

#: Words a gram and grams a window (a power of two): a run of GRAM + WINDOW - 1 equal words is always found.
GRAM, WINDOW = 3, 4
#: Modulus and base of the grams' polynomial; products stay below 2^62.
MODULUS, BASE = (1 << 31) - 1, 1_000_003


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen grams of a text as longs, each a 31-bit hash above its place counted from the end of 32 bits.

    Every word (lower case, between white space) is hashed once; a gram is the polynomial of its words' hashes modulo 2^31 - 1, so that the next one
    needs no word anew, and is mixed so that order among grams is that of chance. Of every window of `window` grams the smallest hash is
    chosen, the rightmost of equal ones: as the place is counted down, that is the smallest long. Minima come by
    doubling: of 2 grams, of 4, ... A text of at most one window's grams is one window; one of fewer words than a gram is
    one gram, and one without words, or null, has none. Very long texts are taken whole.
    """
    def grams(values: Column) -> Column:
        place = F.sequence(F.lit(0), F.greatest(F.size(values) - gram, F.lit(0)))

        def rolled(i: Column) -> Column:
            total = F.lit(0).cast("bigint")
            for k in range(gram):
                total = (total * BASE + F.coalesce(F.get(values, i + k), F.lit(0).cast("bigint"))) % MODULUS
            return F.shiftrightunsigned(F.xxhash64(total), 33)

        chosen = F.transform(place, lambda i: F.shiftleft(rolled(i), 32).bitwiseOR(F.lit(0xFFFFFFFF) - i))
        return F.when(F.size(values) > 0, chosen).otherwise(F.array().cast("array<bigint>"))

    def minima(values: Column) -> Column:
        def level(v: Column, width: int) -> Column:
            if width == window:
                return v
            pair = lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - width, F.lit(0))), F.slice(a, width + 1, F.greatest(F.size(a) - width, F.lit(0))), lambda x, y: F.least(x, y))
            return let(v, lambda a: level(pair(a), 2 * width))

        least = lambda v: F.when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v)
        return let(values, lambda v: F.when(F.size(v) > window, F.array_distinct(level(v, 1))).otherwise(least(v)))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    return minima(let(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 33)), grams))


def hashes(chosen: Column) -> Column:
    """The distinct hashes, without places."""
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, 32).cast("int")))


def written(chosen: Column) -> Column:
    """The fingerprint as text: hash:place of each chosen gram, in order of place."""
    return F.array_join(F.transform(chosen, lambda v: F.concat(F.lower(F.lpad(F.hex(F.shiftright(v, 32)), 8, "0")), F.lit(":"), (F.lit(0xFFFFFFFF) - v.bitwiseAND(F.lit(0xFFFFFFFF))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds fingerprint (text) and chosen (array of longs) to the documents' columns; see `winnow` for every case."""
    return docs.withColumn("chosen", winnow(F.col("text"), gram, window)).withColumn("fingerprint", written(F.col("chosen")))


def successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, row_hash, n_chars, copies, next_id, next_hash): each document's next one by descending doc_id, ties by the
    text's hash, the last one's being the first. Rows equal in both are one.

    Slim rows are dealt by ranges and written with their range's number; each range finds its own neighbours, and only
    the first row of each range goes through one task.
    """
    slim = docs.select("doc_id", "row_hash", "n_chars").groupBy("doc_id", "row_hash").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = [F.desc_nulls_last("doc_id"), F.asc("row_hash")]
    ranged = scratch.save(slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range").orderBy(*order)
    here = F.struct("doc_id", "row_hash")
    inside = ranged.withColumns({"next": F.lead(here).over(within), "place": F.row_number().over(within)})
    heads = inside.where("place = 1").select("range", here.alias("head"))
    all_ = Window.orderBy("range")
    ends = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = heads.select("range", F.coalesce(F.lead("head").over(all_), F.first("head").over(ends)).alias("beyond"))
    joined = inside.join(tails, "range").withColumn("next", F.coalesce("next", "beyond"))
    return scratch.save(joined.select("doc_id", "row_hash", "n_chars", "copies", F.col("next.doc_id").alias("next_id"), F.col("next.row_hash").alias("next_hash")), "successors")


def edited_likeness(docs: DataFrame, scratch: Scratch, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every document's fingerprint beside its edited text's and its next document's.

    The edited text is the text without its last floor(n / 3) code points, then the first as many (or all) of the next
    document. The whole text is shuffled once; the next document's row sends back only the part that is needed and
    its hashes. A null text counts as empty, repeated rows get the same result each, a null doc_id is last, an only document is
    its own next one, an empty table gives no row, and extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("row_hash", F.xxhash64("text"))
    chars = F.char_length("text").cast("bigint")
    after = successors(base.withColumn("n_chars", chars), scratch)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["next_id"]) & (a["row_hash"] == b["next_hash"])
    from_next = after.select(F.col("doc_id").alias("to_id"), F.col("row_hash").alias("to_hash"), F.col("n_chars").alias("to_chars"), "next_id", "next_hash")
    sender = base.dropDuplicates(["doc_id", "row_hash"]) if after.where("copies > 1").limit(1).count() else base
    sent = sender.join(from_next, same(sender, from_next)).select("to_id", "to_hash", F.expr("substring(text, 1, cast(to_chars div 3 as int))").alias("piece"), hashes(winnow(F.col("text"), gram, window)).alias("next_hashes"))
    met = base.join(sent, base["doc_id"].eqNullSafe(sent["to_id"]) & (base["row_hash"] == sent["to_hash"]))
    # Lengths are taken after the shuffle: both uses of the text then have the same columns, and share one exchange.
    edited = met.withColumn("n_chars", chars).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), piece)"))
    chosen = edited.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), winnow(F.col("text"), gram, window).alias("own"), winnow(F.col("edited"), gram, window).alias("changed"), "next_hashes")
    return chosen.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        let(hashes(F.col("own")), lambda a: F.array(likeness(a, hashes(F.col("changed"))), likeness(a, F.col("next_hashes")))).alias("_near"),
    ).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("_near")[0].alias("near_edited"), F.col("_near")[1].alias("near_next"))
