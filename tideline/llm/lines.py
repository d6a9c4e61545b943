"""Operator 2: line dedup by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free, let

#: Slots of the table of word counts by hash.
SLOTS_BITS = 18
#: Distinct words of a line that can match at least, and sets that may share a prefix word before the first of them goes ahead.
LEAST, CROWD = 1, 32
#: Prefix words of a set by which crowds are looked for: the most frequent ones by which sets of equal size can still match.
MET = 2
#: Jaccard is 4/5 throughout: o common words of n1 and n2 reach it if 9 o >= 4 (n1 + n2). Sets of up to so many words only match equal ones.
EQUAL = 3


def plain_text(text: Column) -> Column:
    """Lower case, with blanks for all white space but line ends."""
    low = F.lower(text)
    other = F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\x0b")) | F.contains(low, F.lit("\x0c")) | F.contains(low, F.lit("\r"))
    return F.when(other, F.regexp_replace(low, "[\\t\\x0b\\x0c\\r]", " ")).otherwise(low)


def line_words(line: Column) -> Column:
    """The words of a line of plain text."""
    return F.array_remove(F.split(line, " "), "")


def rarity(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row, one array: for each slot of 2^SLOTS_BITS its place when slots are ordered by their words' count over all
    lines, xor the slot, in the leading bits of a long: a word's hash xor that is its key. The table's size is fixed,
    whatever the vocabulary; words that share a slot are ordered by the rest of their hash."""
    words = docs.select(F.explode(F.split(F.replace(plain_text(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counted = words.select(F.shiftrightunsigned(F.xxhash64("word"), 64 - SLOTS_BITS).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(1 << SLOTS_BITS).withColumnRenamed("id", "slot")
    placed = every.join(counted, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))
    place = (F.row_number().over(Window.orderBy("n", "slot")) - 1 - (1 << (SLOTS_BITS - 1))).cast("bigint")
    ranked = placed.select("slot", F.shiftleft(place.bitwiseXOR(F.col("slot")), 64 - SLOTS_BITS).alias("lead"))
    return scratch.save(ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "lead"))), lambda s: s["lead"]).alias("leads")), "rarity")


def keyed_lines(docs: DataFrame, leads: Column, least: int = LEAST) -> DataFrame:
    """Every line of `least` distinct words or more: (doc_id, row_hash, line, k1, k2, n, odd1, odd2, prefix).

    A word's key is its 64-bit hash with the leading bits replaced by its slot's place: one to one, and rare words come
    first. k1 and k2 hash the whole set. Bit b of the 128 in odd2 and odd1 is set if an odd number of keys has b in its
    last seven bits, so two sets differ in at least as many words as these in bits. prefix has the rarest words, of which a similar set must have one; a set of EQUAL words or less needs none.
    """
    at = docs.select("doc_id", "row_hash", F.posexplode(F.split(plain_text(F.col("text")), "\n")).alias("line", "words")).where("words != ''")
    # Not filtered by its size before the end: a filter would compute the words twice.
    hashed = at.select("doc_id", "row_hash", "line", F.array_distinct(F.transform(line_words(F.col("words")), lambda w: F.xxhash64(w))).alias("hashed"))
    key = lambda h: h.bitwiseXOR(F.get(F.col("leads"), F.shiftrightunsigned(h, 64 - SLOTS_BITS).cast("int")))
    sets = hashed.withColumn("leads", leads).select("doc_id", "row_hash", "line", F.sort_array(F.transform("hashed", key)).alias("keys"))
    none = F.lit(0).cast("bigint")
    side = lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1).cast("bigint"))
    odd = lambda bit: F.aggregate("keys", none, lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))
    upper = odd(side)
    lower = odd(lambda k: F.lit(1).cast("bigint")).bitwiseXOR(F.col("odd2"))
    prefix = F.when(F.size("keys") > EQUAL, F.expr("slice(keys, 1, size(keys) - (4 * size(keys) + 4) div 5 + 1)"))
    marked = sets.withColumn("odd2", upper)
    return marked.select("doc_id", "row_hash", "line", F.xxhash64("keys").alias("k1"), F.xxhash64("keys", F.lit(1)).alias("k2"), F.size("keys").alias("n"), lower.alias("odd1"), "odd2", prefix.alias("prefix"))


def distinct_sets(lines: DataFrame) -> DataFrame:
    """One row a set of words (k1, k2): n, odd1, odd2, prefix, its first place and how many lines have it."""
    kept = [F.first(c).alias(c) for c in ("n", "odd1", "odd2", "prefix")]
    return lines.groupBy("k1", "k2").agg(*kept, F.min(F.struct("doc_id", "row_hash", "line")).alias("place"), F.count("*").alias("times"))


def entries(sets: DataFrame, decided: DataFrame | None = None, last: int | None = None) -> DataFrame:
    """(word, k1, ni, odd1, odd2, doc, done): one slim row for each prefix word of each distinct set, or the `last` of its first n / 9; ni packs the
    set's size and the word's position, doc is the doc_id of the set's first place, done whether `decided` (k1, k2) has the set."""
    sets, done = sets.where("prefix is not null"), F.lit(0).cast("bigint")
    before = F.greatest(F.expr("n div 9").cast("int") + 1 - last, F.lit(0)) if last else F.lit(0)
    if decided is not None:
        sets = sets.join(decided.select("k1", "k2", F.lit(1).alias("_done")), ["k1", "k2"], "left")
        done = F.coalesce("_done", F.lit(0)).cast("bigint")
    each = sets.select("k1", "n", "odd1", "odd2", F.col("place.doc_id").alias("doc"), done.alias("done"), before.alias("before"), F.posexplode(F.slice("prefix", before + 1, F.least(F.expr("n div 9").cast("int") + 1, F.lit(last))) if last else F.col("prefix")).alias("i", "word"))
    packed = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR((F.col("i") + F.col("before")).cast("bigint"))
    return each.select("word", "k1", packed.alias("ni"), "odd1", "odd2", "doc", "done")


def may_match(x: str, y: str) -> Column:
    """Whether two entries' lengths, the word's positions and the odd bits leave room for Jaccard 0.8.

    o common words of sizes n1 and n2 are needed with 9 o >= 4 (n1 + n2); such sets differ in n1 + n2 - 2 o words at most.
    """
    n1, n2 = F.shiftright(f"{x}ni", 32), F.shiftright(f"{y}ni", 32)
    left1, left2 = (n - F.col(f"{c}ni").bitwiseAND(F.lit(0xFFFFFFFF)) for n, c in ((n1, x), (n2, y)))
    apart = sum(F.bit_count(F.col(f"{x}odd{b}").bitwiseXOR(F.col(f"{y}odd{b}"))) for b in (1, 2))
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * apart <= n1 + n2) & (9 * F.least(left1, left2) >= 4 * (n1 + n2))


def named(table: DataFrame, prefix: str) -> DataFrame:
    return table.select([F.col(c).alias(f"{prefix}{c}") for c in table.columns])


def with_firsts(sets: DataFrame, last: int | None = None) -> DataFrame:
    """(a, b, head): sets against the first set, by document, of each word that more than CROWD sets have as a prefix word, or
    among the `last` of their first n / 9 + 1 words.

    A crowd of near copies mostly matches its first member, so that its pairs need not be formed; the number of rows is
    at most that of the entries. Rare words of their own come first in a prefix, so the later ones are what near copies
    share; behind the first n / 9 + 1 sets of n words differ too much (9 (n - i) < 8 n) unless an earlier one is shared.
    """
    # One exchange by word serves the aggregate and the join: both use the same columns, and neither filters more than the other.
    known = " and ".join(f"{c} is not null" for c in ("word", "k1", "ni", "odd1", "odd2", "doc"))
    rows = entries(sets, last=last).drop("done").withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63)))).where(known).repartition("word")
    first = F.min_by(F.struct("k1", "ni", "odd1", "odd2", "doc"), F.struct("doc", "k1"))
    heads = rows.groupBy("word").agg(F.count("*").alias("n"), first.alias("h")).where(F.col("n") > CROWD)
    heads = heads.select(F.col("word").alias("h_word"), *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("k1", "ni", "odd1", "odd2", "doc")])
    met = named(rows, "x_").join(heads, (F.col("x_word") == F.col("h_word")) & (F.col("x_k1") != F.col("h_k1")) & (F.col("x_doc") >= F.col("h_doc")) & may_match("x_", "h_"))
    return met.select(F.least("x_k1", "h_k1").alias("a"), F.greatest("x_k1", "h_k1").alias("b"), F.col("h_k1").alias("head")).distinct()


def crowded(firsts: DataFrame, sets: DataFrame) -> bool:
    """Whether crowds could make more pairs among themselves than there are sets."""
    pairs = firsts.groupBy("head").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    return pairs > sets.count()


def with_all(sets: DataFrame, decided: DataFrame | None) -> DataFrame:
    """(a, b): sets that aren't decided against all others that share a prefix word, each pair from one side."""
    rows = entries(sets, decided).drop("doc")
    # x is open, and y is done or has the larger key. As one term over both sides it isn't pushed below the exchange, which both sides then share.
    twice = F.when((F.col("y_done") == 1) | (F.col("x_k1") < F.col("y_k1")), 0).otherwise(1)
    met = named(rows, "x_").join(named(rows, "y_"), (F.col("x_word") == F.col("y_word")) & (F.col("x_k1") != F.col("y_k1")) & (F.col("x_done") + twice == 0) & may_match("x_", "y_"))
    return met.select(F.least("x_k1", "y_k1").alias("a"), F.greatest("x_k1", "y_k1").alias("b")).distinct()


def later_of_similar(pairs: DataFrame, sets: DataFrame, base: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(k1, k2, other): of each pair that is similar word by word, the set whose first place is later, with an earlier place."""
    needed = pairs.select(F.col("a").alias("k1")).union(pairs.select(F.col("b").alias("k1"))).distinct()
    at = F.col("place")
    asked = sets.join(needed, "k1").groupBy(at["doc_id"].alias("_d"), at["row_hash"].alias("_r")).agg(F.collect_list(F.struct(at["line"].alias("line"), "k1", "k2", "place")).alias("asked"))
    met = base.select("doc_id", "row_hash", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_hash") == F.col("_r")))
    row = lambda parts, s: F.struct(s["k1"].alias("k1"), s["k2"].alias("k2"), s["place"].alias("place"), F.array_distinct(line_words(F.get(parts, s["line"]))).alias("words"))
    rows = let(F.split(plain_text(F.col("text")), "\n"), lambda parts: F.transform("asked", lambda s: row(parts, s)))
    read = met.select(F.inline(rows))
    words = scratch.save(read, f"{tag}-sets")
    # Repeated rows each answer for their sets.
    if words.groupBy("k1").count().where("count > 1").limit(1).count():
        words = scratch.save(words.dropDuplicates(["k1"]), f"{tag}-once")
    both = F.size(F.array_intersect("a_words", "b_words"))
    near = pairs.join(named(words, "a_"), F.col("a") == F.col("a_k1")).join(named(words, "b_"), F.col("b") == F.col("b_k1")).where(9 * both >= 4 * (F.size("a_words") + F.size("b_words")))
    pick = lambda late, early: F.struct(F.col(f"{late}_k1").alias("k1"), F.col(f"{late}_k2").alias("k2"), F.col(f"{early}_place").alias("other"))
    later = near.select(F.when(F.col("a_place") < F.col("b_place"), pick("b", "a")).otherwise(pick("a", "b")).alias("_l")).select("_l.*")
    found = scratch.save(later.groupBy("k1", "k2").agg(F.min("other").alias("other")), f"{tag}-later")
    for done in (f"{tag}-sets", f"{tag}-once", tag):
        scratch.drop(done)
    return found


def first_places(base: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, keep): for every set with a second line or an earlier similar set, its first place or one before it.

    Two rounds: against the first of each crowd, then what that leaves against all. A set is decided by any earlier
    similar one, so what the first round decides need not be paired again but still counts as a partner. Where crowds, looked
    for by MET words a set, make few pairs, the first round is left out, as the second forms its pairs too.
    """
    one = None
    if crowded(scratch.save(with_firsts(sets, MET), "met"), sets):
        one = later_of_similar(scratch.save(with_firsts(sets).select("a", "b").distinct(), "one"), sets, base, scratch, "one")
    scratch.drop("met")
    two = later_of_similar(scratch.save(with_all(sets, one), "two"), sets, base, scratch, "two")
    found = two if one is None else one.unionByName(two)
    other = found.groupBy("k1", "k2").agg(F.min("other").alias("other"))
    return sets.join(other, ["k1", "k2"], "left").where("times > 1 or other is not null").select("k1", "k2", F.coalesce("other", "place").alias("keep"))


def dedup_lines(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Documents without the lines whose set of words has Jaccard 0.8 or more with that of an earlier line.

    Returns all columns, with text cut, and n_lines and removed (numbers of the lines taken out). "Earlier" is the order of
    (doc_id, text hash, line). Lines of fewer than `least` distinct words never match, nor do lines without a word. Every later
    match goes, also if the line it matches goes itself. Lines with equal sets of words meet as one set; sets meet by
    prefix words, and what passes the filters is compared word by word, so the result is exact up to 64-bit hashes.

    Rows equal in doc_id and text share one decision. A null doc_id comes before all others; null and empty texts stay as
    they are; very long texts and lines are read whole. An empty table gives no row. Extra columns are kept whatever their
    names, those named as the added ones replaced.
    """
    row, d, r, gone_, text_ = free(docs, "_row", "_d", "_r", "_gone", "_text")
    base = docs.withColumn(row, F.xxhash64("text"))
    slim = base.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(row).alias("row_hash"), "text")
    every = scratch.save(keyed_lines(slim, rarity(slim, scratch).scalar()), "every").where(F.col("n") >= max(1, least))
    sets = scratch.save(distinct_sets(every), "sets")
    lines = scratch.save(every.select("k1", "k2", "doc_id", "row_hash", "line"), "lines")
    for done in ("rarity", "every"):
        scratch.drop(done)
    keep = first_places(slim, sets, scratch)
    # Written, so that both sides of the join are plain exchanges: the adaptive join then splits the rows of a line that many documents share.
    kept = scratch.save(keep, "keep")
    later = lines.join(kept, ["k1", "k2"]).where(F.struct("doc_id", "row_hash", "line") > F.col("keep"))
    gone = later.groupBy(F.col("doc_id").alias(d), F.col("row_hash").alias(r)).agg(F.sort_array(F.collect_set("line")).alias(gone_))
    gone = scratch.save(gone, "gone")
    for done in ("lines", "sets", "keep", "one-later", "two-later"):
        scratch.drop(done)
    met = base.join(gone, base["doc_id"].eqNullSafe(gone[d]) & (base[row] == gone[r]), "left")
    parts = F.split("text", "\n")
    left = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone_)), lambda i: F.get(p, i))
    rest = let(parts, left)
    done = met.withColumns({"n_lines": F.coalesce(F.size(parts), F.lit(0)), "removed": F.coalesce(gone_, F.array().cast("array<int>")), text_: F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))})
    return done.withColumn("text", F.col(text_)).drop(text_, gone_, d, r, row)
