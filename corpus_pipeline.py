"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import lines, mixing, packing, quality, simhash
from tideline.llm.common import Scratch, named, table
from tideline.llm.queries import ratings

#: Words a shingle has in the near-duplicate stage, and bits of 64 in which fingerprints of candidates differ at most that share no band.
SHINGLE, DISTANCE = 5, 4
#: No SQL expresses the classifier, the near duplicates' components or the packing.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels, accepts. A null or empty text is judged by its shape alone; repeated
    rows share one judgement; without labels, or of an empty table, every text has the same odds."""
    model = quality.learn(docs, ratings(spark, sf_dir))
    return quality.score(docs, model).where(quality.accepted()).select(*named(*docs.columns))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat earlier ones; n_chars follows the text. Null texts stay null, with a null n_chars;
    documents whose lines all go stay with an empty text; repeated rows share one decision; an empty table gives no row."""
    cut = lines.dedup_lines(docs, Scratch(spark, "pipeline-lines"))
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*named(*docs.columns))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Links are candidates of the
    SimHash operator whose texts have a Jaccard similarity of 0.8 or more. Of rows with that doc_id one stays; of rows without a doc_id, all of a
    group that has no row with one. Texts without words are one group; an empty table gives no row."""
    found = simhash.near_duplicates(docs, Scratch(spark, "pipeline-simhash"), words=SHINGLE, distance=DISTANCE, similar=True)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows"))
    stays = docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(kept["_kept"]))
    if kept.where("_rows > 1 and _kept is not null").limit(1).count():
        once = stays.where("_kept is not null").dropDuplicates(["_kept"])
        stays = once.unionByName(stays.where("_kept is null"))
    return stays.select(*named(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them; every one at least once, so repeated rows stay repeated. Null sources are one
    source; null and empty texts count as a token; an empty table gives no row."""
    return mixing.mix(docs, Scratch(spark, "pipeline-mixing")).select(*named(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, with the ids. Null and empty texts have their end id alone; repeated rows are packed as often; an empty table
    gives no row."""
    return packing.pack(docs, include_ids=True)


STAGES = [("quality", keep_good), ("lines", cut_lines), ("near_duplicates", keep_one), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
