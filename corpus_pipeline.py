"""The corpus pipeline: documents through the training-data operators, stage by stage.

Every stage gets what the one before it kept and returns the columns of documents, but the
last, which returns one row of token digests a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import byte_bpe, decontaminate, quality_rules, simhash, suffix_dedup
from tablescope.llm.common import shared_dir, stored, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject. Null and empty texts have no words and
    go; repeated rows are judged each for itself; further columns, whatever their names, stay."""
    shared_dir(spark)
    judged = quality_rules.quality_rules(docs.select(F.struct("*").alias("_row"), "text"))
    return judged.where(F.col("failed_rule").isNull()).select("_row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: that of the smallest doc_id (a null id
    counts as the largest), of repeated rows one. Null and empty texts are one group; further
    columns stay; no rows give none."""
    return simhash.without_near_duplicates(docs)


#: Passages that the suffix-array stage cuts: so many words at least, found by windows of so
#: many bytes. (op9's query has 400 bytes by its contract; the shorter half of all passages of
#: over 50 words is below that.)
PASSAGE_WORDS, PASSAGE_WINDOW = 51, 200


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that stand twice or more, all copies of them; ``n_chars``
    follows the text. A document that loses all of its text stays, empty."""
    left = suffix_dedup.unrepeated_text(docs, PASSAGE_WINDOW, PASSAGE_WORDS)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(kind) if kind else None}
    return left.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a test item. Rows are told apart by id and
    text, so rows that repeat both share a verdict, and a null id is one like any other; null and
    empty texts hold nothing and stay; further columns stay; no items drop nothing."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.struct("*").alias("_row"))
    found = decontaminate.contaminated(keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select("_row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and decode it again: digests of the ids and the bytes, one row a
    document. Null and empty texts have no ids; repeated rows and null ids each give a row;
    further columns do not come along."""
    return byte_bpe.bpe_report(docs, *byte_bpe.public_vocabulary())


STAGES = [
    ("quality_rules", rules_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", bpe_stage),
]

#: Near-duplicates, suffix arrays, alignments and merges are not SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
