"""From raw documents to token ids: quality, near copies, benchmark leaks, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm import bpe, jaccard, pseudonyms, quality, templates
from yieldloom.llm.common import read
from yieldloom.session import scratch_path


#: The stage of near copies compares sets of five words at a similarity of 0.8; the op1 query has its own contract.
WIDTH, PERCENT = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of these doc_ids; a null id is an id of its own. Ids are broadcast where counted to be few."""
    ids = templates.few(ids.select(F.col("doc_id").alias("gone")).distinct())
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["gone"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject; rows that share a doc_id share its verdict."""
    return without(docs, quality.quality_rules(docs).filter("not kept"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies, once. Rows without a doc_id all stay.

    Of rows that share a doc_id those with different texts stay.
    """
    groups = jaccard.jaccard_groups(docs, width=WIDTH, percent=PERCENT)
    kept = without(docs, groups.filter("component_id <> doc_id"))
    again = groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if again.isEmpty():
        return kept
    once = kept.join(again.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(kept, again).unionByName(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, re-parameterised or not."""
    return without(docs, templates.decontaminate(docs, read(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; n_chars follows the new text."""
    return pseudonyms.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("bpe_encoding", bpe_encoding),
]
#: Encoding can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
