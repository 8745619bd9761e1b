"""A corpus pipeline over ``documents``: five stages, each written as Parquet and reread.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, whatever further ones they have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pumpwatch.llm import bpe_automaton, decontaminate, language_id, pii, simhash_dedup
from pumpwatch.llm.common import configure, read, work_dir
from pumpwatch.llm.queries import piece_vocabulary, word_bpe


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those with no letters or an unsure language go."""
    configure(spark)
    return language_id.known_language(docs, piece_vocabulary())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    configure(spark)
    return simhash_dedup.near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal values in their texts become pseudonyms."""
    return pii.pseudonymise(docs, found="_found").drop("_found")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with what they decode to.

    Tables are kept small: the workers also hold what the stages before have left in them.
    """
    configure(spark)
    return bpe_automaton.encode_documents(docs, word_bpe(), memory=0.5)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: SQL can't express the stages; a test holds the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on all that its predecessor kept."""
    docs = read(spark, sf_dir, "documents")
    folder = work_dir(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
