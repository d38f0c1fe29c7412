"""The corpus pipeline: five stages over documents, each reading what the one before wrote.

Quality rules drop documents, near-dedup keeps one document of each group,
substring dedup takes repeated passages out of texts, decontamination drops
documents with a benchmark passage, and the last stage encodes what is left.
All stages but the last return the columns of documents.  A null or empty text
fails the quality rules; an empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import byte_bpe, decontaminate, minhash, quality_rules, substring_dedup
from pointloom.llm.frames import shared_folder, table
from pointloom.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the line field keep; the field learns from the labelled raw documents."""
    model = quality_rules.fit_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates."""
    return minhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds."""
    return substring_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded text."""
    return byte_bpe.digests(docs, byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY)))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substrings), ("decontamination", decontamination), ("byte bpe", encoding)]

#: The line field and the estimates of near-dedup have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder where Spark's own file systems see it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each gives is written in the shared folder, read again, and deleted once the next has been written.

    What the last but one gives stays, as the result reads it.
    """
    docs, root, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{root}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
