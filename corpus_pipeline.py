"""From raw documents to token ids: language, toxicity, near duplicates, benchmark leaks, encoding.

Rows are judged as they stand: null and empty texts have no letters and go with the first stage; very long texts are read
whole; repeated rows count as near duplicates of each other, of which one stays; rows with null ids are judged by their text
like others. Columns that the table has besides, named like results of the operators or not, go along through all stages. An
empty table gives none. Each stage is written to the shared folder and read again by the next, so that lost executors cost no
more than the stage that they were in.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultspan.llm import byte_bpe, decontaminate, language_id, ngram_join, toxicity
from faultspan.llm.common import saved
from faultspan.llm.queries import RANKS, table


#: What an Arrow batch of documents holds at most. Spark's own 64 MB, for each side of each task, are kept by executors from the
#: first stage on, besides what the n-gram join needs.
BATCH = "8m"


def stage(function):
    """A stage runs, and what it returns is written, with batches of BATCH."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return function(spark, docs, sf_dir)

    return run


@stage
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language ID rejects: texts without letters and texts unlike every language learned."""
    return language_id.fit(docs).predict(docs).where(~F.col("rejected")).select(*docs.columns)


@stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the classifier, learned from the labels of these documents, calls toxic."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).predict(docs).where("predicted = 0").select(*docs.columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the row with the smallest id, a null id last; of rows alike in all columns one.

    Rows are told apart by id and the hash of all columns, so rows that share an id, or have none, are judged one by one.
    Texts without words are like no other and stay.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"))
    linked = saved(ngram_join.linked(docs.select(own.alias("row"), "text"), "row"), "linked")
    marks = linked.groupBy("row").agg(F.count("*").alias("times"), F.max(F.col("row") != F.col("component_id")).alias("later")).where("later OR times > 1")
    marked = docs.withColumn("row", own).join(marks, "row", "left")
    kept = marked.where("later IS NULL").select(*docs.columns)
    often = marked.where("NOT later AND times > 1").dropDuplicates(["row"]).select(*docs.columns)
    return kept.unionByName(often) if marks.where("NOT later").take(1) else kept


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a benchmark item within its budget of edits."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to."""
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


STAGES = [("language_id", known_languages), ("toxicity", not_toxic), ("ngram_join", one_of_each), ("decontaminate", without_benchmark), ("byte_bpe", encoded)]

#: Trained classifiers and edit distances over whole texts are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = saved(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
