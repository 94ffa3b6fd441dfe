"""The corpus pipeline: each stage works on all that the stage before it kept.

Documents whose language is not recognised go; repeated lines go; of near
copies, by the texts as they came or as they are now, one document stays;
passages that repeat across documents go but for
their first occurrence; what is left is packed into length buckets. Every
stage but the last returns documents with the columns it was given; ``n_chars``
follows the text.

Defined results: null, empty and letterless texts are rejected by the first
stage. Rows with equal id and text are one document, and one of them stays;
rows with equal id but other text are documents each. A null id stands before
all others; ids may be of any type that can be ordered. Texts are never cut
short. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import common, langid, linededup, packing, simhash, suffix


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those with nothing left go."""
    return linededup.keep_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Without its repeated lines a near copy is a fragment that resembles nothing:
    documents are compared as they came, too.
    """
    return simhash.keep_first(docs, common.table(spark, sf_dir, "documents"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that occur earlier; those with nothing left go."""
    return suffix.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and place."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_dedup), ("packing", pack)]

#: SQL cannot express the fitted language model nor the fingerprints; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written and read again; what a stage wrote on its way is deleted then."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs)
            common.clear(spark, docs)
    return docs
