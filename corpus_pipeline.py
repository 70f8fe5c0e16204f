"""The corpus pipeline: documents to packed training sequences, in four stages.

``run`` applies the stages to ``documents``; each stage's result is written as
Parquet in the shared folder and read again as the next one's documents. Every
stage takes nulls in any column, empty and very long texts, repeated rows and
columns beyond those of ``documents``, whatever their names (all but the last
stage hand them on); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import table, written
from cohortwise.llm.packing import packed
from cohortwise.llm.quality import kept_documents
from cohortwise.llm.simhash import simhash_dedup
from cohortwise.llm.suffix_dedup import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier rejects go; all others stay as they are.

    Rows with a null id are judged by their text; null and empty texts stay, a
    null language is a language of its own, and a language without trusted
    text keeps all. A perplexity equal to the threshold stays. Repeated rows
    stay or go together. Very long texts are read whole, in pieces.
    """
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    A null id is larger than any other; of rows that share the smallest id, and
    of repeated rows, one stays, chosen by hashes of all columns. Null and empty texts
    have no words and are one class (fingerprint 0).
    """
    return simhash_dedup(docs, "doc_id", "text")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes are cut out of the texts; n_chars follows. No document goes.

    All places of a repeated string are cut, those of repeated rows too; a null text becomes
    an empty one, a shorter one stays. Where a cut parts a character its bytes that are left go too. Ids
    play no part.
    """
    return without_repeats(docs, "text").withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed: a row for each piece of a document.

    A null or empty text is one token. Rows with a null or the same id are
    packed like any others, under the id that they have; pieces of one length
    are dealt in the order of their ids. Columns beyond id and text go.
    """
    return packed(docs)


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", simhash_near_dedup), ("suffix-array dedup", suffix_array_dedup), ("best-fit packing", best_fit_packing)]

#: No SQL: n-gram models, XXH64 fingerprints, byte strings and tokenizers are beyond it; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
