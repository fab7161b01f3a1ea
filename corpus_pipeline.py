"""The corpus pipeline: low quality out, unknown languages out, copies out, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and
read again as the next one's documents. All but the last return the columns of ``docs``, also
extra ones. The stages hold for every table their operators hold for: null and empty texts, rows
that repeat, and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerband.llm import exact_dedup, langid, packing, quality, simhash
from peerband.llm.queries import table, vocabulary
from peerband.session import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on two thirds of the labelled ids, predicts as 1."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    return quality.keep_quality(docs, quality.train(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is likelier than all others together."""
    return langid.keep_identified(docs, langid.train(docs.where(~langid.held_out())))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of several equal texts: the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints: the one with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, with their sequences and offsets."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), with_ids=False).withColumnRenamed(
        "id", "doc_id"
    )


STAGES = [
    ("quality classifier", good_quality),
    ("language id", known_language),
    ("exact dedup", without_exact_copies),
    ("simhash near-dedup", without_near_copies),
    ("best-fit packing", packed),
]

#: Classifiers, fingerprints and tokenizers are beyond SQL; the tests rebuild the result instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
