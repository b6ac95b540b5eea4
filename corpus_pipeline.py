"""A corpus from raw documents to token ids, in five stages of the operators in tessel.llm.

Every stage takes (spark, docs, sf_dir) and reads all that its predecessor kept; all but the last return the columns of
``documents``.  ``n_chars`` follows a text that a stage changes.

Defined results: an empty table gives empty tables throughout.  Null and empty texts are judged like any other text, count as copies of each other,
have no private values and no words, so the mix takes none of them.  Null ids and sources are kept as they are; rows that repeat an id are told
apart by their texts, rows equal in id and text are one document after the second stage.  Extra columns pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import jaccard_prefix, mixing, pii_feistel, sentencepiece_ac, toxicity_cnn
from tessel.llm.util import materialize, table

# SQL has neither the trained filters nor the hashes; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.  Null and empty texts are judged like any other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity_cnn.classify(docs, labels).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: SimHash's links of op7's pivot tables on five-word shingles, and what they miss, verified at a Jaccard similarity of 0.8.

    The document with the smallest id stays, one without id only where none has one; a repeated id with other texts is another document.
    """
    return jaccard_prefix.first_of_each(docs, jaccard_prefix.near_duplicates(docs.select("doc_id", "text")))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become format-preserving pseudonyms, the same in every document."""
    return _counted(pii_feistel.pseudonymise(docs)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each reading of a document, with the words that the reading takes."""
    return _counted(mixing.readings(docs, mixing.mix(docs))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether decoding gives its text back."""
    return sentencepiece_ac.encode(docs).drop("text", "n_chars")


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("pii", private_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
