"""The corpus pipeline: five stages over documents, each one's rows the next one's documents.

Toxic documents go, then exact copies, then near copies; the rest is mixed to its sources' target weights, and encoded.
Every stage works on all rows of the one before. Each stage handles nulls, empty texts, repeated rows, empty tables and
columns with other names as its operator says; all but the last keep the columns that they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrolith.llm import exact_dedup, mixing, sentencepiece_bpe, simhash, toxicity
from ferrolith.llm.common import remove_path, scratch_folder, scratch_path, write_table
from ferrolith.llm.queries import piece_model, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the toxicity threshold; the model is fitted on the labelled ones among docs."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest doc_id.

    SimHash fingerprints find pairs first, and each is compared by its shingles; lists of minima find the pairs whose fingerprints are further apart.
    """
    return simhash.one_of_each_similar(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return sentencepiece_bpe.encode_documents(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity scores, fingerprints and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table and scratch are removed once the next one's table is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_folder(spark, name):
            docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
