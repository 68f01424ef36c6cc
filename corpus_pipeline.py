"""The corpus pipeline over the documents table: each stage is written, and read by the next one.

Language ID drops documents without a letter or without a likely language, SimHash keeps one document of each
group of near-duplicates, decontamination drops documents that hold benchmark passages, the secret
scan replaces secrets in the texts, and SentencePiece encodes every text and reads it back. Null
and empty texts, repeated rows, an empty table and further columns are handled as the operators'
modules say. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tableguard.llm import decontaminate, langid, pieces, secrets, simhash
from tableguard.session import shared_folder

#: Least posterior probability of a document's language: likelier than all others together. Of the
#: held-out rows of the test tables none is below; the least has 0.9999.
LEAST = 0.5
#: Vocabulary of the last stage, and share of the merges that it skips.
VOCABULARY, DROPOUT = "piece_bpe_32k.model", 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language scores ``LEAST`` or more; those without a letter have none.

    All documents with a letter stay if no row is labelled, as then there is nothing to predict.
    """
    return langid.keep_known(docs, langid.train(docs, ~langid.held_out()), LEAST)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their pieces; the text is read back from them."""
    import public_tokenizers

    return pieces.with_pieces(docs, public_tokenizers.path(VOCABULARY), DROPOUT)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", encoding),
]
#: SQL has neither the fingerprints nor the classifier nor the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they come out of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
