"""The corpus pipeline: quality classifier, near-duplicates, personal data,
mixing, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is
written as Parquet and read again as the next stage's documents. All stages
but the last return the columns of their documents; the last returns one row
per document of the mixture with its token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phaselens.llm.bpe import encode_documents
from phaselens.llm.cotrain import keep_good
from phaselens.llm.minhash import NearDup, keep_one
from phaselens.llm.mixing import mixed_rows
from phaselens.llm.pii import mask_documents
from phaselens.llm.queries import documents, labels
from phaselens.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return keep_good(docs, labels(spark, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (similarity 0.8)."""
    return keep_one(docs, params=NearDup(percent=80))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return mask_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture holds it."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the decoded text."""
    return encode_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("PII", masked),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The stages' models and hashes can't be written in SQL; tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
