"""The thin ``opN_*`` queries: each applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.sharding import shard_documents

    return shard_documents(documents(spark, sf_dir), shards=40)


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.cotrain import score_quality

    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.pii import find_pii

    return find_pii(documents(spark, sf_dir))


def op5_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.mixing import mix_documents

    return mix_documents(documents(spark, sf_dir))


def op6_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.minhash import NearDup, near_duplicates

    return near_duplicates(documents(spark, sf_dir), params=NearDup(percent=85))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.merkle import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.compression import score_documents

    return score_documents(documents(spark, sf_dir))


def op9_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.bpe import encode_documents

    return encode_documents(documents(spark, sf_dir), with_ids=False)


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.whitening import whiten

    return whiten(embeddings(spark, sf_dir))


def op12_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.collocations import collocations

    return collocations(documents(spark, sf_dir))


def op13_block_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaselens.llm.topk import search

    return search(embeddings(spark, sf_dir))


_QUERIES = (op1_counterfactual_toxicity, op2_hypergeometric_shards, op3_cotraining_quality, op4_crf_pii,
            op5_hierarchical_mix, op6_minhash_odd_sketch, op7_merkle_fingerprints, op8_compression_bands,
            op9_license_sentences, op10_byte_bpe, op11_chebyshev_whitening, op12_trie_collocations,
            op13_block_pruned_topk)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from phaselens.llm import collocations, mixing, topk

    return {"op5_hierarchical_mix": mixing.ORACLE_SQL, "op12_trie_collocations": collocations.ORACLE_SQL,
            "op13_block_pruned_topk": topk.ORACLE_SQL}
