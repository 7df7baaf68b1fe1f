"""The queries of this subpackage: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, importance, itq, jaccard, langid, mixing, packing, prefixes, quality, simhash, tokens, toxicity, wavelet, wordpiece


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(spark, _table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.withColumn("mix_rate", F.round("mix_rate", 6))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), shingle=4, threshold=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(simhash.compare_neighbours(_table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.links(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the intervals themselves, which depend on the order of digests."""
    return prefixes.prefix_trie(_table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_wavelet_matrix, op2_mix_sources, op3_ngram_jaccard, op4_language_id, op5_simhash, op6_best_fit_packing, op7_quality, op8_toxicity, op9_embedding_dedup, op10_token_counts,
        op11_bpe_transducer, op12_importance_resampling, op13_prefix_trie,
    )
}
ORACLES: dict[str, str] = {"op2_mix_sources": mixing.ORACLE, "op12_importance_resampling": importance.ORACLE, "op13_prefix_trie": prefixes.ORACLE}
