"""The registered queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.audit import filter_audit
from barloom.llm.codes import compressed
from barloom.llm.exact import exact_duplicates
from barloom.llm.language import fit_language, identify
from barloom.llm.lattice import lattice_scores
from barloom.llm.minhash import near_duplicates
from barloom.llm.mixing import mixed_documents
from barloom.llm.packing import packed_documents
from barloom.llm.sharding import extendible_shards
from barloom.llm.signs import near_vectors
from barloom.llm.tokens import token_counts
from barloom.llm.topk import top_k
from barloom.llm.toxicity import fit_toxicity, toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("bucket")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", "places")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(_table(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_exact_dedup, op3_language_id, op4_mixing, op5_topk, op6_sharding, op7_near_dedup, op8_lm_scoring, op9_token_counts, op10_toxicity,
        op11_filter_audit, op12_vector_codes, op13_near_vectors,
    )
}
