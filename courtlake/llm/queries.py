"""The contract's queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake.llm import common as c
from courtlake.llm.embedding_dedup import near_vectors
from courtlake.llm.license_scan import scan_licenses
from courtlake.llm.line_dedup import kept_digest
from courtlake.llm.mixing import mix
from courtlake.llm.ngram_join import ngram_components
from courtlake.llm.packing import pack
from courtlake.llm.quality import score_quality
from courtlake.llm.substring_dedup import substring_dedup
from courtlake.llm.topk_search import top_k
from courtlake.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def _held_out(column: str, folds: int, fold: int):
    return F.coalesce(c.crc32_of(F.col(column)) % folds == fold, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out("doc_id", 4, 2)
    out = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out("doc_id", 5, 0)
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_topk_search": op3_topk_search,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}

#: Filled from courtlake.llm.oracles.
from courtlake.llm.oracles import ORACLES  # noqa: E402,F401
