"""The registered queries of this subpackage, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import clusters, exact_dedup, fingerprints, html_extract, jaccard_join, license_scan, manifest, mixing, piece_codec, quality, sharding, token_counts, toxicity
from tallyweave.llm.textblocks import cut


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where a public tokenizer's file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def simhash_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, other_id, distance: every document whose id is divisible by 20 against all distinct fingerprints, by their least document."""
    docs = _documents(spark, sf_dir)
    prints = cut(docs.select("doc_id", fingerprints.fingerprint(F.col("text")).alias("fp")))
    asked = prints.where("doc_id % 20 = 0")
    entries = prints.groupBy(F.col("fp").alias("entry")).agg(F.min("doc_id").alias("other_id"))
    near = fingerprints.within_radius(prints, asked, 3).join(entries, "entry")
    return asked.join(near, asked["fp"] == near["query"]).select("doc_id", "other_id", "distance")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(_documents(spark, sf_dir), k=4, num=85, den=100)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_digests(_documents(spark, sf_dir), tokenizer_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), tokenizer_path())


def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_proofs(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_html_main_text": op6_html_main_text,
    "op7_simhash": op7_simhash,
    "simhash_radius": simhash_radius,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_counts": op10_token_counts,
    "op11_shards": op11_shards,
    "op12_ball_tree_clusters": op12_ball_tree_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op12_ball_tree_clusters": clusters.SQL, "op13_merkle_manifest": manifest.SQL}
