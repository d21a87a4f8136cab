"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import codes_sql, manifest_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    counted = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    path = public_tokenizers.path
    return pack(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count=True)


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


@_query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def _license_oracle() -> str:
    from .licenses import oracle

    return oracle()


ORACLES["op7_license_scan"] = _license_oracle()


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


@_query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode_texts

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = encode_texts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_bytes=True)
    told = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return found.select("doc_id", "n_tokens", told.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


ORACLES["op12_vector_codes"] = codes_sql()


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import folded, manifest, siblings_digest

    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if k == 3 else f for k, f in enumerate(fields)]
    found = manifest(docs, "doc_id", "lang", fields, changed)
    found = found.withColumn("folded_root", folded(F.col("changed_leaf"), F.col("path"))).withColumn("proof_sha256", siblings_digest(F.col("path")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", verified)


ORACLES["op11_merkle_manifest"] = manifest_sql()


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
