"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from . import bpe, decontam, langid, near_dup, packing, quality, resample, secrets, sharding, tokenbin, topk, toxicity, whiten


SHARD_BYTES = 1 << 18


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=13))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, each with their own evidence; doc_id or page_id is set."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = langid.fit(docs)
    a = langid.identify(docs, langid.document_evidence(docs), model, keep=["doc_id"])
    b = langid.identify(pages, langid.page_evidence(model[0]), model, text_col="html", keep=["page_id"], html=True)
    return a.unionByName(b, allowMissingColumns=True).select("doc_id", "page_id", "lang_id", "confidence", "accepted")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0, k=10, scale=1024.0)


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small shards, such as a streaming loader reads whole, so that even the smallest tables are split."""
    return sharding.shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = c.crc_bucket("doc_id", 5) == 0
    model = toxicity.train(toxicity.sample(docs, labels, "toxic", ~held_out, toxicity.TRAIN_ROWS, toxicity.TRAIN_BYTES))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{c.shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    manifest = tokenbin.write(_table(spark, sf_dir, "documents"), folder, word_tokenizer())
    return tokenbin.read(spark, folder, manifest)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = c.crc_bucket("doc_id", 3) == 1
    model, share = quality.train(toxicity.sample(docs, labels, "quality", ~held_out, quality.TRAIN_ROWS, quality.TRAIN_BYTES))
    scored = quality.score(docs, model, share, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size(F.filter("line_good", lambda p: p < 0.5)).alias("n_bad_lines"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = c.stored(packing.pieces(_table(spark, sf_dir, "documents"), word_tokenizer()), "pieces")
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "n_bins", "bound")


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(_table(spark, sf_dir, "embeddings"), k=32, scale=64.0, shift=1_000_000)


def op12_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), byte_tokenizer(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_secret_scan, op3_language, op4_exact_top_k, op5_extendible_sharding, op6_toxicity, op7_token_binary, op8_line_quality, op9_order_minhash, op10_best_fit_packing, op11_lobpcg_whitening, op12_bpe_pair_index, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.oracle_sql(), "op4_exact_top_k": topk.ORACLE_SQL, "op5_extendible_sharding": sharding.oracle_sql(SHARD_BYTES), "op13_importance_resampling": resample.oracle_sql()}
