"""From raw documents to packed training sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almoner.llm import _common as c
from almoner.llm import decontam, langid, near_dup, packing, secrets
from almoner.llm.queries import word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a text without words goes."""
    found = langid.identify(docs, langid.document_evidence(docs), langid.fit(docs))
    return found.where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with its least id (null is the largest); texts without words are one class."""
    return near_dup.one_of_each(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a word in twenty stands in a benchmark window; equal texts share a decision, whatever their ids."""
    own = F.xxhash64("text")
    found = decontam.hits(docs.select(own.alias("text_hash"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=13, id_col="text_hash")
    bad = found.where(decontam.contaminated()).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, own == F.col("__bad"), "left_anti").select(*COLUMNS)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they are packed into."""
    parts = c.stored(packing.pieces(docs, word_tokenizer()), "pieces")
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("secrets", masked), ("packing", packed)]

#: Not SQL: word models, sketches and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{c.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
