"""Collecting files as they arrive: each once, whatever happens, with bad ones told of and none of the others stopped.

Files come as a stream of contents. A batch leaves out what the registry has, by address and SHA-256, parses the rest in
tasks, and writes for its number: the rows, a registry row for each file, the errors, and the drift of columns. A batch
that runs again, after a lost driver or executor, writes its folders anew; tables are what all batches have written. A
file whose columns are not those that its source had last is told of once: the source's last columns are kept in the
registry, which the next batch reads.

A parser gets a path and bytes and returns rows as dictionaries of texts. What it raises becomes the file's error. Files of
no bytes at all are left out by Spark's file source.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tabular import keep_latest, to_fetch

Parser = Callable[[str, bytes], list[dict[str, str]]]

PARSED = "url string, sha256 string, source string, line int, row map<string,string>, columns array<string>, error string"
TABLES = {
    "rows": "batch long, url string, sha256 string, source string, line int, row map<string,string>",
    "registry": "batch long, url string, sha256 string, source string, status string, n_rows long, columns array<string>, seen_at timestamp",
    "errors": "batch long, url string, sha256 string, source string, error string",
    "drift": "batch long, url string, source string, added array<string>, removed array<string>",
}


def contents(spark: SparkSession, folder: str, files_each: int = 64, pattern: str = "*") -> DataFrame:
    """url, content, modificationTime of files as they come; what they are named and which a checkpoint has seen doesn't matter to the registry."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each).load(folder)
    return raw.select(F.col("path").alias("url"), "content", "modificationTime")


def parsed(files: DataFrame, parser: Parser) -> DataFrame:
    """A row for each row of each file (url, sha256, source, content); a file without rows, or that fails, has one with line -1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for url, sha, source, content in zip(f["url"], f["sha256"], f["source"], f["content"], strict=True):
                columns: list[str] = []
                rows, error = [], None
                try:
                    rows = [{str(k): None if v is None else str(v) for k, v in r.items()} for r in parser(url, bytes(content))]
                    columns = sorted({k for r in rows for k in r})
                except Exception as e:  # noqa: BLE001 - a bad file must not stop the others
                    rows, error = [], f"{type(e).__name__}: {e}"[:500]
                told = rows or [None]
                yield pd.DataFrame({"url": url, "sha256": sha, "source": source, "line": range(len(rows)) if rows else [-1], "row": told, "columns": [columns] * len(told), "error": error})

    return files.select("url", "sha256", "source", "content").mapInPandas(run, PARSED)


def read(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of a store: what all its batches have written."""
    path = f"{store}/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(TABLES[name]).parquet(path) if there else spark.createDataFrame([], TABLES[name])


def _before(spark: SparkSession, store: str, name: str, batch: int) -> DataFrame:
    """What other batches have written: a batch that runs again doesn't see its first try."""
    return read(spark, store, name).where(F.col("batch") != batch)


def keep(files: DataFrame, batch: int, store: str, parser: Parser, source: Column) -> None:
    """Writes what a batch of files (url, content, modificationTime) adds to a store's tables."""
    spark = files.sparkSession
    named = files.select("url", F.sha2("content", 256).alias("sha256"), source.alias("source"), "content", "modificationTime")
    registry = _before(spark, store, "registry", batch)
    # one file of each address and content, however often the batch holds it
    new = to_fetch(named, registry).dropDuplicates(["url", "sha256"])
    _write(parsed(new, parser).withColumn("batch", F.lit(batch).cast("long")), f"{store}/parsed", batch, spark)
    rows = spark.read.schema(f"batch long, {PARSED}").parquet(f"{store}/parsed").where(F.col("batch") == batch)
    _write(rows.where("line >= 0").select("batch", "url", "sha256", "source", "line", "row"), f"{store}/rows", batch, spark)
    _write(rows.where("error IS NOT NULL").select("batch", "url", "sha256", "source", "error"), f"{store}/errors", batch, spark)
    told = rows.groupBy("batch", "url", "sha256", "source").agg(F.when(F.max("error").isNotNull(), "failed").otherwise("ok").alias("status"), F.count_if(F.col("line") >= 0).alias("n_rows"), F.max("columns").alias("columns"))
    seen = told.join(new.select("url", "sha256", "modificationTime"), ["url", "sha256"])
    _write(_drifted(seen, registry), f"{store}/drift", batch, spark)
    _write(seen.select("batch", "url", "sha256", "source", "status", "n_rows", "columns", F.col("modificationTime").alias("seen_at")), f"{store}/registry", batch, spark)


def _drifted(seen: DataFrame, registry: DataFrame) -> DataFrame:
    """batch, url, source, added, removed: files whose columns differ from those of the source's file before, the first in time against what the registry knows."""
    good = seen.where("status = 'ok' AND size(columns) > 0")
    last = registry.where("status = 'ok' AND size(columns) > 0").groupBy("source").agg(F.max_by("columns", F.struct("seen_at", "url")).alias("known"))
    order = W.partitionBy("source").orderBy("modificationTime", "url")  # the files of one source in one batch, whose number is bounded
    with_before = good.withColumn("earlier", F.lag("columns").over(order)).join(last, "source", "left").withColumn("was", F.coalesce("earlier", "known"))
    moved = with_before.where(F.col("was").isNotNull() & (F.col("was") != F.col("columns")))
    return moved.select("batch", "url", "source", F.array_except("columns", "was").alias("added"), F.array_except("was", "columns").alias("removed"))


def _write(df: DataFrame, path: str, batch: int, spark: SparkSession) -> None:
    """df in place of what this batch has written before, and of nothing else."""
    df.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def collect(spark: SparkSession, folder: str, store: str, parser: Parser, source: Column | None = None, files_each: int = 64, pattern: str = "*"):
    """Takes all files that are there, in batches, and ends; returns the query. source: a column over url; the folder of a file, if not given."""
    of = source if source is not None else F.element_at(F.split("url", "/"), -2)
    stream = contents(spark, folder, files_each, pattern)
    query = stream.writeStream.foreachBatch(lambda df, batch: keep(df, batch, store, parser, of)).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, store: str) -> DataFrame:
    """The registry's last row of each address."""
    return keep_latest(read(spark, store, "registry"), ["url"], "seen_at")


def json_lines(url: str, content: bytes) -> list[dict[str, str]]:
    """A parser of JSON, a document a line."""
    return [json.loads(line) for line in content.decode("utf-8").splitlines() if line.strip()]


def fingerprint(columns: list[str]) -> str:
    return hashlib.sha256(json.dumps(columns).encode()).hexdigest()
