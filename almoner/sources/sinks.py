"""Where results go: tables, logs, quarantines, dictionaries, manifests."""

from __future__ import annotations

import hashlib
import json
import platform
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def twin(df: DataFrame, path: str) -> None:
    """Parquet, and the same rows as CSV from the written table; nested columns become JSON there."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    back = df.sparkSession.read.parquet(f"{path}.parquet")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in back.dtypes]
    back.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{path}.csv")


def append_log(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("append").option("header", "true").format(kind).save(path)


def quarantine(df: DataFrame, path: str, reason: str) -> None:
    df.withColumns({"reason": F.lit(reason), "quarantined_at": F.current_timestamp()}).write.mode("append").parquet(path)


def dictionary(tables: dict[str, DataFrame], year: str = "year") -> DataFrame:
    """column, tables, null_share (the least), first_year, last_year: one pass over each table."""
    out = None
    for name, df in tables.items():
        years = (F.min(year), F.max(year)) if year in df.columns else (F.lit(None), F.lit(None))
        columns = df.columns
        row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)], years[0].cast("int").alias("first_year"), years[1].cast("int").alias("last_year"))
        long = row.unpivot(["first_year", "last_year"], [f"c{i}" for i in range(len(columns))], "c", "null_share")
        named = long.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("c", 2, 9).cast("int") + 1).alias("column"), F.lit(name).alias("table"), "null_share", "first_year", "last_year")
        out = named if out is None else out.unionByName(named)
    return out.groupBy("column").agg(F.array_sort(F.collect_set("table")).alias("tables"), F.min("null_share").alias("null_share"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))


def availability(variables: DataFrame, downloads: DataFrame) -> DataFrame:
    """source_id, n_variables, blocks, n_files: what sources should give and what they gave."""
    want = variables.groupBy("source_id").agg(F.count("*").alias("n_variables"), F.array_sort(F.collect_set("block")).alias("blocks"))
    have = downloads.groupBy("source_id").agg(F.count("*").alias("n_files"))
    return want.join(have, "source_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0).cast("long")))


def manifest(spark: SparkSession, configs: list[str], outputs: dict[str, int]) -> str:
    """What made a result: versions, hashes of configuration files, rows written."""
    hashes = {p: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in configs}
    return json.dumps({"at": datetime.now(UTC).isoformat(), "spark": spark.version, "python": platform.python_version(), "configs": hashes, "outputs": outputs}, indent=1)
