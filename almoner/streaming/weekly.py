"""Weekly sums over a stream of events: what a batch gives, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema, files_each: int = 16) -> DataFrame:
    """Files as they come; each is read once, which the checkpoint remembers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def weekly(stream: DataFrame, unit: str, variable: str, value: str, ts: str = "ts", late: str = "14 days") -> DataFrame:
    """unit, variable, period_start, n, total of weeks from Monday on; later events than `late` are left out.

    Works alike on a batch, where nothing is late.
    """
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", late) if stream.isStreaming else timed
    w = F.window("__ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return timed.groupBy(unit, variable, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(unit, variable, F.col("w.start").cast("date").alias("period_start"), "n", "total")


def first_reports(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "14 days") -> DataFrame:
    """The first of repeated reports within the time that late ones may take."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp"))
    out = timed.withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else timed.dropDuplicates(keys)
    return out.drop("__ts")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
