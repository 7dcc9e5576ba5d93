"""Streams of file arrivals: exact-copy removal, windowed counts, and upserts of the cache manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediagraph.operators.cache import upserted


def first_arrivals(stream: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_frames(stream: DataFrame, at: str, value: str, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Count and mean of each window of event time; late rows within the watermark are taken in."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def manifest_versions(stream: DataFrame, folder: str, key: str, at: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keeps a manifest under folder: each batch writes a new version next to the old one. mode: append for rows as they come, update for
    results of an aggregation that are replaced by later ones.

    A batch that is run again writes its own version again, so the manifest is the same.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{folder}/v{epoch - 1}") if epoch else batch.limit(0)
        upserted(old, batch, key, at).write.mode("overwrite").parquet(f"{folder}/v{epoch}")

    return stream.writeStream.outputMode(mode).foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_manifest(spark: SparkSession, query: StreamingQuery, folder: str) -> DataFrame:
    """The manifest after the query's last batch."""
    epoch = query.lastProgress["batchId"]
    return spark.read.parquet(f"{folder}/v{epoch}")


def kept_rows(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of a stream to Parquet files, each batch once, also when it is run again."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
