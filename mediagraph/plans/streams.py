"""Queries of streams: the events arrive in three parts, partly late, and the streams are started anew from their checkpoints for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediagraph.operators.graph import saved, scratch_path
from mediagraph.plans.registry import query, table
from mediagraph.sources import ingest as I
from mediagraph.streaming import manifests as M

#: Rows come up to ten days late.
LATE = "12 days"


def replayed(s: SparkSession, d: str, start: Callable[[DataFrame, str], StreamingQuery]) -> StreamingQuery:
    """The last of three runs of a stream over all events: a part of their time each, and of a part's last ten days a third only with
    the next one."""
    events = saved(table(s, d, "events").withColumn("day", F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400), "events")
    first, last = events.agg(F.min("day"), F.max("day")).first()
    delayed = F.col("day") + F.when(F.col("event_id") % 3 == 0, 10).otherwise(0)
    part = F.least(F.lit(2), F.floor((delayed - first) / max((last - first) / 3, 1)).cast("int"))
    source, checkpoint = scratch_path(s, "arrivals"), scratch_path(s, "checkpoint")
    for k in range(3):
        arrived = events.withColumn("part", part).filter(F.col("part") == k).drop("part", "day")
        arrived.write.mode("append").parquet(source)
        run = start(s.readStream.schema(arrived.schema).parquet(source), checkpoint)
        run.awaitTermination()
    return run


@query("t1_latest_manifest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def t1(s, d):
    """The latest event of each user, kept as versions of a manifest."""
    folder = scratch_path(s, "manifest")
    seen = lambda e: e.select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("seen"))
    last = replayed(s, d, lambda e, checkpoint: M.manifest_versions(seen(e), folder, "user_id", "seen", checkpoint))
    return M.latest_manifest(s, last, folder).select("user_id", "event_id", "value")


@query("t2_first_arrivals", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def t2(s, d):
    """One row for each user, kind and day, without state for days that the watermark has passed."""
    folder = scratch_path(s, "firsts")

    def start(events: DataFrame, checkpoint: str) -> StreamingQuery:
        at = F.col("ts").cast("timestamp")
        keyed = events.select("user_id", "event_type", at.cast("date").alias("day"), at.alias("ts")).withColumn("k", F.concat_ws("|", "user_id", "event_type", "day"))
        return M.kept_rows(M.first_arrivals(keyed, "k", "ts", LATE), folder, checkpoint)

    replayed(s, d, start)
    return s.read.parquet(folder).select("user_id", "event_type", "day")


@query("t3_windowed_counts", "SELECT CAST(w AS TIMESTAMP) AS start, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY w")
def t3(s, d):
    """Events of two days, in windows that begin every day; late rows count."""
    folder = scratch_path(s, "windows")

    def start(events: DataFrame, checkpoint: str) -> StreamingQuery:
        counted = M.windowed_frames(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "2 days", "1 day", LATE)
        return M.manifest_versions(counted.select(F.col("window.start").alias("start"), "n", "mean"), folder, "start", "n", checkpoint, mode="update")

    last = replayed(s, d, start)
    return M.latest_manifest(s, last, folder).select("start", "n", F.round("mean", 4).alias("mean"))


@query("s1_media_listing", "SELECT doc_id % 40 AS shelf, '.txt' AS extension, CAST(sum(strlen(text) + 1) AS BIGINT) AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def s1(s, d):
    """Files of two kinds in folders; of one kind all are listed, with their sizes, without reading them."""
    root = scratch_path(s, "shelves")
    t = table(s, d, "documents").filter("text is not null").select((F.col("doc_id") % 40).alias("shelf"), "text").repartition("shelf")
    t.write.partitionBy("shelf").text(f"{root}/texts")
    t.select("shelf", F.length("text").alias("n")).write.partitionBy("shelf").json(f"{root}/others")
    return I.media_files(s, root, (".txt",)).select(F.regexp_extract("path", r"shelf=([0-9]+)/", 1).cast("long").alias("shelf"), "extension", "size_bytes")
