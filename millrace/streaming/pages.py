"""Pages of a crawl as they arrive: new frontier rows with event time, and what each host yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.urls import host
from millrace.operators.frontier import discover
from millrace.sources import state


def first_seen(urls: DataFrame, time: str = "discovered_at", late: str = "1 hour") -> DataFrame:
    """Each URL of a stream once, as long as its repeats come within ``late``; state older than that is dropped."""
    return urls.withWatermark(time, late).dropDuplicatesWithinWatermark(["url"])


def per_host(pages: DataFrame, time: str = "completed_at", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, host, n, failed) of a stream of fetched pages (url, error)."""
    rows = pages.withWatermark(time, late)
    return rows.groupBy(F.window(time, window), host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.count("error").alias("failed"))


def discover_stream(pages: DataFrame, links: Column, base: str, known: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Links of a stream of pages that the Parquet table of URLs at ``known`` lacks are appended to it."""

    def one(batch: DataFrame, number: int) -> None:
        have = state.read_or_empty(batch.sparkSession, known, batch.select("url").schema)
        discover(batch, links, base).join(have, "url", "left_anti").write.mode("append").parquet(known)

    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(**trigger) if trigger else writer).start()
