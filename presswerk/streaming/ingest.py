"""Continuous ingest: landed pages are upserted batch by batch, and event counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswerk.operators.store import Store
from presswerk.sources.ingest import articles_of, extract_text


def landed(spark: SparkSession, path: str, schema: str, *, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def upsert_stream(pages: DataFrame, store: Store, *, checkpoint: str, now: int, available_now: bool = True) -> StreamingQuery:
    """Pages (feed, pos, link, title, published_ts, html) to articles.

    A batch that is run again after a failure changes nothing the second time,
    since the upsert compares content hashes.
    """

    def put(batch: DataFrame, _: int) -> None:
        store.upsert_articles(articles_of(extract_text(batch), now))

    writer = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def once_each(entries: DataFrame, *, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Entries of a stream without repeats of a link within the delay; state is dropped behind the watermark."""
    return entries.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["link"])


def windowed_counts(events: DataFrame, *, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by type and window; late ones count until the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
