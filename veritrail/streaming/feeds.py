"""Feeds as streams: an extension that keeps a corpus and run events up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import hash_content
from ..operators.versioning import latest_by
from ..sources.tables import Store


def sync_corpus(feed: DataFrame, store: Store, checkpoint: str, table: str = "chunks") -> StreamingQuery:
    """Keeps a table of chunks by the feed (chunk_id, text, changed_at); a null text deletes a chunk.

    A batch that is repeated after a failure leaves the same table.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = latest_by(batch.select("chunk_id", "text", "changed_at"), ["chunk_id"], ["changed_at"])
        rows = last.withColumn("hash", hash_content("text"))
        if store.exists(table):
            old = store.read(table)
            newer = rows.join(old.select("chunk_id", F.col("changed_at").alias("known")), "chunk_id", "left").where("known IS NULL OR changed_at >= known").drop("known")
            rows = old.join(newer.select("chunk_id"), "chunk_id", "left_anti").unionByName(newer)
        store.replace(table, rows)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum of values by type and time window; works on streams and on tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
