"""Streams: windows over events with late data, and refreshes of a corpus from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.corpus import upsert


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), "user_id", "n")


def refresh_corpus(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch of changes; the latest change of a key in a batch wins. read gives the corpus, write replaces it for an epoch."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "changed_at").alias("_r")).select(key, "_r.*").drop("changed_at")
        write(upsert(read(), last, key), epoch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
