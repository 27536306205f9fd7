"""Fetched responses as a stream: idempotent inserts, events, and daily counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.state import insert_missing
from ..operators.work import POLLS
from ..schemas import EVENT, schema
from ..sources.feeds import entries, parse_responses
from ..sources.snapshots import Log, Snapshots


#: Newest events that a slow reader is told of; what is older it reads from the tables.
EVENT_DEPTH = 256


def _event(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as events: fields that a kind lacks are null."""
    kept = {c: F.col(c) for c in rows.columns} | {"kind": F.lit(kind)}
    return rows.select(*(kept.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(EVENT)))


def items_new(inserted: DataFrame) -> DataFrame:
    """One event per feed with new items."""
    return _event(inserted.groupBy("feed_id").agg(F.count("*").alias("count")), "items-new")


def feeds_updated(polled: DataFrame, inserted: DataFrame) -> DataFrame:
    """One event per polled feed (feed_id) that brought nothing new, failed ones included."""
    return _event(polled.select("feed_id").distinct().join(inserted, "feed_id", "left_anti"), "feed-updated")


def items_enriched(answers: DataFrame) -> DataFrame:
    """One event per item that the model answered for: id and answer as engine.enriched gives them."""
    told = answers.where("answer is not null").select(F.col("id").alias("item_id"), "answer.*")
    return _event(told.withColumnRenamed("reason", "score_reason") if "reason" in told.columns else told, "item-enriched")


def newest_events(events: DataFrame, depth: int = EVENT_DEPTH) -> DataFrame:
    """What a reader that fell behind is told: the newest events of (batch, ...), the rest is skipped."""
    return events.orderBy(F.desc("batch"), "kind", "feed_id", "item_id").limit(depth)


def patched(items: DataFrame, events: DataFrame) -> DataFrame:
    """items after the item-enriched events (batch, ...), each laid over the item in the order of batches.

    An event carries the item's whole enrichment, as it was stored: what it leaves null is null now, and no tags are an
    empty list.  So the newest one alone decides all four fields."""
    fields = ("summary", "score", "score_reason", "tags")
    told = events.where("kind = 'item-enriched'").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    newest = told.groupBy(F.col("item_id").alias("id")).agg(F.max_by(F.struct(*fields), "batch").alias("told"))
    new = lambda c: F.when(F.col("told").isNull(), F.col(c)).otherwise(F.col(f"told.{c}"))
    return items.join(newest, "id", "left").select(*(new(c).alias(c) if c in fields else F.col(c) for c in items.columns))


def ingest_batch(responses: DataFrame, items: Log, batch_id: int, events: Snapshots | None = None) -> None:
    """Parses a batch of (feed_id, url, body) and adds entries not known yet, by (feed_id, guid).

    Only the fresh rows are written, as the batch's own folder, and only what is known of the batch's feeds is read.  A
    batch run again after a loss looks at the batches before it and writes the same rows.
    """
    feeds = responses.select("feed_id").distinct()
    known = items.read(before=batch_id, keys=feeds)
    items.write(insert_missing(known, entries(parse_responses(responses)), ["feed_id", "guid"], "pos").drop("pos"), batch_id)
    if events is not None:
        added = items.of(batch_id)
        events.write(items_new(added).unionByName(feeds_updated(feeds, added)).withColumn("batch", F.lit(batch_id).cast("long")), batch_id)


def responses_of(spark: SparkSession, path: str, schema_: StructType, batch: int = POLLS) -> DataFrame:
    """A stream of fetched responses, one file each, at most a poll's batch of them at a time."""
    return spark.readStream.schema(schema_).option("maxFilesPerTrigger", batch).parquet(path)


def ingest(responses: DataFrame, items: Log, checkpoint: str, events: Snapshots | None = None, on_batch: Callable[[int], None] | None = None, once: bool = False, tick_s: int = 60):
    """Starts the stream of responses into items; late entries are kept, whatever their date."""

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, items, batch_id, events)
        if on_batch:
            on_batch(batch_id)

    writer = responses.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{tick_s} seconds")).start()


def daily_counts(events: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Events by day and kind; a day closes once the watermark has passed it."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"))
