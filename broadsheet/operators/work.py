"""What workers have to do next: each queue is a query over row state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import feed_titles, recency

MAX_ATTEMPTS = 3
#: Rows of one pass of each worker.
POLLS, EXTRACTIONS, ENRICHMENTS, EMBEDDINGS = 50, 10, 5, 16


def newest(rows: DataFrame, limit: int | None) -> DataFrame:
    """What a reader is about to see comes first."""
    return rows.orderBy(F.desc("recency"), F.desc("id")).limit(limit) if limit else rows


def due_feeds(feeds: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    due = feeds.where(~F.col("disabled") & (F.col("next_fetch_at") <= F.lit(now).cast("timestamp_ntz")))
    return due.orderBy("next_fetch_at", "id").limit(limit) if limit else due


def due_extraction(items: DataFrame, feeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Cut-short items with a url that were not tried too often, and the agent their feed asks for."""
    due = items.where(awaits_extraction())
    return newest(due.join(feeds.select(F.col("id").alias("feed_id"), "user_agent"), "feed_id").select("id", "url", "user_agent", recency().alias("recency")), limit)


def awaits_extraction():
    return F.col("url").isNotNull() & ~F.col("extracted") & F.col("truncated") & (F.col("extract_attempts") < MAX_ATTEMPTS)


def enabled(items: DataFrame, feeds: DataFrame) -> DataFrame:
    return items.join(feeds.where("llm_enabled").select(F.col("id").alias("feed_id")), "feed_id", "left_semi")


def due_embedding(items: DataFrame, feeds: DataFrame, vectors: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Items without a vector of this model whose text is final."""
    have = vectors.select(F.col("item_id").alias("id"), F.col("model").alias("have"))
    due = enabled(items, feeds).where(F.col("embed_attempts") < MAX_ATTEMPTS).where(~awaits_extraction()).join(have, "id", "left")
    return newest(due.where(~F.col("have").eqNullSafe(F.lit(model))).select("id", "have", recency().alias("recency")), limit)


def due_enrichment(items: DataFrame, feeds: DataFrame, profile: str, limit: int | None = None) -> DataFrame:
    """Items never enriched, or scored for another profile; kind says whether the summary can stay."""
    fresh = F.col("enriched_at").isNull()
    has_text = F.coalesce(F.trim("content_text"), F.lit("")) != ""
    due = enabled(items, feeds).where(F.col("enrich_attempts") < MAX_ATTEMPTS).where(~awaits_extraction() | ~fresh)
    due = due.where((fresh & has_text) | (~fresh & ~F.col("scored_profile").eqNullSafe(F.lit(profile))))
    return newest(due.select("id", F.when(fresh, "full").otherwise("rescore").alias("kind"), recency().alias("recency")), limit)


def feed_needing_icon(feeds: DataFrame) -> DataFrame:
    return feeds.where("icon is null and site_url is not null").where(F.col("icon_attempts") < MAX_ATTEMPTS).orderBy("id").limit(1)


def feedback_examples(items: DataFrame, limit: int = 8) -> DataFrame:
    return items.where("feedback <> 0 and title <> ''").orderBy(F.desc("id")).limit(limit)


def feed_inspection(feeds: DataFrame) -> DataFrame:
    """How politely each feed is polled: validators sent, the publisher's interval honoured, a wait asked for."""
    return feeds.join(feed_titles(feeds).withColumnRenamed("feed_id", "id"), "id").select(
        "id",
        "feed_title",
        "interval_s",
        "failures",
        "refusals",
        "disabled",
        (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()).alias("conditional"),
        (F.col("ttl_minutes").isNull() | (F.col("interval_s") >= F.col("ttl_minutes") * 60)).alias("ttl_honoured"),
        F.col("retry_after_s").isNotNull().alias("asked_to_wait"),
    )
