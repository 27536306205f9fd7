"""One schema per table of the archive."""

from __future__ import annotations

from pyspark.sql.types import StructType

FOLDERS = "id long, title string, position int"
FEEDS = (
    "id long, url string, site_url string, title string, custom_title string, folder_id long, icon string, icon_url string, icon_attempts int,"
    " etag string, last_modified string, last_fetch_at timestamp_ntz, next_fetch_at timestamp_ntz, interval_s long, failures int, refusals int,"
    " retry_after_s long, ttl_minutes int, last_error string, disabled boolean, llm_enabled boolean, user_agent string, created_at timestamp_ntz"
)
ITEMS = (
    "id long, feed_id long, guid string, url string, comments_url string, title string, author string, published_at timestamp_ntz,"
    " fetched_at timestamp_ntz, content_html string, content_text string, truncated boolean, extracted boolean, extract_attempts int,"
    " extract_error string, summary string, score long, score_reason string, tags array<string>, enriched_at timestamp_ntz, enrich_model string,"
    " enrich_attempts int, enrich_error string, scored_profile string, cluster_id long, read_at timestamp_ntz, starred_at timestamp_ntz,"
    " feedback int, embed_attempts int, embed_error string"
)
EMBEDDINGS = "item_id long, model string, dims int, embedding array<float>, created_at timestamp_ntz"
DIGEST_CONTENT = "struct<intro:string,threads:array<struct<title:string,note:string,item_ids:array<bigint>>>>"
DIGESTS = f"day date, content {DIGEST_CONTENT}, model string, item_count int, created_at timestamp_ntz"
SETTINGS = "key string, value string"
EVENT = "kind string, feed_id long, count long, item_id long, summary string, score long, score_reason string, tags array<string>"
PARSED_ITEM = (
    "guid string, url string, comments_url string, title string, author string, published_at timestamp, content_html string,"
    " content_text string, truncated boolean"
)
#: What an enricher answers, as from_json reads it.
ENRICH_ANSWER = "struct<summary:string,tags:array<string>,score:int,reason:string>"
SCORE_ANSWER = "struct<score:int,reason:string>"
SUMMARY_ANSWER = "struct<summary:string,tags:array<string>>"


def schema(text: str) -> StructType:
    return StructType.fromDDL(text)
