"""State transitions: pure functions from a table and its changes to the table's next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schedule import FIRST, later, next_interval
from ..functions.text import clamp

MAX_REFUSALS = 4
MAX_ATTEMPTS = 3
REFUSED = (401, 403, 404, 410)


def first_of_batch(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by partial aggregation: no key's rows are gathered."""
    rest = [c for c in batch.columns if c not in keys]
    kept = batch.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("row"))
    return kept.select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest)).select(batch.columns)


def insert_missing(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of batch that are new; existing rows win, and the first of a batch's equals."""
    return first_of_batch(batch, keys, order).join(table.select(*keys), keys, "left_anti")


def upsert_newest(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with changes' rows in place of its own."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(table.columns))


def fetch_outcome(status: Column, wait: Column) -> Column:
    return (
        F.when(status == 304, "unchanged")
        .when(status.isin(429, 503) & wait.isNotNull(), "retry_after")
        .when(status.isin(*REFUSED), "refused")
        .when((status >= 200) & (status < 300), "fetched")
        .otherwise("failed")
    )


def poll_transition(feeds: DataFrame, polls: DataFrame, now: str, keep_ttl: bool = False) -> DataFrame:
    """Feeds after one poll each.  polls: feed_id, kind (new, unchanged, retry_after, failed, refused), and, where
    they apply, new_title, new_etag, new_last_modified, new_site_url, new_icon_url, new_ttl, wait_s, error; not_modified
    tells a 304 from a fetch without news.

    Validators are those of the last fetch, none if it had none: a stale one would have a publisher answer 304 for news.
    A feed that names no site or icon keeps those it has.  Every poll is remembered by its time.  A 304 forgets the
    publisher's ttl unless keep_ttl; a wait asked for leaves counters and interval alone.
    """
    polls = polls.select("*", *(F.lit(None).cast("string").alias(c) for c in ("new_last_modified", "new_site_url", "new_icon_url") if c not in polls.columns))
    at = F.lit(now).cast("timestamp_ntz")
    kind, bad = F.col("kind"), F.col("kind").isin("failed", "refused")
    fetched = kind.isin("new", "unchanged") & ~F.col("not_modified")
    failures = F.when(bad, F.col("failures") + 1).when(kind == "retry_after", F.col("failures")).otherwise(0)
    refusals = F.when(kind == "refused", F.col("refusals") + 1).when(kind == "retry_after", F.col("refusals")).otherwise(0)
    result = F.when(bad, "failed").otherwise(kind)
    floor = F.when(fetched, F.col("new_ttl")).when(bad | F.lit(keep_ttl), F.col("ttl_minutes"))
    interval = F.when(kind == "retry_after", F.col("interval_s")).otherwise(next_interval(F.col("interval_s"), result, failures, floor))
    wait = F.when(kind == "retry_after", F.col("wait_s")).otherwise(interval)
    after = {
        "title": F.when(fetched, F.coalesce(F.nullif("new_title", F.lit("")), "title")).otherwise(F.col("title")),
        "site_url": F.when(fetched, F.coalesce("new_site_url", "site_url")).otherwise(F.col("site_url")),
        "icon_url": F.when(fetched, F.coalesce("new_icon_url", "icon_url")).otherwise(F.col("icon_url")),
        "etag": F.when(fetched, F.col("new_etag")).otherwise(F.col("etag")),
        "last_modified": F.when(fetched, F.col("new_last_modified")).otherwise(F.col("last_modified")),
        "last_fetch_at": at,
        "next_fetch_at": later(at, wait),
        "interval_s": interval,
        "failures": failures.cast("int"),
        "refusals": refusals.cast("int"),
        "disabled": F.when((kind == "refused") & (F.col("refusals") + 1 >= MAX_REFUSALS), F.lit(True)).otherwise(F.col("disabled")),
        "retry_after_s": F.when(kind == "retry_after", F.col("wait_s")).when(fetched, F.lit(None)).otherwise(F.col("retry_after_s")).cast("long"),
        "ttl_minutes": F.when(fetched, F.col("new_ttl")).otherwise(F.col("ttl_minutes")).cast("int"),
        "last_error": F.when(bad, F.col("error")).when(kind == "retry_after", F.col("last_error")).otherwise(F.lit(None)).cast("string"),
    }
    joined = feeds.join(polls.withColumnRenamed("feed_id", "id"), "id", "left")
    touched = {c: F.when(F.col("kind").isNull(), F.col(c)).otherwise(v).alias(c) for c, v in after.items()}
    return joined.select(*(touched.get(c, F.col(c)) for c in feeds.columns))


def patch_feeds(feeds: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """patches: feed_id and set_title, set_agent, set_disabled, set_llm, each null where it stays.  Empty titles and
    agents become null; enabling a feed clears its counters and makes it due."""
    on = F.col("set_disabled").eqNullSafe(F.lit(False))
    after = {
        "custom_title": F.when(F.col("set_title").isNotNull(), F.nullif("set_title", F.lit(""))).otherwise(F.col("custom_title")),
        "user_agent": F.when(F.col("set_agent").isNotNull(), F.nullif(F.trim("set_agent"), F.lit(""))).otherwise(F.col("user_agent")),
        "disabled": F.coalesce("set_disabled", "disabled"),
        "llm_enabled": F.coalesce("set_llm", "llm_enabled"),
        "failures": F.when(on, F.lit(0)).otherwise(F.col("failures")).cast("int"),
        "refusals": F.when(on, F.lit(0)).otherwise(F.col("refusals")).cast("int"),
        "next_fetch_at": F.when(on, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("next_fetch_at")),
    }
    joined = feeds.join(patches.withColumnRenamed("feed_id", "id"), "id", "left")
    return joined.select(*(after[c].alias(c) if c in after else F.col(c) for c in feeds.columns))


def agent_changed(items: DataFrame, feed_ids: DataFrame) -> DataFrame:
    """Items not yet extracted of feeds with a new agent (feed_id, each once) may be tried again."""
    hit = items.join(feed_ids.select("feed_id", F.lit(True).alias("hit")), "feed_id", "left")
    again = F.coalesce(F.col("hit") & ~F.coalesce("extracted", F.lit(False)), F.lit(False))
    after = {"extract_attempts": F.when(again, 0).otherwise(F.col("extract_attempts")), "extract_error": F.when(~again, F.col("extract_error"))}
    return hit.withColumns(after).select(items.columns)


def patch_with_items(feeds: DataFrame, items: DataFrame, patches: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """feeds and items after patch_feeds: an agent that is set, even to none, is the one change that can make a refused
    page readable, so it gives its feed's items their attempts back."""
    return patch_feeds(feeds, patches, now), agent_changed(items, patches.where("set_agent is not null").select("feed_id").distinct())


def patch_items(items: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """patches: id and set_read, set_starred, set_feedback, null where it stays.  The first time stays; clearing gives null."""
    at = F.lit(now).cast("timestamp_ntz")
    stamp = lambda flag, old: F.when(F.col(flag).isNull(), F.col(old)).when(F.col(flag), F.coalesce(F.col(old), at))
    after = {
        "read_at": stamp("set_read", "read_at"),
        "starred_at": stamp("set_starred", "starred_at"),
        "feedback": F.coalesce(clamp(F.col("set_feedback"), -1, 1), "feedback").cast("int"),
    }
    return items.join(patches, "id", "left").select(*(after[c].alias(c) if c in after else F.col(c) for c in items.columns))


def mark_read(items: DataFrame, scope: Column, now: str) -> DataFrame:
    """Unread items in scope, and the whole clusters of those, are read now; others keep their time."""
    hit = items.where(F.col("read_at").isNull() & scope)
    clusters = hit.where("cluster_id is not null").select("cluster_id").distinct().withColumn("in_cluster", F.lit(True))
    joined = items.join(clusters, "cluster_id", "left")
    marked = F.col("read_at").isNull() & (F.coalesce(scope, F.lit(False)) | F.col("in_cluster").isNotNull())
    return joined.withColumn("read_at", F.when(marked, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("read_at"))).select(items.columns)


def attempts_after(attempts: Column, outcome: Column) -> Column:
    """ok resets, refused goes to the end, an unreachable host costs nothing, anything else costs one."""
    return (
        F.when(outcome == "ok", 0)
        .when(outcome == "refused", F.greatest(attempts + 1, F.lit(MAX_ATTEMPTS)))
        .when(outcome == "unreachable", attempts)
        .otherwise(attempts + 1)
        .cast("int")
    )


def delete_feeds(gone: DataFrame, feeds: DataFrame, items: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of feeds, items and vectors."""
    dead = items.join(gone, "feed_id", "left_semi").select(F.col("id").alias("item_id"))
    return (
        feeds.join(gone.withColumnRenamed("feed_id", "id"), "id", "left_anti"),
        items.join(gone, "feed_id", "left_anti"),
        vectors.join(dead, "item_id", "left_anti"),
    )


#: Messages, in any case, of a model that could not be reached; they say nothing about the item.
UNREACHED = ("error sending request%", "%operation timed out%")


def repair_attempts(items: DataFrame) -> DataFrame:
    """Enrichment's and embedding's attempts that an unreachable model cost are given back, each by its own error.
    Extraction's stay: what a publisher answered it said about the page."""
    after = {}
    for work in ("enrich", "embed"):
        attempts, error = F.col(f"{work}_attempts"), F.col(f"{work}_error")
        unreached = F.ilike(error, F.lit(UNREACHED[0])) | F.ilike(error, F.lit(UNREACHED[1]))
        hit = F.coalesce((attempts > 0) & unreached, F.lit(False))
        after[f"{work}_attempts"] = F.when(hit, 0).otherwise(attempts)
        after[f"{work}_error"] = F.when(~hit, error)
    return items.withColumns(after)


def repair_icons(feeds: DataFrame) -> DataFrame:
    """An icon that is no data: URI is a url to fetch, not an icon."""
    url = F.col("icon").isNotNull() & ~F.ilike(F.col("icon"), F.lit("data:%"))
    return feeds.withColumn("icon_url", F.when(url, F.col("icon")).otherwise(F.col("icon_url"))).withColumn("icon", F.when(~url, F.col("icon")))


#: Version of the stored tables; icons stored before version 2 were chosen by another ranking.
VERSION = 2


def repair_stored(feeds: DataFrame, items: DataFrame, version: int) -> tuple[DataFrame, DataFrame, int]:
    """feeds and items as this version stores them, and its number; running it again changes nothing.  Icons of before
    version 2 are all fetched again, once, for nothing in a row tells a good one from a banner."""
    feeds = repair_icons(feeds)
    if version < 2:
        feeds = feeds.withColumns({"icon": F.lit(None).cast("string"), "icon_attempts": F.lit(0)})
    return feeds, repair_attempts(items), max(version, VERSION)


def host_refusals(tries: DataFrame, most: int = 3) -> DataFrame:
    """tries: host, agent, day, event_id, refused, succeeded.  Which tries a pass would have left out: those after a host
    refused an agent `most` times since that one's last success that day.  A host that refused one agent has said
    nothing of another.  A pass is a day, so no window outgrows one."""
    key = ["host", "agent", "day"]
    by_host = Window.partitionBy(*key).orderBy("event_id")
    streaks = tries.withColumn("streak", F.sum(F.col("succeeded").cast("int")).over(by_host.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy(*key, "streak").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = streaks.withColumn("refusals", F.sum(F.col("refused").cast("int")).over(since))
    trip = F.min(F.when(F.col("refusals") >= most, F.col("event_id"))).over(Window.partitionBy(*key))
    return counted.withColumn("trip", trip).withColumn("retired", F.coalesce(F.col("event_id") > F.col("trip"), F.lit(False))).drop("streak", "trip")


def paced(tries: DataFrame, gap_s: float = 1.0) -> DataFrame:
    """tries: host, day, event_id, asked_at (seconds).  When each may start, so that starts at one host lie `gap_s` apart:
    start(k) is the largest of asked(j) + (k - j) * gap over the tries j up to k."""
    by_host = Window.partitionBy("host", "day").orderBy("asked_at", "event_id")
    turn = (F.row_number().over(by_host) * F.lit(gap_s)).alias("turn")
    turns = tries.select("*", turn)
    earliest = F.max(F.col("asked_at") - F.col("turn")).over(by_host.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("start_at", earliest + F.col("turn")).drop("turn")


def insert_feeds(feeds: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """feeds and those of asked (pos, url, title, site_url) whose url is new, the first of equals: due now, with the usual
    interval, numbered on from the largest id in the order of pos."""
    fresh = insert_missing(feeds, asked, ["url"], "pos")
    top = feeds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    order = Window.orderBy("pos")
    known = {
        "id": (F.col("top") + F.row_number().over(order)).cast("long"),
        "url": F.col("url"),
        "title": F.col("title"),
        "site_url": F.col("site_url"),
        "next_fetch_at": F.lit(now).cast("timestamp_ntz"),
        "interval_s": F.lit(FIRST),
        "disabled": F.lit(False),
        "llm_enabled": F.lit(True),
        **{c: F.lit(0) for c in ("failures", "refusals", "icon_attempts")},
    }
    # A subscription list is what one reader has; numbering it takes one task.
    rows = fresh.join(F.broadcast(top)).select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in feeds.schema))
    return feeds.unionByName(rows)


def record_vectors(items: DataFrame, vectors: DataFrame, found: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """items and vectors after a pass of the embedder: found holds item_id, model, embedding (null: failed) and, for
    failures, whether the model could not be reached, which costs an item nothing."""
    good = found.where("embedding is not null").withColumn("dims", F.size("embedding")).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    fresh = good.select(*(good[c] if c in good.columns else F.lit(None).alias(c) for c in vectors.columns))
    outcome = F.when(F.col("embedding").isNotNull(), "ok").when(F.col("unreachable"), "unreachable").otherwise("failed")
    tried = found.select(F.col("item_id").alias("id"), outcome.alias("outcome"))
    after = F.when(F.col("outcome").isNull(), F.col("embed_attempts")).otherwise(attempts_after(F.col("embed_attempts"), F.col("outcome")))
    return items.join(tried, "id", "left").withColumn("embed_attempts", after).select(items.columns), upsert_newest(vectors, fresh, "item_id")
