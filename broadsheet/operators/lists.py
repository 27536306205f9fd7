"""Lists of items: views, filters, search, keyset pages, and what is counted beside them."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .search import StoredIndex, found_ids

#: Page sizes: shortest, usual and longest.
PAGE = (1, 50, 200)


def recency(published: str = "published_at", fetched: str = "fetched_at") -> Column:
    return F.coalesce(published, fetched)


def page_size(asked: int | None) -> int:
    return max(PAGE[0], min(PAGE[2], PAGE[1] if asked is None else asked))


def feed_titles(feeds: DataFrame) -> DataFrame:
    return feeds.select(F.col("id").alias("feed_id"), T.shown_title(F.col("custom_title"), F.col("title"), F.col("url")).alias("feed_title"))


def cluster_sizes(items: DataFrame) -> DataFrame:
    """All members count, read ones too, so sizes come before any filter."""
    return items.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))


def is_head() -> Column:
    return F.col("cluster_id").isNull() | (F.col("cluster_id") == F.col("id"))


def in_view(view: str, threshold: int) -> Column:
    """starred, all, interesting (unread and scored from the threshold on); anything else is unread."""
    unread = F.col("read_at").isNull()
    return {"starred": F.col("starred_at").isNotNull(), "all": F.lit(True), "interesting": unread & (F.col("score") >= threshold)}.get(view, unread)


def search_terms(query: str | None) -> list[str] | None:
    """None without a query; else its words, folded, the last one a prefix.  A query without words gives [], which matches nothing."""
    if query is None or not query.strip():
        return None
    return [w for w in re.split(r"[\W_]+", T.fold(query)) if w]


def matches(terms: list[str], title: Column, body: Column) -> Column:
    """Whether each term is a word of the title or body, the last one the start of a word."""
    if not terms:
        return F.lit(False)
    words = F.concat(T.tokens(title), T.tokens(body))
    out = F.exists(words, lambda w: w.startswith(terms[-1]))
    for term in terms[:-1]:
        out = out & F.array_contains(words, term)
    return out


def parse_cursor(cursor: str | None) -> tuple[datetime, int] | None:
    """A cursor is a time and an id; a malformed one is none, so the first page comes."""
    try:
        when, number = (cursor or "").split("|")
        return datetime.fromisoformat(when.replace("Z", "+00:00")).replace(tzinfo=None), int(number)
    except ValueError:
        return None


def make_cursor(when: datetime, number: int) -> str:
    """Parts of a second are kept where there are any, so that no row between two pages is skipped."""
    part = f".{when.microsecond:06d}" if when.microsecond else ""
    return f"{when:%Y-%m-%dT%H:%M:%S}{part}Z|{number}"


def list_items(
    items: DataFrame,
    feeds: DataFrame,
    view: str = "unread",
    feed_id: int | None = None,
    tag: str | None = None,
    query: str | None = None,
    cursor: str | None = None,
    limit: int | None = None,
    threshold: int = 65,
    index: DataFrame | StoredIndex | None = None,
) -> DataFrame:
    """Items of a view with their feed's title and cluster's size; a page of `limit` rows comes newest first
    (interesting: best first), all rows in any order.

    A search looks through the whole archive: the view is ignored and clusters aren't collapsed.  With an index (see
    operators.search) it reads the postings of its words and no text.  The cursor is the last row of the page before;
    the interesting view has none.
    """
    terms = search_terms(query)
    view = view if terms is None else "all"
    rows = items
    if feed_id is not None:
        rows = rows.where(F.col("feed_id") == feed_id)
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if terms is None:
        rows = rows.where(in_view(view, threshold) & is_head())
    elif index is None:
        rows = rows.where(matches(terms, F.col("title"), F.col("content_text")))
    else:
        rows = rows.join(index.ids(terms) if isinstance(index, StoredIndex) else found_ids(index, terms), "id", "left_semi")
    at = parse_cursor(cursor) if view != "interesting" else None
    rows = rows.withColumn("recency", recency())
    if at:
        # The first condition says no more than the second, but reaches the scan's statistics.
        rows = rows.where(F.col("recency") <= F.lit(at[0])).where(F.struct("recency", "id") < F.struct(F.lit(at[0]).cast("timestamp_ntz"), F.lit(at[1]).cast("long")))
    order = [F.desc("recency"), F.desc("id")]
    if view == "interesting":
        order = [F.desc_nulls_last("score"), *order]
    if limit is None:
        return shown_items(rows, items, feeds)
    return shown_items(rows.orderBy(*order).limit(limit), items, feeds, order=order)


def shown_items(rows: DataFrame, items: DataFrame, feeds: DataFrame, *more: str, order: list[Column] | None = None) -> DataFrame:
    """What a list shows of rows; sizes count members among all items, unless rows bring them along.  The joins keep no
    order, so a page is put in order after them."""
    sized = rows if "cluster_size" in rows.columns else rows.join(cluster_sizes(items), "cluster_id", "left")
    named = sized.join(feed_titles(feeds), "feed_id")
    return (
        (named.orderBy(*order) if order else named)
        .select(
            "id",
            "feed_id",
            "feed_title",
            "title",
            "url",
            T.iso(F.col("published_at")).alias("published_at"),
            "score",
            F.array_join("tags", ",").alias("tags"),
            F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"),
            F.col("read_at").isNotNull().alias("read"),
            F.col("starred_at").isNotNull().alias("starred"),
            *more,
        )
    )


def siblings(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Each clustered item's others.  Members join by cluster; equal pairs of an item and itself go."""
    member = items.where("cluster_id is not null").select("id", "cluster_id", "feed_id", "title", recency().alias("recency"))
    other = member.join(feed_titles(feeds), "feed_id").select(F.col("id").alias("sibling_id"), "cluster_id", "feed_title", F.col("title").alias("sibling_title"), F.col("recency").alias("sibling_recency"))
    return member.join(other, "cluster_id").where("id <> sibling_id")


def sibling_kinds(items: DataFrame) -> DataFrame:
    """For each cluster's head: whether all titles say the same ("also in") or not ("also covered by")."""
    titles = items.where("cluster_id is not null").withColumn("same", T.same_headline(F.col("title")))
    kinds = titles.groupBy("cluster_id").agg(F.min("same").alias("a"), F.max("same").alias("b"), F.count("*").alias("members"))
    return kinds.select("cluster_id", "members", F.when(F.col("a") == F.col("b"), "also in").otherwise("also covered by").alias("kind"))


def unread_by_feed(feeds: DataFrame, items: DataFrame) -> DataFrame:
    unread = items.where(F.col("read_at").isNull() & is_head()).groupBy("feed_id").agg(F.count("*").alias("n"))
    return feed_titles(feeds).join(unread, "feed_id", "left").select("feed_id", "feed_title", F.coalesce("n", F.lit(0)).cast("long").alias("unread"))


def topics(items: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """The most frequent tags of unread cluster heads."""
    tags = items.where(F.col("read_at").isNull() & is_head()).select(F.explode("tags").alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("items")).where(F.col("items") >= least).orderBy(F.desc("items"), "tag").limit(most)


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items in the order of ids (id, and the positions that say the order); ids without an item are dropped."""
    places = [c for c in ids.columns if c != "id"]
    return ids.join(items, "id").orderBy(*places)
