"""The reader's tables in one archive: each change is a commit over all the tables that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Embedder, Engine, embedded
from .functions.text import embed_input, retry_after_seconds
from .operators import digests as D
from .operators import state as S
from .operators import vectors as V
from .operators import work as W
from .operators.lists import recency
from .operators.search import INDEX_TABLES, StoredIndex
from .schemas import EMBEDDINGS, EVENT, FEEDS, ITEMS
from .session import written
from .sources.archive import BROADCAST_KEYS, Archive, Commit, Table
from .sources.feeds import entries, parse_responses

#: Items that one pass embeds at most.
EMBEDS = 10_000
#: Changed rows (an id and a few numbers or times) that are broadcast to find their whole rows.
BROADCAST_CHANGES = 500_000
DIGESTS = "day date, content string, model string, item_count int, created_at timestamp_ntz"
TABLES = {
    "feeds": Table(FEEDS, "id", ("id",)),
    "items": Table(ITEMS, "id", ("feed_id", "id")),
    "vectors": Table(EMBEDDINGS, "item_id", ("item_id",)),
    "digests": Table(DIGESTS, "day"),
    "events": Table(f"{EVENT}, batch long", "batch", ("batch",)),
}


def numbered(rows: DataFrame, start: int, name: str = "id") -> DataFrame:
    """rows with consecutive numbers from start on, whatever their partitions: only the partitions' sizes are gathered."""
    at = F.monotonically_increasing_id()
    placed = written(rows.withColumn("_at", at))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first, starts = start, []
    for k, n in sizes:
        starts.append((k, first))
        first += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    return placed.withColumn("_part", part.cast("long")).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + own).drop("_part", "_first", "_at")


def shaped(rows: DataFrame, kind, **more: Column) -> DataFrame:
    """rows in a schema: what they lack is null."""
    known = {c: F.col(f"`{c}`") for c in rows.columns} | more
    return rows.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind))


class StoredReader:
    """Reads through engine(), at one version; changes are commits, and a lost writer leaves none half made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.archive = Archive(spark, path, TABLES | INDEX_TABLES)
        self.index = StoredIndex(self.archive)

    def engine(self, version: int | None = None, **more) -> Engine:
        """The tables at a version, the newest if none is given; readers keep theirs while writers go on."""
        at = self.archive.version() if version is None else version
        feeds, items, vectors, digests = (self.archive.read(t, at) for t in ("feeds", "items", "vectors", "digests"))
        return Engine(feeds, items, vectors, digests, index=StoredIndex(self.archive, at), **more)

    def start(self, feeds: DataFrame, items: DataFrame | None = None, vectors: DataFrame | None = None, digests: DataFrame | None = None) -> int:
        """First tables, with the index of the items."""
        commit = self.archive.begin()
        for name, df in (("feeds", feeds), ("items", items), ("vectors", vectors), ("digests", digests)):
            if df is not None:
                commit.replace(name, shaped(df, TABLES[name].schema))
        if items is not None:
            self.index.fill(commit, added=items)
            commit.counters["items"] = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
        return commit.done()

    def record_polls(self, responses: DataFrame, now: str, batch: int | None = None, stream: str = "polls") -> int | None:
        """Fetched responses (feed_id, url, status, body, and where they came etag, last_modified, retry_after): new items and
        their postings, the feeds' rows and the events, in one commit.

        A batch of a stream that was committed before is left alone (None), and one whose writer was lost is done anew, so
        each counts once.  Of several responses of a feed all give items, and the newest (by poll, where there is one) the
        feed's row.  Only the items of the polled feeds are read."""
        from .streaming.ingest import feeds_updated, items_new

        commit = self.archive.begin()
        if batch is not None and commit.seen(stream, batch):
            return None
        at = F.lit(now).cast("timestamp_ntz")
        has = lambda c: F.col(c) if c in responses.columns else F.lit(None).cast("string")
        told = written(responses.select("feed_id", "url", F.col("status").cast("int").alias("status"), "body", *(has(c).alias(c) for c in ("etag", "last_modified", "retry_after")), (-F.coalesce(has("poll").cast("long"), F.lit(0))).alias("turn")))
        wait = retry_after_seconds(F.col("retry_after"), at)
        latest = S.first_of_batch(told, ["feed_id"], "turn")
        outcome = latest.select("feed_id", "status", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_last_modified"), wait.alias("wait_s"), S.fetch_outcome(F.col("status"), wait).alias("outcome"))
        fetched = told.where(F.col("status").between(200, 299))
        parsed = written(parse_responses(fetched))
        polled = [r["feed_id"] for r in told.select("feed_id").distinct().collect()]  # a poll's batch, at most some dozens
        known = commit.read("items").where(F.col("feed_id").isin(polled)).select("feed_id", "guid")
        fresh = S.insert_missing(known, entries(parsed), ["feed_id", "guid"], "pos")
        top = commit.base["counters"].get("items", 0)
        fresh = shaped(numbered(fresh, top + 1), TABLES["items"].schema, fetched_at=at, extracted=F.lit(False), **{c: F.lit(0) for c in ("extract_attempts", "enrich_attempts", "embed_attempts", "feedback")})
        fresh = written(fresh)
        added = written(fresh.groupBy("feed_id").agg(F.count("*").alias("count")))
        heads = parsed.select("feed_id", "ok", F.col("feed_title").alias("new_title"), F.col("site_url").alias("new_site_url"), F.col("icon").alias("new_icon_url"), F.col("ttl_minutes").alias("new_ttl"), (~F.col("ok")).alias("turn"))
        heads = S.first_of_batch(heads, ["feed_id"], "turn").drop("turn")
        polls = outcome.join(heads, "feed_id", "left").join(added, "feed_id", "left")
        kind = F.when(F.col("outcome").isin("retry_after", "refused"), F.col("outcome")).when(F.col("outcome") == "unchanged", "unchanged")
        kind = kind.when((F.col("outcome") == "fetched") & F.col("ok"), F.when(F.col("count") > 0, "new").otherwise("unchanged")).otherwise("failed")
        error = F.when(F.col("outcome") == "fetched", "not a feed").otherwise(F.coalesce(F.concat(F.lit("status "), F.col("status").cast("string")), F.lit("no answer")))
        polls = polls.withColumns({"kind": kind, "not_modified": F.coalesce(F.col("outcome") == "unchanged", F.lit(False)), "error": error})
        before = commit.read("feeds").where(F.col("id").isin(polled))
        commit.change("feeds", S.poll_transition(before, polls.drop("outcome", "status", "ok", "count"), now))
        commit.counters["items"] = top + commit.add("items", fresh)
        self.index.fill(commit, added=fresh)
        events = items_new(fresh).unionByName(feeds_updated(told, fresh))
        commit.add("events", events.withColumn("batch", F.lit(commit.seq if batch is None else batch).cast("long")))
        return commit.done(stream if batch is not None else None, batch)

    def mark_read(self, now: str, scope: Column) -> int:
        """Only the rows that change are written."""
        return self._items_after(lambda items: S.mark_read(items, scope, now), "read_at")

    def patch_items(self, patches: DataFrame, now: str) -> int:
        return self._items_after(lambda items: S.patch_items(items, patches, now), "read_at", "starred_at", "feedback")

    def _items_after(self, change: Callable[[DataFrame], DataFrame], *columns: str) -> int:
        commit = self.archive.begin()
        items = commit.read("items")
        commit.change("items", self._differing(items, change(items), *columns))
        return commit.done()

    @staticmethod
    def _differing(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
        """Rows of before with after's values of columns, where those differ.  Only ids and those columns are compared;
        whole rows are read for the ids that change, by a broadcast of them up to BROADCAST_CHANGES."""
        old = before.select("id", *(F.col(c).alias(f"old_{c}") for c in columns))
        other = F.lit(False)
        for c in columns:
            other = other | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
        moved = written(after.select("id", *columns).join(old, "id").where(other).select("id", *columns))
        few = moved.count() <= BROADCAST_CHANGES
        return before.drop(*columns).join(F.broadcast(moved) if few else moved, "id").select(before.columns)

    def embed(self, embedder: Embedder, now: str, model: str = "m1", batch: int = 16, threshold: float = 0.90) -> int | None:
        """Vectors of the items that are due, their attempts, and the clusters that the new ones join, in one commit.

        New vectors are compared with those of the last 72 hours alone; heads elected before stay heads.  Returns None
        if nothing is due."""
        commit = self.archive.begin()
        feeds, items, vectors = (commit.read(t) for t in ("feeds", "items", "vectors"))
        due = W.due_embedding(items, feeds, vectors, model, EMBEDS).select("id").join(items, "id")
        found = written(embedded(due.select("id", embed_input(F.col("title"), F.col("content_text")).alias("text")), embedder, model, batch))
        if found.isEmpty():
            return None
        tried, after = S.record_vectors(items.join(found.select(F.col("item_id").alias("id")), "id", "left_semi"), vectors, found.withColumn("unreachable", F.lit(False)), now)
        fresh = written(found.where("embedding is not null").select("item_id"))
        at = items.select(F.col("id").alias("item_id"), recency().alias("ts"))
        timed = after.join(at, "item_id")
        light = items.select("id", "cluster_id", "embed_attempts")
        counted = light.join(tried.select("id", F.col("embed_attempts").alias("_attempts")), "id", "left").withColumn("embed_attempts", F.coalesce("_attempts", "embed_attempts")).drop("_attempts")
        grouped = V.joined_clusters(counted.select(light.columns), timed, fresh, model, now, threshold)
        commit.change("items", self._differing(items, grouped, "embed_attempts", "cluster_id"))
        commit.change("vectors", after.join(fresh, "item_id", "left_semi"))
        return commit.done()

    def prune(self, cutoff: str, most: int | None = 2000) -> int:
        """Old items, their vectors and postings go, and clusters that lost their head get another, in one commit."""
        commit = self.archive.begin()
        items, vectors = commit.read("items"), commit.read("vectors")
        victims = written(D.retention_victims(items, commit.read("digests"), cutoff, most).select("id", "cluster_id"))
        touched = victims.where("cluster_id is not null").select("cluster_id").distinct()
        members = written(items.join(touched, "cluster_id", "left_semi"))
        left, _ = D.prune(members.select(items.columns), vectors, victims)
        commit.change("items", self._differing(members, left, "cluster_id"))
        self._gone(commit, victims)
        return commit.done()

    def delete_feed(self, feed_id: int) -> int:
        commit = self.archive.begin()
        commit.delete("feeds", self.spark.createDataFrame([(feed_id,)], "id long"))
        self._gone(commit, written(commit.read("items").where(F.col("feed_id") == feed_id).select("id")))
        return commit.done()

    def _gone(self, commit: Commit, ids: DataFrame) -> None:
        commit.delete("items", ids.select("id"))
        commit.delete("vectors", ids.select("id"))
        self.index.fill(commit, gone=ids)

    def upkeep(self, most: int = 8, keep: int = 2) -> None:
        """Compaction of tables with many segments or deleted keys, and deletion of what no recent version names."""
        for name, own in self.archive.manifest()["tables"].items():
            crowded = sum(d["rows"] for d in own.get("deletes", [])) > BROADCAST_KEYS
            if crowded or len(own["segments"]) > most:
                self.archive.compact(name, whole=crowded)
        self.archive.vacuum(keep)
