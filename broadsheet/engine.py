"""One object over the archive's tables, with the operations a reader's server offers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.answers import read_answer
from .functions.text import embed_input
from .operators import digests as D
from .operators import lists as L
from .operators import search as X
from .operators import state as S
from .operators import vectors as V
from .operators import work as W
from .session import ship
from .settings import clamped, resolve

Embedder = Callable[[list[str]], list[list[float]]]
Enricher = Callable[[str, str], str]


@dataclass(frozen=True)
class Page:
    rows: list
    mode: str
    next_cursor: str | None


@dataclass(frozen=True)
class Engine:
    """Tables in, tables out: every change returns a new Engine over the next snapshot, as a plan that is not stored yet; a
    stored index is of the snapshot before and left behind.  store.StoredReader is the form that stores each change."""

    feeds: DataFrame
    items: DataFrame
    vectors: DataFrame
    digests: DataFrame
    stored: DataFrame | None = None
    model: str = "m1"
    embedder: Embedder | None = None
    threshold: int = 65
    #: A stored index, or operators.search.postings of items; without one a search reads all texts.
    index: DataFrame | X.StoredIndex | None = None

    def page(self, view: str = "unread", feed_id: int | None = None, tag: str | None = None, query: str | None = None, mode: str = "text", cursor: str | None = None, limit: int | None = None) -> Page:
        """One page's rows, at most 200 of them, in order; a full page of a list by time has a cursor to the next."""
        rows, found = self.list(view, feed_id, tag, query, mode, cursor, limit)
        held = rows.collect()
        by_time = found == "text" and (view != "interesting" or L.search_terms(query) is not None)
        more = None
        if by_time and len(held) == L.page_size(limit):
            last = self.items.where(F.col("id") == held[-1]["id"]).select(L.recency().alias("at")).first()
            more = L.make_cursor(last["at"], held[-1]["id"])
        return Page(held, found, more)

    def list(self, view: str = "unread", feed_id: int | None = None, tag: str | None = None, query: str | None = None, mode: str = "text", cursor: str | None = None, limit: int | None = None) -> tuple[DataFrame, str]:
        """Rows, and the mode that found them: semantic search falls back to text when no query vector comes."""
        if mode == "semantic" and query and query.strip():
            asked = self._query_vector(query)
            if asked is not None:
                found = V.semantic_search(self.vectors, asked, self.model, limit=L.page_size(limit))
                rows = self.items if feed_id is None else self.items.where(F.col("feed_id") == feed_id)
                best = [F.desc("similarity"), F.col("id")]
                return L.shown_items(rows.join(found.withColumnRenamed("item_id", "id"), "id"), self.items, self.feeds, "similarity", order=best), "semantic"
        return L.list_items(self.items, self.feeds, view, feed_id, tag, query, cursor, L.page_size(limit), self.threshold, self.index), "text"

    def _query_vector(self, query: str) -> list[float] | None:
        try:
            v = self.embedder([query.strip()])[0] if self.embedder else None
        except (OSError, ValueError):
            return None
        if v is None:
            return None
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    def topics(self) -> DataFrame:
        return L.topics(self.items)

    def unread(self) -> DataFrame:
        return L.unread_by_feed(self.feeds, self.items)

    def inspect(self) -> DataFrame:
        return W.feed_inspection(self.feeds)

    def settings(self) -> DataFrame:
        return resolve(self.stored)

    def mark_read(self, now: str, feed_id: int | None = None, tag: str | None = None, query: str | None = None) -> Engine:
        scope = F.lit(True)
        if feed_id is not None:
            scope &= F.col("feed_id") == feed_id
        if tag:
            scope &= F.array_contains("tags", tag)
        terms = L.search_terms(query)
        if terms is not None:
            scope &= L.matches(terms, F.col("title"), F.col("content_text"))
        return replace(self, items=S.mark_read(self.items, scope, now))

    def digest(self, day: str) -> DataFrame:
        """A day's digest with its items in order; items since deleted are left out."""
        ids = D.threads(self.digests.where(F.col("day") == F.lit(day).cast("date"))).select("thread", "title", "pos", F.col("item_id").alias("id"))
        return L.by_ids(self.items.select("id", "title"), ids.select("thread", "pos", "id", F.col("title").alias("thread_title")))

    def feed(self, feed_id: int) -> DataFrame:
        return self.feeds.where(F.col("id") == feed_id)

    def item(self, item_id: int) -> DataFrame:
        """One item as the reader shows it, members of clusters too."""
        return L.shown_items(self.items.where(F.col("id") == item_id), self.items, self.feeds, "content_text", "summary")

    def vector(self, item_id: int) -> DataFrame:
        return self.vectors.where(F.col("item_id") == item_id)

    def enrichment(self, item_id: int) -> DataFrame:
        return self.items.where(F.col("id") == item_id).select("id", "summary", "score", "tags")

    def with_items(self, items: DataFrame) -> Engine:
        return replace(self, items=items)

    def add_items(self, batch: DataFrame) -> Engine:
        """New items by (feed_id, guid), and their postings."""
        fresh = S.insert_missing(self.items, batch, ["feed_id", "guid"], "id").select(self.items.columns)
        return replace(self, items=self.items.unionByName(fresh), index=X.updated(self.index, fresh) if isinstance(self.index, DataFrame) else None)

    def record_digest(self, digest: DataFrame) -> Engine:
        return replace(self, digests=D.recorded(self.digests, digest))

    def record_vectors(self, found: DataFrame, now: str) -> Engine:
        items, vectors = S.record_vectors(self.items, self.vectors, found, now)
        return replace(self, items=items, vectors=vectors)

    def set(self, changes: dict[str, float]) -> Engine:
        """Settings stored within their bounds, those given in place of what was stored."""
        rows = self.feeds.sparkSession.createDataFrame([(k, str(clamped(k, v))) for k, v in changes.items()], "key string, value string")
        return replace(self, stored=rows if self.stored is None else S.upsert_newest(self.stored, rows, "key"))

    def add_feeds(self, asked: DataFrame, now: str) -> Engine:
        return replace(self, feeds=S.insert_feeds(self.feeds, asked, now))

    def patch_feeds(self, patches: DataFrame, now: str) -> Engine:
        """patches as operators.state.patch_feeds takes them; a new agent also gives items their extraction attempts back."""
        feeds, items = S.patch_with_items(self.feeds, self.items, patches, now)
        return replace(self, feeds=feeds, items=items)

    def digest_candidates(self, day: str) -> DataFrame | None:
        """None on a day with fewer items than make a digest."""
        rows = D.candidates(self.items, self.feeds, day)
        return rows if rows.limit(D.FEWEST).count() >= D.FEWEST else None

    def prune(self, cutoff: str, most: int | None = 2000) -> Engine:
        victims = D.retention_victims(self.items, self.digests, cutoff, most)
        items, vectors = D.prune(self.items, self.vectors, victims)
        index = self.index.join(victims.select("id"), "id", "left_anti").select("token", "id") if isinstance(self.index, DataFrame) else None
        return replace(self, items=items, vectors=vectors, index=index)

    def delete_feed(self, feed_id: int) -> Engine:
        gone = self.feeds.sparkSession.createDataFrame([(feed_id,)], "feed_id long")
        feeds, items, vectors = S.delete_feeds(gone, self.feeds, self.items, self.vectors)
        return replace(self, feeds=feeds, items=items, vectors=vectors)

    def embed(self, batch: int = 16) -> DataFrame:
        """(item_id, model, embedding) of items due, unit vectors, in batches of the embedder's size."""
        due = W.due_embedding(self.items, self.feeds, self.vectors, self.model).select("id").join(self.items, "id")
        return embedded(due.select("id", embed_input(F.col("title"), F.col("content_text")).alias("text")), self.embedder, self.model, batch)

    def cluster(self, threshold: float = 0.90) -> Engine:
        """Near duplicates of the last hours share a head; at 1 and over clustering is off."""
        if threshold >= 1:
            return replace(self, items=self.items.withColumn("cluster_id", F.lit(None).cast("long")))
        at = self.items.select(F.col("id").alias("item_id"), L.recency().alias("ts"))
        timed = self.vectors.where(F.col("model") == self.model).drop("ts").join(at, "item_id")
        found = V.cluster_forest(timed, V.similar_pairs(timed, threshold)).withColumnRenamed("item_id", "id")
        return replace(self, items=self.items.drop("cluster_id").join(found, "id", "left").select(self.items.columns))


def embedded(rows: DataFrame, embedder: Embedder, model: str, batch: int = 16) -> DataFrame:
    """(item_id, model, embedding) of (id, text) rows; a failed batch gives null vectors, for the next pass to try again."""
    ship(rows.sparkSession)

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at in range(0, len(frame), batch):
                texts = frame["text"].iloc[at : at + batch].tolist()
                try:
                    found = embedder(texts)
                    if len(found) != len(texts):
                        raise ValueError("as many vectors as texts are asked for")
                except (OSError, ValueError):
                    found = [None] * len(texts)
                out += found
            yield pd.DataFrame({"item_id": frame["id"], "model": model, "embedding": out})

    raw = rows.mapInPandas(embed, "item_id long, model string, embedding array<float>")
    return raw.withColumn("embedding", V.normalised(F.col("embedding")))


def enriched(prompts: DataFrame, enricher: Enricher, system: str, kind: str = "enrich") -> DataFrame:
    """(id, answer, outcome) of (id, prompt) rows.  An unreachable model costs an item nothing; a bad answer one attempt."""
    ship(prompts.sparkSession)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for prompt in frame["prompt"]:
                try:
                    out.append((enricher(system, prompt), "ok"))
                except OSError:
                    out.append((None, "unreachable"))
                except ValueError:
                    out.append((None, "failed"))
            yield pd.DataFrame({"id": frame["id"], "raw": [a for a, _ in out], "outcome": [o for _, o in out]})

    read = prompts.mapInPandas(ask, "id long, raw string, outcome string").withColumn("answer", read_answer(F.col("raw"), kind))
    bad = (F.col("outcome") == "ok") & F.col("answer").isNull()
    return read.select("id", "answer", F.when(bad, "failed").otherwise(F.col("outcome")).alias("outcome"))
