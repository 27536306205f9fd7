"""The loop that runs the ticks: a stream whose batches do nothing but come regularly, fetching with bounded concurrency,
and failures that end neither the loop nor each other's work."""

from __future__ import annotations

import logging
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..session import ship
from ..store import StoredReader
from .ticks import POLL_TICK, poll_batch

log = logging.getLogger(__name__)

#: A tick comes this share of its interval earlier or later.
JITTER = 0.1
#: Feeds that are fetched at a time.
AT_ONCE = 4

#: Of a feed's row, the response: status, body, etag, last_modified, retry_after.  OSError: no answer.
Fetcher = Callable[[dict], dict]
RESPONSE = "feed_id long, url string, status int, body string, etag string, last_modified string, retry_after string"


@dataclass
class Tick:
    every_s: float
    run: Callable[[datetime], object]
    due: datetime | None = None
    failures: int = 0


@dataclass
class Loop:
    """Ticks by name.  One that raises is logged, counted and asked again at its next time, like any other."""

    ticks: dict[str, Tick]
    chance: random.Random = field(default_factory=random.Random)

    def step(self, now: datetime) -> list[str]:
        """Runs what is due; returns what ran well.  The next time is counted from now, with jitter, so that what was
        added together doesn't stay in step for ever."""
        done = []
        for name, tick in self.ticks.items():
            if tick.due is not None and now < tick.due:
                continue
            tick.due = now + timedelta(seconds=tick.every_s * self.chance.uniform(1 - JITTER, 1 + JITTER))
            try:
                tick.run(now)
                tick.failures = 0
                done.append(name)
            except Exception:
                tick.failures += 1
                log.exception("tick %s failed, %s times in a row", name, tick.failures)
        return done

    def start(self, spark: SparkSession, checkpoint: str, look_s: float = 1.0, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc).replace(tzinfo=None)) -> StreamingQuery:
        """Looks for what is due every look_s seconds until the query is stopped.  Work that takes longer delays the next
        look; it is never run twice at once."""
        beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return beat.writeStream.foreachBatch(lambda rows, number: self.step(clock()) and None).option("checkpointLocation", checkpoint).trigger(processingTime=f"{look_s} seconds").start()


def fetched(due: DataFrame, fetcher: Fetcher, at_once: int = AT_ONCE) -> DataFrame:
    """Responses of feeds (id, url, etag, last_modified, user_agent).  Each of at_once tasks asks one feed at a time, so no
    more are asked at once; one that can't be reached has no status, and costs the others nothing."""
    ship(due.sparkSession)
    names = [x.split()[0] for x in RESPONSE.split(", ")]

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for feed in frame.to_dict("records"):
                try:
                    answer = dict(fetcher({k: None if v is None or v != v else v for k, v in feed.items()}))
                except (OSError, ValueError):
                    answer = {}
                row = {"feed_id": feed["id"], "url": feed["url"]} | {k: answer.get(k) for k in names[2:]}
                yield pd.DataFrame([row], columns=names).astype({"status": "Int32"})

    return due.select("id", "url", "etag", "last_modified", "user_agent").repartition(at_once).mapInPandas(ask, RESPONSE)


def poll_tick(reader: StoredReader, fetcher: Fetcher, at_once: int = AT_ONCE) -> Callable[[datetime], int | None]:
    """A tick that fetches the feeds that are due and commits what came of it."""

    def run(now: datetime) -> int | None:
        feeds = reader.engine().feeds
        due = poll_batch(feeds, now).select("id").join(feeds, "id")
        if due.isEmpty():
            return None
        return reader.record_polls(fetched(due, fetcher, at_once), f"{now:%Y-%m-%d %H:%M:%S}")

    return run


def reading_loop(reader: StoredReader, fetcher: Fetcher, embedder=None, retention_days: int = 0, poll_s: float = POLL_TICK) -> Loop:
    """Polling, embedding with clustering of what is new, retention and upkeep."""
    from .ticks import RETENTION_TICK

    ticks = {"poll": Tick(poll_s, poll_tick(reader, fetcher))}
    if embedder is not None:
        ticks["embed"] = Tick(30, lambda now: reader.embed(embedder, f"{now:%Y-%m-%d %H:%M:%S}"))
    if retention_days > 0:
        ticks["retention"] = Tick(RETENTION_TICK, lambda now: reader.prune(f"{now - timedelta(days=retention_days):%Y-%m-%d %H:%M:%S}"))
    ticks["upkeep"] = Tick(RETENTION_TICK, lambda now: reader.upkeep())
    return Loop(ticks)
