"""What a scheduler calls every so often: each tick looks at the tables and does what is due, or nothing."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import digests as D
from ..operators import vectors as V
from ..operators import work as W
from ..operators.lists import recency

#: Seconds between ticks.
DIGEST_TICK, RETENTION_TICK, POLL_TICK = 600, 3600, 60


def poll_batch(feeds: DataFrame, now: datetime, most: int = W.POLLS) -> DataFrame:
    """The feeds that this tick polls, those that wait longest first."""
    return W.due_feeds(feeds, f"{now:%Y-%m-%d %H:%M:%S}", most)


def digest_due(digests: DataFrame, now: datetime, hour: int) -> str | None:
    """Yesterday, once the hour has come and as long as there is no digest of it; else None."""
    day = f"{now - timedelta(days=1):%Y-%m-%d}"
    if now.hour < hour or not digests.where(F.col("day") == F.lit(day).cast("date")).isEmpty():
        return None
    return day


def digest_tick(engine: Engine, now: datetime, hour: int, write: Callable[[DataFrame, str], DataFrame | None]) -> Engine:
    """`write` makes a digest (the columns of engine.digests) of a day's candidates; an unreachable model raises OSError
    and is asked again at the next tick.  Item ids that were not among the candidates are dropped, and a quiet day has
    no digest."""
    day = digest_due(engine.digests, now, hour)
    rows = engine.digest_candidates(day) if day else None
    if rows is None:
        return engine
    try:
        made = write(rows, day)
    except OSError:
        return engine
    if made is None:
        return engine
    return engine.record_digest(D.known_only(made, rows.select(F.col("id").alias("item_id"))))


def retention_tick(engine: Engine, now: datetime, days: int, most: int = 2000) -> Engine:
    """Deletes at most `most` old items; retention is off at 0 days."""
    if days <= 0:
        return engine
    return engine.prune(f"{now - timedelta(days=days):%Y-%m-%d %H:%M:%S}", most)


def dedupe_tick(engine: Engine, fresh: DataFrame, now: datetime, threshold: float = 0.90) -> Engine:
    """New items (item_id) join the clusters of the last 72 hours, counted from now; one with an old date but within them
    is compared like any other, however late it came."""
    at = engine.items.select(F.col("id").alias("item_id"), recency().alias("ts"))
    timed = engine.vectors.drop("ts").join(at, "item_id")
    return engine.with_items(V.joined_clusters(engine.items, timed, fresh, engine.model, f"{now:%Y-%m-%d %H:%M:%S}", threshold))
