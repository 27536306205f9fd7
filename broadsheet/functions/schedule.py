"""When a feed is polled next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in seconds: shortest, first and longest interval, and the longest a publisher may ask for.
SHORTEST, FIRST, LONGEST, LONGEST_ASKED = 900, 1800, 21_600, 604_800


def next_interval(current: Column, result: Column, failures: Column, ttl_minutes: Column) -> Column:
    """Seconds to the next poll.  result: new, unchanged or failed; failures counts this poll too.

    New items shorten the interval by a quarter, none lengthen it by half, failures double it from the first.
    Our own bounds come first, then the publisher's ttl as a floor that may pass them.
    """
    seconds = current.cast("long")
    backoff = F.element_at(F.array(*(F.lit(FIRST << k) for k in range(5))), F.greatest(F.lit(1), F.least(F.lit(5), failures)).cast("int"))
    base = F.when(result == "failed", backoff).when(result == "new", F.floor(seconds * 3 / 4)).otherwise(F.floor(seconds * 3 / 2))
    ours = F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), base))
    return F.least(F.greatest(ours, F.coalesce(ttl_minutes, F.lit(0)).cast("long") * 60), F.lit(LONGEST_ASKED)).cast("long")


def jittered(seconds: Column, seed: int, share: float = 0.1) -> Column:
    """Up to `share` more or less, at random."""
    return F.round(seconds * (1 - share + 2 * share * F.rand(seed))).cast("long")


def later(now: Column, seconds: Column) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
