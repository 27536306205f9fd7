"""Stored settings over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default, least and most of each setting; retention is off at 0, else at least a week.
SETTINGS = {"score_threshold": (65.0, 0.0, 100.0), "dedupe_threshold": (0.90, 0.0, 1.0), "digest_hour": (6.0, 0.0, 23.0), "retention_days": (0.0, 0.0, 36500.0)}
LEAST_RETENTION = 7.0


def clamped(key: str, value: float) -> float:
    default, low, high = SETTINGS[key]
    value = max(low, min(high, value))
    return max(LEAST_RETENTION, value) if key == "retention_days" and value > 0 else value


def resolve(stored: DataFrame) -> DataFrame:
    """(key, value) of every setting: the stored one within its bounds, the default where none is stored or it is no number."""
    known = stored.sparkSession.createDataFrame([(k, *v) for k, v in SETTINGS.items()], "key string, fallback double, low double, high double")
    value = F.coalesce(F.expr("try_cast(value as double)"), "fallback")
    held = F.greatest("low", F.least("high", value))
    kept = F.when((F.col("key") == "retention_days") & (held > 0), F.greatest(F.lit(LEAST_RETENTION), held)).otherwise(held)
    return known.join(stored, "key", "left").select("key", kept.alias("value"))
