"""Exact duplicates by skew-safe combining.

Rows with equal normalised texts are found in three combining steps.  Each step groups by the digest
AND the whole normalised text, so two texts that share a digest never merge:

1. every map task combines its own rows (the partial aggregation of step 2);
2. rows of one text meet within a salt only, so a text that a third of all rows share is spread over
   `salts` tasks;
3. the salt winners, at most `salts` rows for a text, are combined into one.

Only texts whose digest occurs more than once travel.  Everything here is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to so many 64-bit keys of repeated digests are broadcast (a 2M-entry hash set of longs is about
#: 64 MB); beyond it the whole texts are shuffled instead, with the same result.
BROADCAST_KEYS = 2_000_000


#: Up to so many repeated digests are broadcast with their groups (about 100 bytes each); beyond it rows meet them within
#: salts, with the same result.
BROADCAST_GROUPS = 500_000


def squeezed(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256)),
    broadcast_keys: int = BROADCAST_KEYS,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space.  Of equal texts the row with the
    most code points in its original text stays, then the smallest id.  Null texts count as empty, and
    all empty texts are equal.  Rows that repeat an id are each returned and share its fate.  Null ids
    come last among equals.  Ids are numbers.  An empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    light = written(
        rows.select("doc_id", F.length("text").alias("n_points"), squeezed(F.col("text")).alias("body")).select(
            "doc_id", "n_points", F.unhex(F.sha2("body", 256)).alias("sha"), digest(F.col("body")).alias("digest")
        )
    )
    repeated = written(light.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("digest").alias("key")))
    candidates = (
        rows.select("doc_id", F.length("text").alias("n_points"), squeezed(F.col("text")).alias("body"))
        .withColumn("digest", digest(F.col("body")))
        .withColumn("key", F.xxhash64("digest"))
    )
    few = repeated.count() <= broadcast_keys
    candidates = candidates.join(F.broadcast(repeated) if few else repeated, "key", "left_semi")
    salted = (
        candidates.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "body", "n_points", "salt")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    )
    merged = salted.groupBy("digest", "body", "n_points").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    winners = (
        merged.groupBy("digest", "body")
        # The longest original text wins, then the smallest id; a null id loses to any other.
        .agg(
            F.max(F.struct("n_points", F.col("first_id").isNotNull().alias("known"), (-F.col("first_id")).alias("minus"))).alias("best"),
            F.sum("n").alias("group_size"),
        )
        .select("digest", "body", (-F.col("best.minus")).alias("keep_id"), "group_size")
    )
    # Texts go no further where their digest stands for one text, as it does unless digests collide.
    per_digest = winners.groupBy("digest").agg(F.count("*").alias("contents"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    per_digest = written(per_digest)
    if per_digest.count() <= broadcast_groups:
        found = light.join(F.broadcast(per_digest), "digest", "left")
    else:
        copies = per_digest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = light.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(copies, ["digest", "salt"], "left")
    plain = found.where("contents is null or contents = 1").select(
        "doc_id",
        F.when(F.col("contents").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    clashing = per_digest.where("contents > 1").select("digest")
    if not clashing.isEmpty():
        split = (
            rows.select("doc_id", squeezed(F.col("text")).alias("body"))
            .withColumn("digest", digest(F.col("body")))
            .join(clashing, "digest", "left_semi")
            .join(winners, ["digest", "body"])
        )
        plain = plain.unionByName(split.select("doc_id", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")))
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
