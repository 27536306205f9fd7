"""Daily digests and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DIGEST_CONTENT
from .lists import feed_titles, is_head, recency

CANDIDATES, FEWEST = 40, 3


def candidates(items: DataFrame, feeds: DataFrame, day: str, most: int = CANDIDATES) -> DataFrame:
    """A day's cluster heads, best and newest first."""
    rows = items.where(is_head()).withColumn("recency", recency()).where(F.to_date("recency") == F.lit(day).cast("date"))
    order = [F.desc_nulls_last("score"), F.desc("recency"), F.desc("id")]
    top = rows.orderBy(*order).limit(most)
    return top.join(feed_titles(feeds), "feed_id").select("id", "title", "feed_title", "score", "summary", "recency").orderBy(*order)


def threads(digests: DataFrame) -> DataFrame:
    """(day, thread position, title, item position, item_id) of digests; content that can't be read gives none."""
    read = digests.select("day", F.from_json("content", DIGEST_CONTENT, {"mode": "PERMISSIVE"}).alias("c"))
    flat = read.select("day", F.posexplode("c.threads").alias("thread", "t"))
    return flat.select("day", "thread", F.col("t.title").alias("title"), F.posexplode("t.item_ids").alias("pos", "item_id"))


def recorded(digests: DataFrame, written: DataFrame) -> DataFrame:
    """digests with a day's new digest in place of an old one."""
    return digests.join(written.select("day"), "day", "left_anti").select(written.columns).unionByName(written)


def pruned(content: DataFrame, known: DataFrame) -> DataFrame:
    """threads() rows whose item is known; a thread without any is gone."""
    return content.join(known, "item_id", "left_semi")


def known_only(digests: DataFrame, known: DataFrame) -> DataFrame:
    """Digests as they are to be stored: threads keep the ids that are known (item_id), and threads without any go."""
    kept = pruned(threads(digests), known).groupBy("day", "thread").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("ids"))
    left = kept.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("thread", F.transform("ids", lambda x: x["item_id"]).alias("ids")))).alias("left"))
    read = digests.join(left, "day", "left").withColumn("c", F.from_json("content", DIGEST_CONTENT))
    threads_ = F.filter(
        F.transform("c.threads", lambda t, i: F.struct(t["title"].alias("title"), t["note"].alias("note"), F.coalesce(F.col("left")[i], F.array().cast("array<bigint>")).alias("item_ids"))),
        lambda t: F.size(t["item_ids"]) > 0,
    )
    content = F.to_json(F.struct(F.col("c.intro").alias("intro"), threads_.alias("threads")))
    return read.select(*(content.alias(c) if c == "content" else F.col(c) for c in digests.columns))


def retention_victims(items: DataFrame, digests: DataFrame, cutoff: str, most: int | None = 2000) -> DataFrame:
    """Read, unstarred, uncited items older than the cutoff, oldest first."""
    old = items.where(F.col("read_at").isNotNull() & F.col("starred_at").isNull()).withColumn("recency", recency())
    cited = threads(digests).select(F.col("item_id").alias("id"))
    rows = old.where(F.col("recency") < F.lit(cutoff).cast("timestamp_ntz")).join(cited, "id", "left_anti")
    return rows.orderBy("recency", "id").limit(most) if most else rows


def prune(items: DataFrame, vectors: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and vectors that stay; a cluster that lost its head gets its oldest member as the new one."""
    left = items.drop("cluster_size").join(victims.select("id"), "id", "left_anti")
    heads = left.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(F.struct(recency().alias("r"), "id"))["id"].alias("first"), F.max((F.col("id") == F.col("cluster_id")).cast("int")).alias("alive"))
    new = F.when(F.col("n") == 1, F.lit(None)).when(F.col("alive") == 1, F.col("cluster_id")).otherwise(F.col("first"))
    fixed = left.join(heads, "cluster_id", "left").withColumn("cluster_id", F.when(F.col("cluster_id").isNotNull(), new)).select(left.columns)
    return fixed, vectors.join(victims.select(F.col("id").alias("item_id")), "item_id", "left_anti")
