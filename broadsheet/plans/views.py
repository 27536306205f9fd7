"""The archive's tables derived from the driver's ones, in Spark and, as common table expressions, in SQL.

Only whole-number arithmetic on ids decides a row's state, so both sides agree on every row.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import StoredIndex
from ..session import shared_dir

NOW = "2024-02-05 00:00:00"
PROFILE = "p1"


class Views:
    """Tables of one data folder; each is built when asked for, and only scans what its columns need."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def feeds(self) -> DataFrame:
        sources = self.table("documents").select("source").distinct().withColumn("id", F.expr("cast(substring(source, 4) as bigint)"))
        return sources.selectExpr(
            "id",
            "concat('https://', source, '.example/feed') as url",
            "concat('https://', source, '.example/') as site_url",
            "case when id % 3 <> 0 then source else '' end as title",
            "case when id % 5 = 0 then upper(source) end as custom_title",
            "case when id % 4 <> 0 then 'data:image/png;base64,AA==' when id % 8 = 0 then 'https://x.example/i.png' end as icon",
            "cast(null as string) as icon_url",
            "cast(id % 5 as int) as icon_attempts",
            "case when id % 2 = 0 then concat('e', id) end as etag",
            "case when id % 7 = 0 then 'Mon, 01 Jan 2024 00:00:00 GMT' end as last_modified",
            "cast(null as timestamp_ntz) as last_fetch_at",
            "timestamp_ntz'2024-02-04 00:00:00' + make_dt_interval(0, cast(id * 3 as int), 0, 0) as next_fetch_at",
            "900 * (1 + id % 24) as interval_s",
            "cast(id % 5 as int) as failures",
            "cast(id % 4 as int) as refusals",
            "case when id % 10 = 0 then 7200L end as retry_after_s",
            "cast(nullif(60 * (id % 4), 0) as int) as ttl_minutes",
            "case id % 5 when 1 then 'Connection timed out' when 2 then 'dns error' when 3 then '404 not found' end as last_error",
            "id % 9 = 0 as disabled",
            "id % 6 <> 0 as llm_enabled",
            "case when id % 8 = 0 then 'agent/1' end as user_agent",
        )

    @cached_property
    def bare_items(self) -> DataFrame:
        """Items without score and cluster_id: no row leaves its partition."""
        return self._items(self.table("documents"))

    @cached_property
    def plain_items(self) -> DataFrame:
        """Items without cluster_id, which needs a shuffle of the texts' digests; the score takes a join with the labels."""
        return self._items(self.table("documents").join(self.table("labels"), "doc_id", "left"), "40 + 35 * quality - 30 * toxic + doc_id % 20 as score")

    @staticmethod
    def _items(docs: DataFrame, *more: str) -> DataFrame:
        ts = "timestamp_ntz'{}' + make_dt_interval(0, 0, cast({} as int), {})"
        return docs.selectExpr(
            "doc_id as id",
            "cast(substring(source, 4) as bigint) as feed_id",
            "concat('g', doc_id) as guid",
            "case when doc_id % 13 <> 0 then concat('https://', source, '.example/a/', doc_id) end as url",
            "replace(substring(text, 1, 60), '\\n', ' ') as title",
            f"case when doc_id % 11 <> 0 then {ts.format('2024-01-01 00:00:00', 'doc_id * 37', '0')} end as published_at",
            f"{ts.format('2024-02-01 00:00:00', '0', 'cast(doc_id as decimal(18,6))')} as fetched_at",
            "text as content_text",
            "n_chars < 400 as truncated",
            "doc_id % 4 = 0 as extracted",
            "cast(doc_id % 5 as int) as extract_attempts",
            "case doc_id % 5 when 1 then 'Timeout while reading' when 2 then 'no article' end as extract_error",
            "case when doc_id % 2 = 0 then substring(replace(text, '\\n', ' '), 1, 120) end as summary",
            *more,
            "array(lang, concat('t', doc_id % 7)) as tags",
            "case when doc_id % 2 = 0 then timestamp_ntz'2024-02-02 00:00:00' end as enriched_at",
            "cast(doc_id % 4 as int) as enrich_attempts",
            "case doc_id % 6 when 1 then 'Error sending request for url' when 2 then 'model: operation timed out' when 3 then 'no json, error sending request' end as enrich_error",
            "case when doc_id % 7 <> 0 then concat('p', doc_id % 3) end as scored_profile",
            "case when doc_id % 3 = 0 then timestamp_ntz'2024-02-03 00:00:00' end as read_at",
            "case when doc_id % 10 = 0 then timestamp_ntz'2024-02-03 06:00:00' end as starred_at",
            "cast(case doc_id % 25 when 0 then 1 when 1 then -1 else 0 end as int) as feedback",
            "cast(doc_id % 4 as int) as embed_attempts",
            "case doc_id % 5 when 1 then 'error sending request' when 2 then 'Operation timed out after 60 s' when 3 then 'wrong size' end as embed_error",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """(id, cluster_id, cluster_size) of items whose text another item has too."""
        digests = self.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
        heads = digests.groupBy("digest").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
        return digests.join(heads, "digest").select("id", "cluster_id", F.col("n").alias("cluster_size"))

    @cached_property
    def items(self) -> DataFrame:
        """Items with their cluster and its size, which lists then need not count."""
        return self.plain_items.join(self.clusters, "id", "left")

    @cached_property
    def vectors(self) -> DataFrame:
        ts = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(vec_id * 37 as int), 0)"
        return self.table("embeddings").selectExpr(
            "vec_id as item_id",
            "case when vec_id % 50 = 0 then 'm2' else 'm1' end as model",
            "size(embedding) as dims",
            "embedding",
            f"case when vec_id % 11 <> 0 then {ts} else timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, cast(vec_id as decimal(18,6))) end as ts",
        )

    @cached_property
    def digests(self) -> DataFrame:
        """One digest for each day of three that cites items whose number 97 divides, in two threads."""
        cited = self.table("documents").where("doc_id % 97 = 0").select("doc_id").withColumn("day", F.expr("date_add(date'2024-01-20', cast(doc_id % 3 as int))"))
        even = F.array_sort(F.collect_list(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))))
        odd = F.array_sort(F.collect_list(F.when(F.col("doc_id") % 2 == 1, F.col("doc_id"))))
        made = cited.groupBy("day").agg(even.alias("even"), odd.alias("odd"), F.count("*").alias("item_count"))
        thread = lambda title, ids: F.struct(F.lit(title).alias("title"), F.lit("note").alias("note"), F.col(ids).alias("item_ids"))
        content = F.struct(F.lit("intro").alias("intro"), F.array(thread("even", "even"), thread("odd", "odd")).alias("threads"))
        return made.select("day", F.to_json(content).alias("content"), F.lit("m").alias("model"), "item_count")

    @cached_property
    def index(self) -> StoredIndex:
        """The index of the items' titles and texts, which need no labels, stored beside the session's other tables; one that is there for these files is used
        again, in this session or a later one with the same folder."""
        stamp = hashlib.sha256(self.dir.encode())
        for name in sorted(self.table("documents").inputFiles()):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            status = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place)
            stamp.update(f"{name} {status.getLen()} {status.getModificationTime()}".encode())
        found = StoredIndex.at(self.spark, f"{shared_dir(self.spark)}/search-index-{stamp.hexdigest()[:32]}")
        if not found.archive.version():
            found.update(added=self.bare_items)
        return found

    @cached_property
    def responses(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id",
            "ts",
            "user_id % 20 as feed_id",
            "concat('h', user_id % 30) as host",
            "case when user_id % 7 = 0 then 'agent/1' else '' end as agent",
            "case event_type when 'view' then 200 when 'click' then 403 when 'purchase' then 429 when 'signup' then 304 else case event_id % 3 when 0 then 500 when 1 then 404 else 200 end end as status",
            "case event_id % 6 when 0 then '120' when 1 then '-5' when 2 then 'soon' when 3 then '' when 4 then 'Mon, 05 Feb 2024 00:05:00 GMT' end as retry_after",
        )


SQL = f"""WITH feeds AS (
  SELECT id, 'https://' || source || '.example/feed' AS url, 'https://' || source || '.example/' AS site_url,
    CASE WHEN id % 3 <> 0 THEN source ELSE '' END AS title, CASE WHEN id % 5 = 0 THEN upper(source) END AS custom_title,
    CASE WHEN id % 4 <> 0 THEN 'data:image/png;base64,AA==' WHEN id % 8 = 0 THEN 'https://x.example/i.png' END AS icon,
    CAST(NULL AS VARCHAR) AS icon_url,
    id % 5 AS icon_attempts, CASE WHEN id % 2 = 0 THEN 'e' || id END AS etag,
    CASE WHEN id % 7 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS last_modified,
    CAST(NULL AS TIMESTAMP) AS last_fetch_at, TIMESTAMP '2024-02-04 00:00:00' + id * 3 * INTERVAL 1 HOUR AS next_fetch_at, 900 * (1 + id % 24) AS interval_s,
    id % 5 AS failures, id % 4 AS refusals, CASE WHEN id % 10 = 0 THEN 7200 END AS retry_after_s, nullif(60 * (id % 4), 0) AS ttl_minutes,
    CASE id % 5 WHEN 1 THEN 'Connection timed out' WHEN 2 THEN 'dns error' WHEN 3 THEN '404 not found' END AS last_error,
    id % 9 = 0 AS disabled, id % 6 <> 0 AS llm_enabled, CASE WHEN id % 8 = 0 THEN 'agent/1' END AS user_agent
  FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS BIGINT) AS id FROM documents)
), items AS (
  SELECT d.doc_id AS id, CAST(substring(source, 4) AS BIGINT) AS feed_id, 'g' || d.doc_id AS guid,
    CASE WHEN d.doc_id % 13 <> 0 THEN 'https://' || source || '.example/a/' || d.doc_id END AS url,
    replace(substring(text, 1, 60), chr(10), ' ') AS title,
    CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + d.doc_id * 37 * INTERVAL 1 MINUTE END AS published_at,
    TIMESTAMP '2024-02-01' + d.doc_id * INTERVAL 1 SECOND AS fetched_at, text AS content_text, n_chars < 400 AS truncated,
    d.doc_id % 4 = 0 AS extracted, d.doc_id % 5 AS extract_attempts,
    CASE d.doc_id % 5 WHEN 1 THEN 'Timeout while reading' WHEN 2 THEN 'no article' END AS extract_error,
    CASE WHEN d.doc_id % 2 = 0 THEN substring(replace(text, chr(10), ' '), 1, 120) END AS summary,
    40 + 35 * quality - 30 * toxic + d.doc_id % 20 AS score, [lang, 't' || d.doc_id % 7] AS tags,
    CASE WHEN d.doc_id % 2 = 0 THEN TIMESTAMP '2024-02-02' END AS enriched_at, d.doc_id % 4 AS enrich_attempts,
    CASE WHEN d.doc_id % 7 <> 0 THEN 'p' || d.doc_id % 3 END AS scored_profile,
    CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2024-02-03' END AS read_at,
    CASE WHEN d.doc_id % 10 = 0 THEN TIMESTAMP '2024-02-03 06:00:00' END AS starred_at,
    CASE d.doc_id % 25 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS feedback, d.doc_id % 4 AS embed_attempts, c.cluster_id,
    CASE d.doc_id % 6 WHEN 1 THEN 'Error sending request for url' WHEN 2 THEN 'model: operation timed out' WHEN 3 THEN 'no json, error sending request' END AS enrich_error,
    CASE d.doc_id % 5 WHEN 1 THEN 'error sending request' WHEN 2 THEN 'Operation timed out after 60 s' WHEN 3 THEN 'wrong size' END AS embed_error
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS cluster_id, count(*) OVER (PARTITION BY text) AS n FROM documents) c
    ON c.doc_id = d.doc_id AND c.n > 1
), vectors AS (
  SELECT vec_id AS item_id, CASE WHEN vec_id % 50 = 0 THEN 'm2' ELSE 'm1' END AS model, len(embedding) AS dims, embedding,
    CASE WHEN vec_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + vec_id * 37 * INTERVAL 1 MINUTE ELSE TIMESTAMP '2024-01-15' + vec_id * INTERVAL 1 SECOND END AS ts
  FROM embeddings
), cited AS (
  SELECT doc_id AS item_id, DATE '2024-01-20' + CAST(doc_id % 3 AS INTEGER) AS day, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS thread
  FROM documents WHERE doc_id % 97 = 0
), responses AS (
  SELECT event_id, ts, user_id % 20 AS feed_id, 'h' || user_id % 30 AS host, CASE WHEN user_id % 7 = 0 THEN 'agent/1' ELSE '' END AS agent,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'purchase' THEN 429 WHEN 'signup' THEN 304
      ELSE CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END END AS status,
    CASE event_id % 6 WHEN 0 THEN '120' WHEN 1 THEN '-5' WHEN 2 THEN 'soon' WHEN 3 THEN '' WHEN 4 THEN 'Mon, 05 Feb 2024 00:05:00 GMT' END AS retry_after
  FROM events
), sizes AS (SELECT cluster_id, count(*) AS n FROM items WHERE cluster_id IS NOT NULL GROUP BY cluster_id
), shown AS (SELECT id, coalesce(nullif(custom_title, ''), nullif(title, ''), url) AS feed_title FROM feeds
), listed AS (
  SELECT i.*, coalesce(published_at, fetched_at) AS recency, feed_title, coalesce(n, 1) AS cluster_size
  FROM items i JOIN shown f ON f.id = i.feed_id LEFT JOIN sizes s ON s.cluster_id = i.cluster_id
), heads AS (SELECT * FROM listed WHERE cluster_id IS NULL OR cluster_id = id)
"""
