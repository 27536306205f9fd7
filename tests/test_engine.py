from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.engine import Engine, embedded, enriched
from broadsheet.operators import digests as D
from broadsheet.operators import state as S
from broadsheet.plans.views import Views
from broadsheet.schemas import PARSED_ITEM, schema
from broadsheet.sources.snapshots import Log, Snapshots
from broadsheet.streaming import hosts as HOSTS
from broadsheet.streaming import ingest as I
from broadsheet.streaming import ticks as TICKS

SMALL = "/root/testdata/sf0.001"
RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>News</title><link>https://site.example/</link><ttl>45</ttl>
<item><title>One &amp; two</title><link>/a</link><guid>g-1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;Hello &lt;b&gt;world&lt;/b&gt;&lt;/p&gt;&lt;script&gt;x()&lt;/script&gt;</description></item>
<item><title>Talk</title><link>https://site.example/b</link><comments>https://talk.example/?a=1&amp;b=2</comments><description><![CDATA[<a href="https://talk.example/">Comments</a>]]></description></item></channel></rss>"""
WORDS = "harbour ferry timetable violin quartet rehearsal glacier meltwater".split()


def bag(texts):
    return [[float(t.lower().split().count(w)) for w in WORDS] for t in texts]


@pytest.fixture(scope="module")
def engine(spark):
    at = datetime(2024, 1, 1, 12)
    feeds = spark.createDataFrame([(1, "https://a/f", "A", None, False, True), (2, "https://b/f", "", None, False, True)], "id long, url string, title string, custom_title string, disabled boolean, llm_enabled boolean")
    rows = [
        (1, 1, "New ferry timetable", "the harbour ferry sails hourly", at, None, ["coast"]),
        (2, 2, "Ferry timetable out", "a harbour ferry every hour", at, None, ["coast"]),
        (3, 1, "Quartet in town", "the violin quartet opens its rehearsal", at, None, ["music"]),
    ]
    items = spark.createDataFrame(rows, "id long, feed_id long, title string, content_text string, published_at timestamp_ntz, read_at timestamp_ntz, tags array<string>").selectExpr(
        "*", "published_at as fetched_at", "cast(null as timestamp_ntz) as starred_at", "cast(null as long) as cluster_id", "cast(90 as long) as score", "concat('https://x/', id) as url",
        "true as extracted", "false as truncated", "0 as extract_attempts", "0 as embed_attempts", "cast(null as string) as summary",
    )
    vectors = spark.createDataFrame([], "item_id long, model string, embedding array<float>")
    digests = spark.createDataFrame([], "day date, content string")
    e = Engine(feeds, items, vectors, digests, embedder=bag)
    return Engine(feeds, items, e.embed(), digests, embedder=bag)


def test_clusters_collapse_lists_but_not_searches(engine):
    e = engine.cluster(0.9)
    listed = {r["id"]: r["cluster_size"] for r in e.list()[0].collect()}
    assert sorted(listed.values()) == [1, 2] and len(e.list(query="harbour")[0].collect()) == 2
    assert len(engine.cluster(1.0).list()[0].collect()) == 3
    assert e.list(query="***")[0].count() == 0


def test_semantic_search_and_fallback(engine):
    rows, mode = engine.list(query="violin quartet", mode="semantic")
    assert mode == "semantic" and [r["id"] for r in rows.collect()] == [3]

    def gone(texts):
        raise OSError("no model")

    from dataclasses import replace

    assert replace(engine, embedder=gone).list(query="rehearsal", mode="semantic")[1] == "text"


def test_mark_read_takes_whole_clusters(engine):
    e = engine.cluster(0.9)
    after = e.mark_read("2024-01-02 00:00:00", feed_id=2)
    assert {r["id"] for r in after.items.where("read_at is not null").collect()} == {1, 2}
    assert e.mark_read("2024-01-02 00:00:00", query="***").items.where("read_at is not null").count() == 0
    assert e.mark_read("2024-01-02 00:00:00").items.where("read_at is null").count() == 0


def test_topics_need_three(engine):
    assert engine.topics().count() == 0


def test_prune_keeps_starred_cited_and_reelects_heads(spark):
    v = Views(spark, SMALL)
    victims = D.retention_victims(v.items, v.digests, "2024-01-20 00:00:00")
    items, vectors = D.prune(v.items, v.vectors, victims)
    gone = {r["id"] for r in victims.collect()}
    kept = items.collect()
    ids = {r["id"] for r in kept}
    assert gone and not gone & ids and all(r["starred_at"] is None or r["id"] in ids for r in v.items.collect())
    assert all(r["cluster_id"] is None or r["cluster_id"] in ids for r in kept)
    assert vectors.where(F.col("item_id").isin(list(gone))).count() == 0


def test_upsert_is_idempotent(spark):
    v = Views(spark, SMALL)
    again = v.plain_items.select("feed_id", "guid", F.col("id").alias("pos"))
    assert S.insert_missing(v.plain_items, again, ["feed_id", "guid"], "pos").count() == 0


def test_pages_partition_the_list(spark):
    from broadsheet.operators import lists as L

    v = Views(spark, SMALL)
    items, seen, cursor = v.items.cache(), [], None
    while True:
        page = L.list_items(items, v.feeds, cursor=cursor, limit=60).select("id").join(items, "id").select("id", F.coalesce("published_at", "fetched_at").alias("r")).collect()
        seen += [r["id"] for r in page]
        if len(page) < 60:
            break
        last = min((r["r"], r["id"]) for r in page)
        cursor = L.make_cursor(*last)
    assert len(seen) == len(set(seen)) == L.list_items(items, v.feeds).count()


def test_enrichment_outcomes(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "down"), (3, "junk")], "id long, prompt string")

    def model(system, prompt):
        if prompt == "down":
            raise ConnectionError
        return '{"summary": "s", "tags": ["X"], "score": 5, "reason": "r"}' if prompt == "good" else "no"

    got = {r["id"]: r["outcome"] for r in enriched(prompts, model, "sys").collect()}
    assert got == {1: "ok", 2: "unreachable", 3: "failed"}


def test_embedder_failures_leave_nulls(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    assert embedded(rows, lambda texts: [], "m").first()["embedding"] is None


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, known = tmp_path / "in", Log(spark, str(tmp_path / "items"), schema("feed_id long, " + PARSED_ITEM), "feed_id")
    events = Snapshots(spark, str(tmp_path / "events"), schema(I.EVENT + ", batch long"))
    rows = spark.createDataFrame([(1, "https://site.example/feed", RSS), (2, "https://gone.example/feed", "<html>")], "feed_id long, url string, body string")
    rows.coalesce(1).write.parquet(str(source))
    run = lambda: I.ingest(I.responses_of(spark, str(source), rows.schema, 1), known, str(tmp_path / "cp"), events, once=True).awaitTermination(120)
    told = lambda: sorted((r["kind"], r["feed_id"], r["count"]) for r in events.read().collect())
    run()
    assert known.read().count() == 2 and told() == [("feed-updated", 2, None), ("items-new", 1, 2)]
    rows.coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert known.read().count() == 2 and told() == [("feed-updated", 1, None), ("feed-updated", 2, None)]
    # Run again, the batches leave what they left before.
    for batch in (0, 1):
        I.ingest_batch(rows, known, batch)
        assert known.of(batch).count() == 2 * (batch == 0)
    assert known.read(keys=rows.select("feed_id").where("feed_id = 2")).count() == 0 and known.read(before=0).count() == 0


def test_late_items_are_kept(spark, tmp_path):
    known = Log(spark, str(tmp_path / "items"), schema("feed_id long, " + PARSED_ITEM), "feed_id")
    for batch, year in enumerate(("2024", "1999")):
        body = RSS.replace("01 Jan 2024", f"01 Jan {year}").replace("g-1", f"g-{year}")
        I.ingest_batch(spark.createDataFrame([(1, "https://site.example/feed", body)], "feed_id long, url string, body string"), known, batch)
    assert {r["guid"] for r in known.read().collect()} >= {"g-2024", "g-1999"}


def test_events_patch_rows_in_place(spark, engine):
    answers = spark.createDataFrame([(1, ("s1", ["a"], 70, "why")), (2, None)], "id long, answer struct<summary:string,tags:array<string>,score:int,reason:string>")
    first = I.items_enriched(answers).withColumn("batch", F.lit(1).cast("long"))
    later = first.withColumn("batch", F.lit(2).cast("long")).withColumn("score", F.lit(20).cast("long")).withColumn("summary", F.lit(None).cast("string"))
    assert [(r["kind"], r["item_id"], r["score_reason"]) for r in first.collect()] == [("item-enriched", 1, "why")]
    items = engine.items.withColumn("score_reason", F.lit(None).cast("string")).withColumn("summary", F.lit("s0"))
    got = {r["id"]: (r["summary"], r["score"], r["score_reason"]) for r in I.patched(items, first.unionByName(later)).collect()}
    assert got == {1: (None, 20, "why"), 2: ("s0", 90, None), 3: ("s0", 90, None)}
    got = {r["id"]: (r["summary"], r["score"]) for r in I.patched(items, later.withColumn("batch", F.lit(0).cast("long")).unionByName(first)).collect()}
    assert got[1] == ("s1", 70)
    bare = I.patched(items, first.withColumn("tags", F.lit(None).cast("array<string>"))).where("id = 1").first()
    assert (bare["tags"], bare["summary"]) == ([], "s1")
    assert I.newest_events(first.unionByName(later), 1).first()["batch"] == 2


def test_refusal_stream_equals_batch(spark, tmp_path):
    tries = Views(spark, SMALL).responses.select(
        "event_id", "host", "agent", F.to_date("ts").alias("day"), F.col("status").isin(*S.REFUSED).alias("refused"), F.col("status").between(200, 299).alias("succeeded")
    )
    tries.coalesce(1).sortWithinPartitions("event_id").write.parquet(str(tmp_path / "t"))
    stream = HOSTS.refusal_stream(spark.readStream.schema(tries.schema).parquet(str(tmp_path / "t")))
    q = stream.writeStream.format("memory").queryName("refusals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["event_id"], r["retired"]) for r in spark.table("refusals").collect()}
    assert got == {(r["event_id"], r["retired"]) for r in S.host_refusals(tries).collect()} and any(r for _, r in got)


# --- pages in order, cursors, the index -----------------------------------------------------------------


def test_pages_come_in_order(spark):
    from broadsheet.operators import lists as L

    v = Views(spark, SMALL)
    at = {r["id"]: (r["score"], r["at"]) for r in v.plain_items.select("id", "score", F.coalesce("published_at", "fetched_at").alias("at")).collect()}
    by_time = [r["id"] for r in L.list_items(v.items, v.feeds, "all", limit=150).collect()]
    assert by_time == sorted(by_time, key=lambda i: (at[i][1], i), reverse=True) and len(by_time) == 150
    best = [r["id"] for r in L.list_items(v.items, v.feeds, "interesting", limit=150).collect()]
    assert best == sorted(best, key=lambda i: (at[i][0], at[i][1], i), reverse=True)
    day = [(r["score"] if r["score"] is not None else -1, r["recency"], r["id"]) for r in D.candidates(v.items, v.feeds, "2024-01-03").collect()]
    assert day == sorted(day, reverse=True)
    ids = spark.createDataFrame([(0, 5), (1, 3), (2, 9), (3, 1)], "pos int, id long")
    assert [r["id"] for r in L.by_ids(v.plain_items.select("id", "title"), ids).collect()] == [5, 3, 9, 1]


def test_cursors_lead_through_the_archive(spark):
    v = Views(spark, SMALL)
    e = Engine(v.feeds, v.items.cache(), v.vectors, v.digests)
    seen, cursor = [], None
    while True:
        page = e.page("all", cursor=cursor, limit=45)
        seen += [r["id"] for r in page.rows]
        if page.next_cursor is None:
            break
        cursor = page.next_cursor
    assert len(seen) == len(set(seen)) == e.list("all", limit=200)[0].count()
    assert e.page("interesting", limit=2).next_cursor is None and e.page("unread", limit=200).next_cursor is None
    assert e.page("interesting", query="the", limit=2).next_cursor is not None


def test_the_index_is_kept_up(spark, engine):
    from dataclasses import replace

    from broadsheet.operators import search as X

    e = replace(engine, index=X.postings(engine.items))
    new = engine.items.where("id = 3").withColumn("id", F.lit(4).cast("long")).withColumn("title", F.lit("Ferry Übersicht")).withColumn("guid", F.lit("g4"))
    e = replace(e, items=e.items.withColumn("guid", F.concat(F.lit("g"), F.col("id")))).add_items(new)
    found = lambda q: {r["id"] for r in e.list(query=q)[0].collect()}
    assert found("ferry") == {1, 2, 4} and found("ferry uber") == {4} and found("ferry harb") == {1, 2} and found("***") == set()
    for q in ("ferry", "quartet vio", "the h"):
        assert found(q) == {r["id"] for r in replace(e, index=None).list(query=q)[0].collect()}


@pytest.mark.parametrize("query, text, found", [("한국", "오늘 한국 소식", True), ("май", "майский май", True), ("σήμερα", "Σήμερα νέα", True), ("café", "CAFE noir", True), ("cafe", "le café", True), ("маи", "май", False)])
def test_search_folds_query_and_text_alike(spark, query, text, found):
    from broadsheet.operators import lists as L

    rows = spark.createDataFrame([(text,)], "t string")
    assert (rows.where(L.matches(L.search_terms(query), F.col("t"), F.lit(""))).count() == 1) == found


# --- ticks ------------------------------------------------------------------------------------------------


def test_digest_tick(spark):
    v = Views(spark, SMALL)
    e = Engine(v.feeds, v.items, v.vectors, v.digests)
    asked = []

    def write(rows, day):
        asked.append(day)
        ids = [r["id"] for r in rows.collect()]
        content = '{"intro": "i", "threads": [{"title": "t", "note": "n", "item_ids": [%d, 999999, %d]}, {"title": "u", "note": "n", "item_ids": [888888]}]}' % (ids[1], ids[0])
        return spark.createDataFrame([(datetime(2024, 1, 3).date(), content, "m", len(ids))], "day date, content string, model string, item_count long")

    def gone(rows, day):
        raise OSError

    now = datetime(2024, 1, 4, 7)
    assert TICKS.digest_tick(e, now, 8, write) is e and not asked
    assert TICKS.digest_tick(e, now, 6, gone) is e
    after = TICKS.digest_tick(e, now, 6, write)
    rows = D.threads(after.digests.where("day = date'2024-01-03'")).collect()
    assert asked == ["2024-01-03"] and len(rows) == 2 and {r["title"] for r in rows} == {"t"}
    assert TICKS.digest_tick(after, now, 6, write) is after and asked == ["2024-01-03"]
    assert TICKS.digest_tick(e, datetime(2023, 1, 4, 7), 6, write) is e


def test_retention_tick(spark):
    v = Views(spark, SMALL)
    e = Engine(v.feeds, v.items.drop("cluster_size"), v.vectors, v.digests)
    now = datetime(2024, 2, 1)
    assert TICKS.retention_tick(e, now, 0) is e
    kept = e.items.count()
    assert TICKS.retention_tick(e, now, 12, most=5).items.count() == kept - 5
    assert TICKS.poll_batch(v.feeds, datetime(2024, 2, 6), 3).count() == 3


def test_new_items_join_the_clusters_there_are(engine):
    """A late report of a story joins its cluster; one outside the window founds none."""
    e = engine.cluster(0.9)
    head = {r["id"]: r["cluster_id"] for r in e.items.collect()}[1]
    rows = engine.items.where("id = 1").withColumn("cluster_id", F.lit(None).cast("long"))
    late = rows.withColumn("id", F.lit(7).cast("long")).withColumn("published_at", F.expr("timestamp_ntz'2023-12-31 06:00:00'"))
    old = rows.withColumn("id", F.lit(8).cast("long")).withColumn("published_at", F.expr("timestamp_ntz'2023-06-01 00:00:00'"))
    vector = e.vectors.where("item_id = 1")
    from dataclasses import replace

    more = replace(e, items=e.items.unionByName(late).unionByName(old), vectors=e.vectors.unionByName(vector.withColumn("item_id", F.lit(7).cast("long"))).unionByName(vector.withColumn("item_id", F.lit(8).cast("long"))))
    after = TICKS.dedupe_tick(more, more.vectors.where("item_id in (7, 8)").select("item_id"), datetime(2024, 1, 2))
    got = {r["id"]: r["cluster_id"] for r in after.items.collect()}
    assert got[7] == head and got[8] is None and {i: got[i] for i in (1, 2)} == {1: head, 2: head}


def test_tiles_and_cells_cover_all_pairs(spark, monkeypatch):
    from broadsheet.operators import vectors as V

    monkeypatch.setattr(V, "TILE", 20)
    monkeypatch.setattr(V, "GRID", 2)
    v = Views(spark, SMALL)
    got = V.similar_pairs(v.vectors, 0.3).collect()
    rows = v.vectors.collect()
    want = set()
    for k, a in enumerate(rows):
        for b in rows[:k]:
            if a["model"] == b["model"] and abs((a["ts"] - b["ts"]).total_seconds()) <= 72 * 3600 and sum(x * y for x, y in zip(a["embedding"], b["embedding"], strict=True)) >= 0.3:
                want.add((min(a["item_id"], b["item_id"]), max(a["item_id"], b["item_id"])))
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]) for r in got} == want


# --- stores and pages ---------------------------------------------------------------------------------------


def test_settings_are_stored_within_bounds(engine):
    got = {r["key"]: r["value"] for r in engine.set({"digest_hour": 30, "retention_days": 2}).set({"digest_hour": 5}).settings().collect()}
    assert got == {"digest_hour": 5.0, "retention_days": 7.0, "score_threshold": 65.0, "dedupe_threshold": 0.9}


def test_vectors_are_recorded(engine):
    found = engine.vectors.limit(1).sparkSession.createDataFrame([(1, "m2", [1.0], False), (2, "m2", None, False), (3, "m2", None, True)], "item_id long, model string, embedding array<float>, unreachable boolean")
    after = engine.record_vectors(found, "2024-01-02 00:00:00")
    assert {r["id"]: r["embed_attempts"] for r in after.items.collect()} == {1: 0, 2: 1, 3: 0}
    assert {r["item_id"]: r["model"] for r in after.vectors.collect()} == {1: "m2", 2: "m1", 3: "m1"}


def test_articles_keep_harmless_markup_and_say_why_not(spark):
    from broadsheet.sources.pages import articles

    body = "<p>" + "plain words of an article " * 12 + '<a href="/x" onclick="y()">link</a><script>z()</script></p>'
    page = f"<html><nav>menu</nav><article>{body}<aside>more</aside></article><footer>end</footer></html>"
    rows = [(1, "https://a.example/1", page, None), (2, "http://127.0.0.1/x", page, None), (3, "https://a.example/3", page, "application/pdf"), (4, "https://a.example/4", "<p>short</p>", "text/html; charset=utf-8"), (5, "http://[::1]/", None, None), (6, "https://a.example/6", "x" * (3 << 20), ""), (7, None, None, None)]
    got = {r["page_id"]: r for r in articles(spark.createDataFrame(rows, "page_id long, url string, html string, kind string"), type_col="kind").collect()}
    assert got[1]["error"] is None and "menu" not in got[1]["html"] and "more" not in got[1]["html"] and "script" not in got[1]["html"] and "onclick" not in got[1]["html"]
    assert 'href="https://a.example/x"' in got[1]["html"] and got[1]["text"].startswith("plain words")
    assert [got[i]["error"] for i in range(2, 8)] == ["address not public", "not html: application/pdf", "no article", "address not public", "too large", "no article"]


def test_a_new_agent_gives_items_their_attempts_back(spark, engine):
    """Only those of the feed, only those not extracted; a patch without an agent gives none; a blank agent is none."""
    items = engine.items.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (("extract_attempts", "int"), ("extract_error", "string"), ("extracted", "boolean")) if c not in engine.items.columns))
    items = items.withColumns({"extract_attempts": F.lit(3), "extract_error": F.lit("403"), "extracted": F.col("id") == 1})
    patch = lambda agent: spark.createDataFrame([(1, None, agent, None, None)], "feed_id long, set_title string, set_agent string, set_disabled boolean, set_llm boolean")
    of = lambda e: {r["id"]: (r["extract_attempts"], r["extract_error"]) for r in e.items.collect()}
    feed = {r["id"]: r["feed_id"] for r in items.collect()}
    more = {"user_agent": F.lit(None).cast("string"), "failures": F.lit(0), "refusals": F.lit(0), "next_fetch_at": F.lit(None).cast("timestamp_ntz")}
    before = replace(engine, feeds=engine.feeds.withColumns({c: v for c, v in more.items() if c not in engine.feeds.columns}), items=items)
    assert of(before.patch_feeds(patch(None), "2024-01-01 00:00:00")) == dict.fromkeys(feed, (3, "403"))
    for agent, kept in ((" reader/2 ", "reader/2"), ("  ", None)):
        after = before.patch_feeds(patch(agent), "2024-01-01 00:00:00")
        assert of(after) == {i: (0, None) if f == 1 and i != 1 else (3, "403") for i, f in feed.items()}
        assert {r["id"]: r["user_agent"] for r in after.feeds.collect()}[1] == kept


def test_cursors_keep_parts_of_a_second(spark):
    """Items fetched within one second, a page of one at a time: none is skipped, none comes twice."""
    from broadsheet.operators import lists as L

    at = [datetime(2024, 1, 1, 10, 0, 0, k) for k in (0, 1, 1, 999_999)]
    assert [L.parse_cursor(L.make_cursor(t, 7)) for t in at] == [(t, 7) for t in at]
    assert L.make_cursor(at[0], 42) == "2024-01-01T10:00:00Z|42"
    rows = spark.createDataFrame([(k, 1, t) for k, t in enumerate(at)], "id long, feed_id long, fetched_at timestamp_ntz")
    null = lambda kind: F.lit(None).cast(kind)
    items = rows.withColumns({"published_at": null("timestamp_ntz"), "read_at": null("timestamp_ntz"), "starred_at": null("timestamp_ntz"), "cluster_id": null("long"), "score": null("long"), "tags": null("array<string>"), "title": F.lit("t"), "url": F.lit("u")})
    feeds = spark.createDataFrame([(1, "f", "F", None)], "id long, url string, title string, custom_title string")
    seen, cursor = [], None
    while True:
        page = L.list_items(items, feeds, cursor=cursor, limit=1).collect()
        if not page:
            break
        seen.append(page[0]["id"])
        cursor = L.make_cursor(at[seen[-1]], seen[-1])
    assert seen == [3, 2, 1, 0]


def test_tiles_are_copied_a_bounded_number_of_times(spark, monkeypatch):
    """In a bucket of many tiles the grid has few cells a side; with and without new items, pairs and best partners are those
    that all comparisons find."""
    from pyspark.sql import DataFrame

    from broadsheet.operators import vectors as V

    r = np.random.default_rng(3)
    v = r.standard_normal((600, 8))
    v = np.round(v / np.linalg.norm(v, axis=1)[:, None] * 4) / 4
    rows = [(i, "m", [float(x) for x in v[i]], int(r.integers(0, 40))) for i in range(600)]
    vectors = spark.createDataFrame(rows, "item_id long, model string, embedding array<float>, turn long").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    copies, real = [], V.written
    monkeypatch.setattr(V, "TILE", 10)
    monkeypatch.setattr(V, "GRID", 1)
    monkeypatch.setattr(V, "MOST_CELLS", 3)

    def seen(df: DataFrame) -> DataFrame:
        out = real(df)
        if out.columns == ["model", "bucket", "cells"]:
            copies.extend(x["cells"] for x in out.collect())
        return out

    monkeypatch.setattr(V, "written", seen)
    new = {i for i in range(600) if i % 4 == 1}
    fresh = vectors.where("item_id % 4 = 1").select("item_id")
    near = np.round(v @ v.T, 6)
    every = {(i, j) for i in range(600) for j in range(i + 1, 600) if near[i, j] >= 0.8}
    assert {(x["a"], x["b"]) for x in V.similar_pairs(vectors, 0.8).collect()} == every
    assert {(x["a"], x["b"]) for x in V.similar_pairs(vectors, 0.8, fresh=fresh).collect()} == {p for p in every if new & set(p)}
    best: dict = {}
    for x in V.similar_pairs(vectors, 0.8, fresh=fresh, turn="turn").collect():
        best[x["a"]] = max(best.get(x["a"], (-1.0, 0)), (x["similarity"], -x["b"]))
    turn = {x[0]: (x[3], x[0]) for x in rows}
    want = {}
    for i in new:
        found = [(near[i, j], -j) for j in range(600) if j != i and near[i, j] >= 0.8 and (j not in new or turn[j] > turn[i])]
        if found:
            want[i] = max(found)
    assert best.keys() == want.keys() and all(abs(best[i][0] - want[i][0]) < 1e-5 and best[i][1] == want[i][1] for i in want)
    assert copies and max(copies) == 3
