"""State by host and day, the loop of ticks, and a reader that polls, embeds and clusters by itself."""

import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import state as S
from broadsheet.plans.views import Views
from broadsheet.schemas import FEEDS, ITEMS, schema
from broadsheet.store import StoredReader
from broadsheet.streaming import hosts, loop

SMALL = "/root/testdata/sf0.001"


def run(stream, tmp_path, name):
    """All there is, one file a batch."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_starts_lie_a_second_apart_over_batches(spark, tmp_path):
    """Equal to the batch form, however the tries are cut into batches, and state goes with its day."""
    rng = random.Random(2)
    rows = []
    for d in range(3):
        for k in range(40):
            rows.append((rng.choice("abc"), date(2024, 1, 1 + 3 * d), 100 * d + k, round(k * 0.3, 3)))
    tries = spark.createDataFrame(rows, "host string, day date, event_id long, asked_at double")
    for k, part in enumerate((rows[:25], rows[25:60], rows[60:])):
        spark.createDataFrame(part, tries.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    source = spark.readStream.schema(tries.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = run(hosts.pace_stream(source), tmp_path, "paced")
    got = {r["event_id"]: r["start_at"] for r in spark.table("paced").collect()}
    want = {r["event_id"]: r["start_at"] for r in S.paced(tries).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(held) >= 3 and held[-1] <= 2 * max(held[0], 8)


def test_ticks_go_on_when_one_fails():
    ran, now = [], datetime(2024, 1, 1)

    def fails(at):
        ran.append("bad")
        raise RuntimeError("boom")

    ticks = {"bad": loop.Tick(60, fails), "good": loop.Tick(60, lambda at: ran.append("good")), "slow": loop.Tick(3600, lambda at: ran.append("slow"))}
    it = loop.Loop(ticks, random.Random(1))
    gaps, last = [], now
    for s in range(0, 1200):
        if "good" in it.step(now + timedelta(seconds=s)):
            gaps.append((now + timedelta(seconds=s) - last).total_seconds())
            last = now + timedelta(seconds=s)
    assert ran.count("slow") == 1 and min(ran.count("bad"), ran.count("good")) >= 18 and ticks["bad"].failures == ran.count("bad")
    assert all(54 <= g <= 67 for g in gaps[1:]) and len(set(gaps[1:])) > 5


def test_the_loop_runs_as_a_stream(spark, tmp_path):
    ran = []

    def once(at):
        ran.append(at)
        if len(ran) == 1:
            raise RuntimeError("first one fails")

    query = loop.Loop({"t": loop.Tick(0.1, once)}).start(spark, str(tmp_path / "cp"), look_s=0.2)
    try:
        end = time.time() + 60
        while len(ran) < 3 and time.time() < end:
            time.sleep(0.2)
        assert len(ran) >= 3 and query.isActive and query.exception() is None
    finally:
        query.stop()


def test_at_most_so_many_feeds_are_asked_at_once(spark, tmp_path):
    asked = str(tmp_path)

    def fetch(feed):
        import os
        import time as t

        name = f"{asked}/{feed['id']}"
        open(f"{name}.on", "w").close()
        at_once = sum(f.endswith(".on") for f in os.listdir(asked))
        t.sleep(0.05)
        os.remove(f"{name}.on")
        if feed["id"] == 3:
            raise OSError("no route")
        return {"status": 200, "body": str(at_once), "etag": feed["etag"]}

    feeds = spark.createDataFrame([(k, f"https://f/{k}", None, None, None) for k in range(12)], "id long, url string, etag string, last_modified string, user_agent string")
    got = {r["feed_id"]: r for r in loop.fetched(feeds, fetch, 2).collect()}
    assert set(got) == set(range(12)) and got[3]["status"] is None and got[4]["status"] == 200 and got[4]["etag"] is None
    assert max(int(r["body"]) for r in got.values() if r["body"]) <= 2


WORDS = "python wheel tomato compost kernel".split()


def vectors_of(texts):
    return [[float(t.lower().count(w)) for w in WORDS] for t in texts]


RSS = '<rss version="2.0"><channel><title>{t}</title>{items}</channel></rss>'
ITEM = "<item><guid>{g}</guid><title>{title}</title><pubDate>{when}</pubDate><description>{body}</description></item>"


def reader_with(spark, path, n=3):
    reader = StoredReader(spark, str(path))
    row = {"interval_s": 1800, "failures": 0, "refusals": 0, "disabled": False, "llm_enabled": True, "icon_attempts": 0, "next_fetch_at": datetime(2024, 1, 1)}
    reader.start(spark.createDataFrame([tuple({**row, "id": k, "url": f"https://f{k}.example/feed"}.get(f.name) for f in schema(FEEDS)) for k in range(1, n + 1)], FEEDS))
    return reader


def feed(k, *stories):
    body = "".join(ITEM.format(g=f"{k}-{n}", title=title, when=f"Mon, 01 Jan 2024 0{n}:00:00 GMT", body=(title + " ") * 60) for n, title in enumerate(stories))
    return RSS.format(t=f"feed {k}", items=body)


def test_a_reader_that_polls_embeds_and_clusters(spark, tmp_path):
    """A feed that can't be reached costs the others nothing; stories that two feeds have share a head; a batch of
    later items joins the clusters that are there; one that is run again adds nothing."""
    bodies = {1: feed(1, "Python wheel", "Tomato compost"), 2: feed(2, "Python wheel!")}

    def fetch(asked):
        if asked["id"] == 3:
            raise OSError("down")
        return {"status": 200, "body": bodies[asked["id"]], "etag": "e"}

    reader = reader_with(spark, tmp_path / "r")
    it = loop.reading_loop(reader, fetch, vectors_of)
    now = datetime(2024, 1, 1, 12)
    assert it.step(now) == ["poll", "embed", "upkeep"]
    e = reader.engine()
    rows = {r["guid"]: r for r in e.items.collect()}
    assert len(rows) == 3 and e.vectors.count() == 3
    assert rows["1-0"]["cluster_id"] == rows["2-0"]["cluster_id"] is not None and rows["1-1"]["cluster_id"] is None
    head = rows["1-0"]["cluster_id"]
    failed = {r["id"]: r["failures"] for r in e.feeds.collect()}
    assert failed == {1: 0, 2: 0, 3: 1}
    bodies[2] = feed(2, "Python wheel!", "Compost for the tomato")
    assert it.step(now + timedelta(hours=8)) == ["poll", "embed", "upkeep"]
    rows = {r["guid"]: r for r in reader.engine().items.collect()}
    assert len(rows) == 4 and rows["1-0"]["cluster_id"] == head
    assert rows["2-1"]["cluster_id"] == rows["1-1"]["cluster_id"] is not None
    version = reader.archive.version()
    assert it.ticks["embed"].run(now + timedelta(hours=8)) is None and reader.archive.version() == version
    found = {r["id"] for r in reader.engine().list(query="tomato comp")[0].collect()}
    assert found == {rows["1-1"]["id"], rows["2-1"]["id"]}


@pytest.mark.parametrize("cuts", [(5,), (2, 3, 5)])
def test_clusters_are_the_same_over_any_batches(spark, tmp_path, cuts):
    """Groups whose members are all alike come out the same, however the items arrive."""
    titles = ["python wheel", "tomato compost", "python wheel", "kernel", "tomato compost"]
    reader = reader_with(spark, tmp_path / "r", 1)
    row = {"feed_id": 1, "extracted": True, "extract_attempts": 0, "enrich_attempts": 0, "embed_attempts": 0, "fetched_at": datetime(2024, 1, 1)}
    at = 0
    for cut in cuts:
        batch = [tuple({**row, "id": k, "guid": str(k), "title": titles[k], "content_text": titles[k] * 50}.get(f.name) for f in schema(ITEMS)) for k in range(at, cut)]
        commit = reader.archive.begin()
        commit.add("items", spark.createDataFrame(batch, ITEMS))
        commit.done()
        reader.embed(vectors_of, "2024-01-01 06:00:00")
        at = cut
    groups = {}
    for r in reader.engine().items.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 2], [1, 4], [3]]
    assert Views(spark, SMALL).feeds.count() > 0
    assert reader.engine().vectors.where(F.col("item_id") == 3).count() == 1
