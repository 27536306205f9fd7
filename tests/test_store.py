"""The archive's commits, its stored index, and the reader on top of both."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet import store
from broadsheet.operators import lists as L
from broadsheet.operators import search as X
from broadsheet.operators import state as S
from broadsheet.plans.views import NOW, Views
from broadsheet.sources import archive as A
from broadsheet.store import StoredReader

SMALL = "/root/testdata/sf0.001"
KV = {"t": A.Table("k long, v string", "k", ("k",)), "u": A.Table("k long, v string", "k")}


def kv(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def held(archive, name="t", version=None):
    return sorted((r["k"], r["v"]) for r in archive.read(name, version).collect())


def test_commits_show_whole_or_not_at_all(spark, tmp_path):
    archive = A.Archive(spark, str(tmp_path / "a"), KV)
    assert archive.version() == 0 and held(archive) == []
    first = archive.begin()
    first.add("t", kv(spark, [(1, "a"), (2, "b")]))
    first.add("u", kv(spark, [(9, "z")]))
    assert archive.version() == 0 and held(archive) == []
    assert first.done() == 1 and held(archive) == [(1, "a"), (2, "b")] and held(archive, "u") == [(9, "z")]
    lost = archive.begin()  # this one's writer is lost between two tables
    lost.change("t", kv(spark, [(1, "other")]))
    assert held(archive) == [(1, "a"), (2, "b")]
    second = archive.begin()
    second.change("t", kv(spark, [(1, "c"), (3, "d")]))
    second.delete("u", kv(spark, [(9, "")]))
    assert second.done() == 2
    assert held(archive) == [(1, "c"), (2, "b"), (3, "d")] and held(archive, "u") == []
    assert held(archive, version=1) == [(1, "a"), (2, "b")] and held(archive, "u", 1) == [(9, "z")]
    with pytest.raises(A.Conflict):
        lost.done()
    assert archive.version() == 2 and held(archive) == [(1, "c"), (2, "b"), (3, "d")]


def test_a_deleted_key_can_come_back(spark, tmp_path):
    archive = A.Archive(spark, str(tmp_path / "a"), KV)
    for change in (lambda c: c.add("t", kv(spark, [(1, "a"), (1, "again"), (2, None)])), lambda c: c.delete("t", kv(spark, [(1, ""), (None, ""), (7, "")])), lambda c: c.add("t", kv(spark, [(1, "b")]))):
        c = archive.begin()
        change(c)
        c.done()
    assert held(archive) == [(1, "b"), (2, None)] and held(archive, version=2) == [(2, None)]
    assert archive.compact("t", whole=True) and held(archive) == [(1, "b"), (2, None)]
    own = archive.manifest()["tables"]["t"]
    assert len(own["segments"]) == 1 and own["deletes"] == []


def test_compaction_equals_a_dictionary(spark, tmp_path):
    """Random adds, changes, deletes and compactions, against a plain dictionary; segments stay few."""
    import random

    rng, archive, want = random.Random(3), A.Archive(spark, str(tmp_path / "a"), KV), {}
    for step in range(9):
        c = archive.begin()
        fresh = [(step * 10 + k, f"s{step}") for k in range(rng.randint(1, 4))]
        c.add("t", kv(spark, fresh))
        moved = [(k, f"m{step}") for k in rng.sample(sorted(want), min(2, len(want)))]
        if moved:
            c.change("t", kv(spark, moved))
        gone = rng.sample(sorted(set(want) - dict(moved).keys()), min(1, len(want) - len(moved))) if len(want) > len(moved) else []
        if gone:
            c.delete("t", kv(spark, [(k, "") for k in gone]))
        c.done()
        want |= dict(fresh) | dict(moved)
        for k in gone:
            del want[k]
        if step % 3 == 2:
            archive.compact("t", whole=step == 8)
    assert held(archive) == sorted(want.items())
    assert len(archive.manifest()["tables"]["t"]["segments"]) < 6
    before = archive.vacuum()
    assert before > 0 and held(archive) == sorted(want.items()) and archive.vacuum() == 0


ITEMS = [(1, "Rust async", "the borrow checker"), (2, "Python wheels", "async things are many"), (3, "Café", "o'brien and the thing"), (4, None, None)]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "id long, title string, content_text string")


def found(index, query, **more):
    return sorted(r["id"] for r in index.ids(L.search_terms(query), **more).collect())


def test_searches_read_the_stored_index(spark, tmp_path):
    index = X.StoredIndex.at(spark, str(tmp_path / "i"))
    index.update(added=items(spark))
    cases = {"async": [1, 2], "the thing": [3], "thin": [2, 3], "cafe": [3], "o'brien": [3], "***": [], "the borr": [1], "async a": [1, 2], "missing the": []}
    for query, want in cases.items():
        assert found(index, query) == found(index, query, broadcast_ids=0) == want, query
    old = X.StoredIndex(index.archive, index.archive.version())
    index.update(changed=items(spark, [(1, "Go", "generics")]), gone=items(spark).where("id = 2"))
    assert found(index, "async") == [] and found(index, "gener") == [1] and found(index, "the") == [3]
    assert found(old, "async") == [1, 2]
    index.update(added=items(spark, [(2, "back", "async")]))
    assert found(index, "async") == [2] and index.counts(["the", "asy"]) == [2, 3]


WORDY = [
    *((k, f"Café {k % 7}", "the CAFE, the café; cafe\u0301 x²y " * 3) for k in range(300)),
    *((k, "ΟΔΟΣ İstanbul", " \u00a0—\n\tnaïve 한국 МАЙ 3٣½ e\u0301a") for k in range(300, 310)),
    (310, None, "...  "), (311, "", None), (312, None, None), (313, "same", "same Same ŚAMÉ"),
]


def test_texts_are_read_once_and_words_travel_in_runs(spark, tmp_path):
    """An index reads each item once, though its ranges are looked for first; a word travels a run at a time, and what is stored
    is what the plain expression says."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = items(spark, WORDY)
    index = X.StoredIndex.at(spark, str(tmp_path / "i"))
    index.update(added=rows.mapInArrow(counted, rows.schema))
    assert read.value == len(WORDY)
    want = sorted((r["token"], r["id"]) for r in X.postings(rows).collect())
    assert sorted((r["token"], r["id"]) for r in index.postings().collect()) == want and len(want) == len(set(want))
    counts = {r["token"]: r["items"] for r in index.archive.read(X.TERMS).collect()}
    assert counts == {t: sum(w == t for w, _ in want) for t in {w for w, _ in want}} and counts["cafe"] == counts["the"] == 300
    gathered = X.runs(rows.coalesce(1)).collect()
    assert sorted(len(r["id"]) for r in gathered if r["token"] == "cafe") == [44, 64, 64, 64, 64]
    assert not [p for p in (tmp_path / "i").iterdir() if p.name.startswith("staged")]


def test_runs_of_many_stretches_hold_each_posting_once(spark, monkeypatch):
    rows = items(spark, WORDY).coalesce(1)
    batch = rows.select("id", F.concat_ws(" ", X.T.spaced(F.col("title")), X.T.spaced(F.col("content_text"))).alias("words")).toArrow().to_batches()
    monkeypatch.setattr(X, "RUN_BYTES", 1)
    parts = list(X._runs(iter(batch)))
    assert len(parts) == 2
    got = sorted((t, i) for p in parts for t, ids in zip(p["token"].to_pylist(), p["id"].to_pylist(), strict=True) for i in ids)
    assert got == sorted((r["token"], r["id"]) for r in X.postings(rows).collect())
    assert all(1 <= len(ids) <= X.RUN_IDS for p in parts for ids in p["id"].to_pylist())


def test_index_compacts_and_keeps_what_it_found(spark, tmp_path):
    index = X.StoredIndex.at(spark, str(tmp_path / "i"))
    for k in range(10):
        index.update(added=items(spark, [(10 + k, f"word{k % 3}", "all of them")]), gone=items(spark, [(8 + k, "", "")]))
    assert found(index, "all") == [18, 19] and found(index, "word1") == [] and found(index, "word0 th") == [19]
    tables = index.archive.manifest()["tables"]
    assert all(len(tables[t]["segments"]) <= X.MOST_SEGMENTS for t in (X.POSTINGS, X.TERMS))


def test_a_search_reads_its_words_row_groups(spark, tmp_path):
    """The condition on words is pushed to the scan, and most row groups are left out by their bounds."""
    v = Views(spark, "/root/testdata/sf0.01")
    index = X.StoredIndex.at(spark, str(tmp_path / "i"))
    index.update(added=v.plain_items)
    rows = index.postings().where(F.col("token") == "the")
    assert "EqualTo(token,the)" in rows._jdf.queryExecution().executedPlan().toString()
    import pyarrow.parquet as pq

    path = index.archive.manifest()["tables"][X.POSTINGS]["segments"][0]["path"]
    files = sorted((tmp_path / "i" / path).glob("*.parquet"))
    groups = [m.row_group(k).column(0).statistics for m in map(pq.read_metadata, files) for k in range(m.num_row_groups)]
    bounds = [(g.min, g.max) for g in groups]
    assert len(bounds) > 1 and sum(a <= "the" <= b for a, b in bounds) <= (len(bounds) + 1) // 2
    assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in X.postings(v.plain_items).where("token = 'the'").collect())


RSS = """<rss version="2.0"><channel><title>New name</title><link>https://site.example/</link><ttl>120</ttl><image><url>https://site.example/i.png</url></image>
<item><guid>{g}-1</guid><title>First {g}</title><description>alpha words</description></item><item><guid>{g}-2</guid><title>Second {g}</title><description>beta words</description></item></channel></rss>"""


@pytest.fixture
def reader(spark, tmp_path):
    v = Views(spark, SMALL)
    r = StoredReader(spark, str(tmp_path / "store"))
    r.start(v.feeds, v.items, v.vectors, v.digests)
    return r


def responses(spark, rows):
    return spark.createDataFrame(rows, "feed_id long, url string, status int, body string, etag string, last_modified string, retry_after string")


POLLED = [(1, "https://a/f", 200, RSS.format(g="x"), "e9", None, None), (2, "https://b/f", 304, None, None, None, None), (3, "https://c/f", 403, None, None, None, None), (4, "https://d/f", 200, "<html>", None, None, None), (5, "https://e/f", 429, None, None, None, "7200")]


def test_a_poll_is_one_commit(spark, reader, monkeypatch):
    """Items, feeds, postings and events together; a writer lost before the manifest leaves the old state, and its batch
    run again counts once."""
    state = lambda: (reader.archive.version(), reader.engine().items.count(), {r["id"]: (r["title"], r["etag"], r["last_modified"], r["failures"]) for r in reader.engine().feeds.collect()}, reader.archive.read("events").count(), found(reader.index, "alpha"))
    before = state()
    real = A.Commit.done
    monkeypatch.setattr(A.Commit, "done", lambda self, *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        reader.record_polls(responses(spark, POLLED), NOW, 7)
    monkeypatch.setattr(A.Commit, "done", real)
    assert state() == before
    assert reader.record_polls(responses(spark, POLLED), NOW, 7) == before[0] + 1
    after = state()
    assert after[1] == before[1] + 2 and after[2][1] == ("New name", "e9", None, 0) and len(after[4]) == 1
    feeds = {r["id"]: r for r in reader.engine().feeds.collect()}
    assert (feeds[1]["ttl_minutes"], feeds[1]["site_url"], feeds[1]["icon_url"]) == (120, "https://site.example/", "https://site.example/i.png")
    assert feeds[4]["last_error"] == "not a feed" and feeds[5]["retry_after_s"] == 7200 and feeds[3]["last_error"] == "status 403"
    assert all(feeds[i]["last_fetch_at"] == datetime.fromisoformat(NOW) for i in range(1, 6)) and feeds[6]["last_fetch_at"] is None
    told = sorted((r["kind"], r["feed_id"], r["count"]) for r in reader.archive.read("events").collect())
    assert told == [("feed-updated", i, None) for i in range(2, 6)] + [("items-new", 1, 2)]
    assert reader.record_polls(responses(spark, POLLED), NOW, 7) is None and reader.archive.version() == after[0]
    reader.record_polls(responses(spark, [(1, "https://a/f", 200, RSS.format(g="x").replace("x-2", "x-3"), None, "Tue", None)]), NOW, 8)
    assert reader.engine().items.count() == after[1] + 1
    assert reader.engine().items.groupBy("id").count().where("count > 1").count() == 0
    twice = spark.createDataFrame([(1, "https://a/f", 200, RSS.format(g="y"), "e10", 3), (1, "https://a/f", None, None, None, 4), (2, "https://b/f", 200, RSS.format(g="z"), None, 4)], "feed_id long, url string, status int, body string, etag string, poll long")
    reader.record_polls(twice, NOW, 9)
    e = reader.engine()
    assert e.items.count() == after[1] + 5 and e.feeds.count() == len(feeds)
    assert {r["id"]: (r["failures"], r["last_error"]) for r in e.feeds.collect() if 0 < r["id"] < 3} == {1: (1, "no answer"), 2: (0, None)}
    assert e.items.groupBy("id").count().where("count > 1").count() == 0


def test_deletes_reach_items_vectors_and_index(spark, reader):
    v = Views(spark, SMALL)
    from broadsheet.operators import digests as D

    cutoff = "2024-01-04 00:00:00"
    victims = {r["id"] for r in D.retention_victims(v.items, v.digests, cutoff, None).collect()}
    items_left, vectors_left = D.prune(v.items, v.vectors, D.retention_victims(v.items, v.digests, cutoff, None))
    assert victims
    reader.prune(cutoff, None)
    e = reader.engine()
    assert {(r["id"], r["cluster_id"]) for r in e.items.select("id", "cluster_id").collect()} == {(r["id"], r["cluster_id"]) for r in items_left.select("id", "cluster_id").collect()}
    assert {r["item_id"] for r in e.vectors.collect()} == {r["item_id"] for r in vectors_left.collect()}
    assert {r["id"] for r in reader.index.postings().collect()}.isdisjoint(victims)
    reader.delete_feed(3)
    e = reader.engine()
    assert e.items.where("feed_id = 3").count() == 0 and e.feeds.where("id = 3").count() == 0
    whole = {r["id"] for r in e.items.collect()}
    assert {r["id"] for r in reader.index.postings().collect()} <= whole
    reader.upkeep(most=1)
    assert {r["id"] for r in reader.engine().items.collect()} == whole


def test_searches_through_the_reader_equal_plain_ones(spark, reader):
    e = reader.engine()
    for query in ("The thing", "of the", "zz"):
        plain = {r["id"] for r in L.list_items(e.items, e.feeds, query=query).collect()}
        assert {r["id"] for r in e.list(query=query)[0].where("true").collect()} <= plain
        assert {r["id"] for r in L.list_items(e.items, e.feeds, query=query, index=e.index).collect()} == plain


def test_marking_writes_only_what_changes(spark, reader):
    v = Views(spark, SMALL)
    old = reader.archive.version()
    reader.mark_read(NOW, F.col("feed_id") == 3)
    want = {(r["id"], r["read_at"]) for r in S.mark_read(v.items, F.col("feed_id") == 3, NOW).collect()}
    assert {(r["id"], r["read_at"]) for r in reader.engine().items.collect()} == want
    segment = reader.archive.manifest()["tables"]["items"]["segments"][-1]
    assert 0 < segment["rows"] < 60
    assert {(r["id"], r["read_at"]) for r in reader.engine(old).items.collect()} == {(r["id"], r["read_at"]) for r in v.items.collect()}


def test_numbers_are_consecutive(spark):
    rows = store.numbered(spark.range(0, 1000, 1, 7).where("id % 3 = 0").withColumnRenamed("id", "x"), 50)
    got = [r["id"] for r in rows.orderBy("x").collect()]
    assert got == list(range(50, 50 + 334))
    assert store.numbered(spark.range(0).withColumnRenamed("id", "x"), 1).collect() == []
