"""Subscriptions and events over a server of our own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from broadsheet.sources import fetch as FETCH
from broadsheet.sources import web
from broadsheet.store import StoredReader
from broadsheet.schemas import FEEDS, schema

RSS = '<?xml version="1.0"?><rss version="2.0"><channel><title>T</title><item><guid>{g}</guid><title>story {g}</title></item></channel></rss>'


@pytest.fixture
def server():
    state = {"asked": [], "posts": [], "guid": "a", "refuse_posts": 0}

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def answer(self, status, body=b"", **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):  # noqa: N802
            state["asked"].append((self.path, self.headers.get("If-None-Match"), self.headers.get("User-Agent")))
            if self.path == "/same" and self.headers.get("If-None-Match") == "e1":
                return self.answer(304)
            if self.path == "/wait":
                return self.answer(429, Retry_After="120")
            if self.path == "/no":
                return self.answer(403, b"no")
            if self.path == "/moved":
                return self.answer(302, Location="/feed")
            if self.path == "/latin":
                return self.answer(200, '<?xml version="1.0" encoding="iso-8859-1"?><rss><channel><title>é</title></channel></rss>'.encode("latin-1"))
            return self.answer(200, RSS.format(g=state["guid"]).encode(), ETag="e1", Last_Modified="Mon", Content_Type="application/rss+xml")

        def do_POST(self):  # noqa: N802
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if state["refuse_posts"]:
                state["refuse_posts"] -= 1
                return self.answer(500)
            state["posts"].append((self.headers["Idempotency-Key"], [json.loads(x) for x in body.split("\n")]))
            return self.answer(200)

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    state["base"] = f"http://127.0.0.1:{http.server_port}"
    yield state
    http.shutdown()


def test_fetch_tells_outcomes(server):
    get = lambda path, **more: FETCH.fetch({"url": server["base"] + path, **more}, allow_closed=True)
    assert get("/same", etag="e1")["status"] == 304 and get("/same", etag="e1")["body"] is None
    assert (get("/wait")["status"], get("/wait")["retry_after"]) == (429, "120")
    assert get("/no") | {"content_type": None} == {"status": 403, "body": None, "etag": None, "last_modified": None, "retry_after": None, "content_type": None}
    assert get("/moved")["status"] == 200 and "é" in get("/latin")["body"]
    got = get("/feed", user_agent="mine/2")
    assert (got["etag"], got["last_modified"]) == ("e1", "Mon") and server["asked"][-1] == ("/feed", None, "mine/2")
    with pytest.raises(OSError, match="exceeded"):
        FETCH.fetch({"url": server["base"] + "/feed"}, cap=10, allow_closed=True)
    for url in (server["base"] + "/feed", "http://localhost/", "http://[::1]/", "file:///etc/hosts"):
        with pytest.raises((OSError, ValueError)):
            FETCH.fetch({"url": url})


def feeds(server, *paths):
    return json.dumps([{"id": k, "url": server["base"] + p} for k, p in enumerate(paths, 1)] + [{"id": 99, "url": "http://127.0.0.1:9/down"}])


def test_subscriptions_as_a_table(spark, server):
    web.register(spark)
    rows = spark.read.format("subscriptions").option("feeds", feeds(server, "/feed", "/no", "/wait", "/same")).option("allow_closed", "true").option("at_once", 2).load()
    got = {r["feed_id"]: (r["status"], r["retry_after"]) for r in rows.collect()}
    assert got == {1: (200, None), 2: (403, None), 3: (429, "120"), 4: (200, None), 99: (None, None)}


def test_a_stream_of_polls_goes_on_where_it_was(spark, server, tmp_path):
    """Polls go into the stored reader; a restart polls again, and items that were there stay single."""
    web.register(spark)
    reader = StoredReader(spark, str(tmp_path / "r"))
    row = {"interval_s": 1800, "failures": 0, "refusals": 0, "disabled": False, "llm_enabled": True, "icon_attempts": 0}
    reader.start(spark.createDataFrame([tuple({**row, "id": k, "url": f"u{k}"}.get(f.name) for f in schema(FEEDS)) for k in (1, 99)], FEEDS))

    def run():
        source = spark.readStream.format("subscriptions").option("feeds", feeds(server, "/feed")).option("allow_closed", "true").option("every_s", "0.5").load()
        sink = source.writeStream.foreachBatch(lambda df, n: reader.record_polls(df, "2024-01-01 00:00:00", n) and None)
        q = sink.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0.2 seconds").start()
        try:
            before, n = len(server["asked"]), 0
            while len(server["asked"]) < before + 2 and n < 300 and q.isActive:
                n += 1
                q.awaitTermination(0.2)
            q.processAllAvailable() if q.isActive and n > 300 else None
        finally:
            q.stop()
        assert q.exception() is None

    run()
    first = reader.archive.version()
    server["guid"] = "b"
    run()
    assert reader.archive.version() > first
    got = reader.engine().items.groupBy("guid").count().collect()
    assert {(r["guid"], r["count"]) for r in got} <= {("a", 1), ("b", 1)} and ("a", 1) in {(r["guid"], r["count"]) for r in got}
    assert {r["id"]: r["failures"] > 0 for r in reader.engine().feeds.collect()} == {1: False, 99: True}


def test_events_are_sent_on(spark, server, tmp_path):
    """All rows arrive, several a request; a batch whose sending failed is sent again on restart."""
    web.register(spark)
    rows = spark.range(10).select(F.lit("items-new").alias("kind"), F.col("id").alias("feed_id"), F.array(F.lit("é")).alias("tags"))
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("webhook").option("url", server["base"] + "/events").option("most", 4).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    server["refuse_posts"] = 100
    with pytest.raises(Exception, match=r"500|HTTP"):
        run()
    assert server["posts"] == []
    server["refuse_posts"] = 0
    run()
    sent = [x for _, lines in server["posts"] for x in lines]
    assert sorted(x["feed_id"] for x in sent) == list(range(10)) and all(x["tags"] == ["é"] for x in sent)
    assert len({k for k, _ in server["posts"]}) == len(server["posts"]) >= 3
