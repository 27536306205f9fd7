from datetime import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import html as H
from broadsheet.functions import text as T
from broadsheet.functions.answers import read_answer, system_prompt
from broadsheet.functions.hashing import fnv1a
from broadsheet.functions.schedule import next_interval
from broadsheet.operators import lists as L
from broadsheet.operators import vectors as V
from broadsheet.sources import feeds as FEEDS


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) if values else ["id"])
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("Points: 12 # Comments: 3", "12 3"), ("Hello world", "Hello world"), ("One thing is clear: the parser is faster than before", "One thing the parser is faster than before")],
)
def test_strip_labels(spark, text, want):
    assert one(spark, T.strip_labels(F.lit(text))) == want
    assert FEEDS._strip_labels(text) == want


def test_strip_anchors(spark):
    assert one(spark, T.strip_anchors(F.lit('<p>before <a href="x">link</a> after</p>'))) == "<p>before  after</p>"
    assert one(spark, T.strip_anchors(F.lit("<article>kept</article>"))) == "<article>kept</article>"
    assert one(spark, T.strip_anchors(F.lit("kept <a href=x>gone"))) == "kept "


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p>text</p><p><a href="x">Keep reading</a></p>', True),
        ('<p>text <a href="x">Read more</a></p>', True),
        ('<p>text… <a href="x">site</a></p>', True),
        ('<p>a <a href="x">source</a> says so and goes on.</p>', False),
        ("<p>no link</p>", False),
    ],
)
def test_says_truncated(spark, html, want):
    assert bool(one(spark, F.coalesce(T.says_truncated(F.lit(html)), F.lit(False)))) == want


def test_stubs(spark):
    stub = lambda h: one(spark, T.is_stub(F.lit(h)))
    assert stub('<a href="x">Comments</a>') and stub('<p>Article URL: <a href="x">https://site.example/story</a></p>\n<p>Points: 12</p>\n<p># Comments: 3</p>')
    assert not stub('<img src="x">') and not stub("<p>Short note.</p>")


def test_pruning_and_lazy_images():
    assert H.drop_empty("<p><span><span></span><span></span></span></p>") == ""
    assert H.drop_empty("<pre>  </pre><li></li><td></td>") == "<pre>  </pre><li></li><td></td>"
    assert 'src="real.jpg"' in H.unlazy('<img src="data:image/gif;base64,x" data-src="real.jpg">')
    assert H.unlazy('<img src="a.jpg" data-src="b.jpg">') == '<img src="a.jpg" data-src="b.jpg">'


def test_sanitize():
    out = H.sanitize('<p onclick="x()">Hi <script>bad()</script><a href="/b">b</a><img src="javascript:x" alt="i"></p>', "https://a.example/x")
    assert "script" not in out and "onclick" not in out and 'href="https://a.example/b"' in out and "bad()" not in out


@pytest.mark.parametrize(
    "current, result, failures, ttl, want",
    [(1800, "new", 0, None, 1350), (1800, "unchanged", 0, None, 2700), (1800, "failed", 1, None, 1800), (1800, "failed", 3, None, 7200), (1800, "failed", 5, None, 21600),
     (1800, "failed", 9, None, 21600), (1800, "new", 0, 120, 7200), (1800, "new", 0, 10000, 600000), (1800, "new", 0, 1000000, 604800), (900, "new", 0, None, 900)],
)
def test_next_interval(spark, current, result, failures, ttl, want):
    assert one(spark, next_interval(F.lit(current), F.lit(result), F.lit(failures), F.lit(ttl).cast("int"))) == want


@pytest.mark.parametrize("raw, want", [("120", 120), ("Mon, 01 Jan 2024 00:00:00 GMT", 0), ("soon", None), ("", None), ("-5", None), ("Mon, 05 Feb 2024 00:01:00 GMT", 60)])
def test_retry_after(spark, raw, want):
    assert one(spark, T.retry_after_seconds(F.lit(raw), F.lit("2024-02-05 00:00:00").cast("timestamp_ntz"))) == want


def test_search_terms_and_cursor():
    assert L.search_terms("rust async") == ["rust", "async"] and L.search_terms("o'brien") == ["o", "brien"]
    assert L.search_terms("***") == [] and L.search_terms("  ") is None and L.search_terms(None) is None
    assert L.parse_cursor("2026-09-01T10:00:00Z|42") == (datetime(2026, 9, 1, 10), 42)
    assert L.parse_cursor("junk") is None and L.parse_cursor(None) is None
    assert L.make_cursor(datetime(2026, 9, 1, 10), 42) == "2026-09-01T10:00:00Z|42"
    assert [L.page_size(x) for x in (None, 0, 500, 7)] == [50, 1, 200, 7]


def test_tags(spark):
    tags = lambda xs: one(spark, T.normal_tags(F.array(*map(F.lit, xs))))
    assert tags(["Rust", " rust ", "Parquet"]) == ["rust", "parquet"]
    assert len(tags([f"tag{i}" for i in range(20)])) == 4 and tags(["x" * 80]) is None


@pytest.mark.parametrize("raw", ['```json\n{"a": {"b": 1}}\n```', 'json\n{"a": {"b": 1}}', 'Here: {"a": {"b": 1}} done', '{"a": {"b": 1}}'])
def test_json_repair(spark, raw):
    assert one(spark, T.repaired_json(F.lit(raw))) == '{"a": {"b": 1}}'


def test_answers(spark):
    got = one(spark, read_answer(F.lit('x {"summary": "s", "tags": ["A"], "score": 250, "reason": "r"}')))
    assert got.score == 100 and got.tags == ["a"]
    assert one(spark, read_answer(F.lit('{"summary": "s"}'))).score is None
    assert "score" not in system_prompt("", []) and "liked: T" in system_prompt("p", [(1, "T")])


def test_vectors(spark):
    arr = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    assert one(spark, V.normalised(arr([3, 4]))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalised(arr([0, 0]))) == [0, 0]
    assert one(spark, V.dot(arr([1, 2, 3]), arr([1, 2]))) == 0.0
    assert V.decode_blob(V.encode_blob([1.0, -2.5]) + b"x") == [1.0, -2.5]


def test_embed_input(spark):
    assert one(spark, T.embed_input(F.lit("t"), F.lit("  "))) == "t"
    assert len(one(spark, T.embed_input(F.lit("t"), F.lit("b" * 5000)))) == 2003


def test_fnv():
    assert fnv1a(b"a") == 12638187200555641996 and fnv1a(b"foobar") == 9625390261332436968


def test_icons_and_addresses():
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    assert H.is_banner(png(400, 64)) and not H.is_banner(png(180, 180)) and not H.is_banner(png(64, 56)) and not H.is_banner(b"gif")
    assert H.icon_uri("image/png; x", png(16, 16)).startswith("data:image/png;base64,") and H.icon_uri("text/html", b"x") is None
    assert H.normal_address("example.com/feed") == "https://example.com/feed" and H.normal_address("ftp://x") is None and H.normal_address(" ") is None


def test_feed_parse():
    from broadsheet.plans.queries import ATOM, JSON_FEED, RSS

    rss = FEEDS.parse_feed(RSS, "https://site.example/feed")
    assert rss["ttl_minutes"] == 45 and rss["site_url"] == "https://site.example/"
    first, second = rss["items"]
    assert first["guid"] == "g-1" and first["content_text"] == "Hello world" and "script" not in first["content_html"] and first["truncated"] and first["url"] == "https://site.example/a"
    assert second["content_html"] is None and second["comments_url"] == "https://talk.example/?a=1&b=2" and second["truncated"]
    assert FEEDS.parse_feed(ATOM, "https://atoms.example/feed")["items"][0]["guid"] == "u:1"
    assert FEEDS.parse_feed(JSON_FEED, "https://j.example/feed")["items"][0]["guid"] == "5"
    assert FEEDS.parse_feed("<html></html>", "x") is None and FEEDS.parse_feed("junk", "x") is None
    bare = '<rss><channel><item><description>only this</description></item></channel></rss>'
    a, b = (FEEDS.parse_feed(bare, "x")["items"][0]["guid"] for _ in range(2))
    assert a == b and a.startswith("item:")
    comic = '<rss><channel><item><guid>1</guid><description>&lt;img src="c.png"&gt;</description></item></channel></rss>'
    assert FEEDS.parse_feed(comic, "https://c.example/f")["items"][0]["content_html"]


def test_opml_round_trip(spark):
    rows = spark.createDataFrame([(0, 'A & "B"', "https://a.example/?x=1&y=2", None), (1, "C", "https://c.example", "https://c.example/s")], "position int, title string, url string, site_url string")
    text = FEEDS.write_opml(rows, "2024").first()["opml"]
    back = FEEDS.parse_opml(text)
    assert [(o["title"], o["url"], o["site_url"]) for o in back] == [('A & "B"', "https://a.example/?x=1&y=2", None), ("C", "https://c.example", "https://c.example/s")]
    assert len(FEEDS.parse_opml(text[: text.index("C</")] if "C</" in text else text[:-60])) >= 1


def test_python_columns_hold_few_values_at_a_time(spark):
    """A batch's results leave in parts, by number and by size; nulls and rows keep their places."""
    import pyarrow as pa

    from broadsheet.functions import udfs

    n = udfs.AT_ONCE
    parts = list(udfs._results((pa.array(["a", None] * n), pa.array([1] * 2 * n)), lambda x, y: x * y, pa.string()))
    assert [len(p) for p in parts] == [n, n] and pa.concat_arrays(parts).to_pylist() == ["a", None] * n
    long = list(udfs._results((pa.array(["x" * (udfs.AT_ONCE_BYTES // 2)] * 5),), len, pa.int64()))
    assert [len(p) for p in long] == [2, 2, 1]
    rows = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) as a", "'b' as b").coalesce(1)
    both = {"x": "string", "y": "string"}
    made = rows.select("id", udfs.column(str.upper, "string")("a").alias("one"), udfs.column2(str.__add__, "string")("a", "b").alias("two"), udfs.struct2(lambda a, b: None if a == "8" else {"x": a, "y": b}, both)("a", "b").alias("three"), udfs.column(lambda a: [a], "array<string>")("a").alias("four"))
    for i, one, two, three, four in made.collect():
        a = None if i % 7 == 0 else str(i)
        assert (one, two, four) == (a, a and a + "b", a and [a]) and tuple(three) == ((None, None) if a in (None, "8") else (a, "b"))
