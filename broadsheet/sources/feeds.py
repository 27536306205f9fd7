"""Feed documents (RSS, Atom, JSON Feed) as rows of normalised entries, and OPML lists of feeds."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html import escape, unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.hashing import fnv1a
from ..session import ship

MIN_PROSE, FULL_TEXT = 40, 400
_CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"
_CREATOR = "{http://purl.org/dc/elements/1.1/}creator"
_ATOM = "{http://www.w3.org/2005/Atom}"


def parse_date(text: str | None) -> datetime | None:
    text = (text or "").strip()
    for read in (lambda: datetime.fromisoformat(text.replace("Z", "+00:00")), lambda: parsedate_to_datetime(text)):
        try:
            when = read()
        except (ValueError, TypeError, IndexError):
            continue
        return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(microsecond=0)
    return None


def _strip_anchors(markup: str) -> str:
    return re.sub(r"(?is)<a(?=[\s>]|$).*?(?:</a>|$)", "", markup)


def _strip_labels(text: str) -> str:
    if ":" not in text:
        return text
    *before, last = (part.split() for part in text.split(":"))
    return " ".join([w for words in before for w in words[: max(0, len(words) - 2)]] + last)


def is_stub(markup: str) -> bool:
    """Whether a body is only links and labels."""
    if re.search(r"(?i)<(img|video|audio|picture|iframe|figure)", markup):
        return False
    prose = _strip_labels(H.text_of(_strip_anchors(markup))).strip()
    return prose == "" if len(H.text_of(markup)) < MIN_PROSE else len(prose) < MIN_PROSE


def says_truncated(markup: str) -> bool:
    from ..functions.text import CONTINUATIONS

    m = re.match(r"(?is)^(.*)(<a(?:(?!<a).)*?</a>)[\s<>/\w]*$", markup)
    if not m:
        return False
    return bool(re.search(r"(\.\.\.|…|…</p>)\s*$", m[1])) or H.text_of(m[2]).lower().startswith(CONTINUATIONS)


def discussions(xml: str) -> dict[str, str]:
    """Comment pages of an RSS document by guid and by link; a broken document gives what came before the break."""
    out: dict[str, str] = {}
    if "<comments" not in xml:
        return out
    for item in re.findall(r"(?s)<item\b[^>]*>(.*?)</item>", xml):
        found = {}
        for name in ("guid", "link", "comments"):
            m = re.search(rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", item)
            value = re.sub(r"(?s)<!\[CDATA\[(.*?)\]\]>", r"\1", m[1]) if m else ""
            found[name] = (value if m and "<![CDATA[" in m[1] else unescape(value)).strip()
        if found["comments"]:
            for key in (found["guid"], found["link"]):
                if key:
                    out.setdefault(key, found["comments"])
    return out


def _entry(raw: dict, base: str, talks: dict[str, str]) -> dict:
    """One entry in the shape of schemas.PARSED_ITEM."""
    url = raw["url"] and urljoin(base, raw["url"])
    markup, from_summary = (raw["content"], False) if raw["content"] else (raw["summary"], True)
    markup = H.sanitize(markup, url or base) if markup else None
    if markup is not None and (not markup.strip() or is_stub(markup)):
        markup = None
    text = H.text_of(markup) if markup else None
    when = raw["published"] or raw["updated"]
    guid = raw["id"] or url
    if not guid:
        stamp = when.isoformat() if when else ""
        guid = f"item:{fnv1a(f'{raw['title'] or ''}\u0001{stamp}\u0001{(text or '')[:200]}'.encode()):016x}"
    comments = talks.get(guid) or (talks.get(raw["url"]) if raw["url"] else None) or raw["replies"]
    return {
        "guid": guid,
        "url": url,
        "comments_url": comments if comments != url else None,
        "title": (raw["title"] or "").strip(),
        "author": raw["author"],
        "published_at": when,
        "content_html": markup,
        "content_text": text,
        "truncated": from_summary or text is None or len(text) < FULL_TEXT or says_truncated(markup),
    }


def _text(node: ET.Element | None) -> str | None:
    if node is None:
        return None
    inner = "".join(ET.tostring(c, encoding="unicode") for c in node) if len(node) and node.get("type") == "xhtml" else "".join(node.itertext())
    return inner.strip() or None


def _rss(root: ET.Element) -> tuple[dict, list[dict]]:
    channel = root.find("channel")
    channel = root if channel is None else channel
    get = lambda node, name: _text(node.find(name))
    ttl = get(channel, "ttl")
    head = {"title": get(channel, "title"), "site": get(channel, "link"), "icon": get(channel, "image/url"), "ttl": int(ttl) if (ttl or "").isdigit() else None}
    entries = [
        {
            "id": get(i, "guid"), "url": get(i, "link"), "title": get(i, "title"), "author": get(i, "author") or get(i, _CREATOR), "content": get(i, _CONTENT),
            "summary": get(i, "description"), "published": parse_date(get(i, "pubDate")), "updated": None, "replies": None,
        }
        for i in root.iter("item")
    ]
    return head, entries


def _atom(root: ET.Element) -> tuple[dict, list[dict]]:
    def link(node: ET.Element, *rels: str) -> str | None:
        return next((x.get("href") for rel in rels for x in node.findall(f"{_ATOM}link") if x.get("rel", "alternate") == rel), None)

    get = lambda node, name: _text(node.find(f"{_ATOM}{name}"))
    head = {"title": get(root, "title"), "site": link(root, "alternate"), "icon": get(root, "icon") or get(root, "logo"), "ttl": None}
    entries = [
        {
            "id": get(e, "id"), "url": link(e, "alternate"), "title": get(e, "title"), "author": _text(e.find(f"{_ATOM}author/{_ATOM}name")), "content": get(e, "content"),
            "summary": get(e, "summary"), "published": parse_date(get(e, "published")), "updated": parse_date(get(e, "updated")), "replies": link(e, "replies"),
        }
        for e in root.findall(f"{_ATOM}entry")
    ]
    return head, entries


def _json_feed(doc: dict) -> tuple[dict, list[dict]]:
    head = {"title": doc.get("title"), "site": doc.get("home_page_url"), "icon": doc.get("icon") or doc.get("favicon"), "ttl": None}
    entries = [
        {
            "id": str(i["id"]) if i.get("id") is not None else None, "url": i.get("url"), "title": i.get("title"),
            "author": next((a.get("name") for a in i.get("authors") or [i.get("author") or {}]), None), "content": i.get("content_html") or (escape(i["content_text"]) if i.get("content_text") else None),
            "summary": i.get("summary"), "published": parse_date(i.get("date_published")), "updated": parse_date(i.get("date_modified")), "replies": None,
        }
        for i in doc.get("items", [])
    ]
    return head, entries


def parse_feed(body: str, feed_url: str) -> dict | None:
    """title, site_url, icon, ttl_minutes and items of a feed document; None if it is none."""
    text = body.lstrip("﻿ \t\r\n")
    try:
        if text.startswith("{"):
            doc = json.loads(text)
            if not isinstance(doc, dict) or "jsonfeed.org" not in str(doc.get("version", "")):
                return None
            head, entries = _json_feed(doc)
        else:
            root = ET.fromstring(text)
            if root.tag == f"{_ATOM}feed":
                head, entries = _atom(root)
            elif root.tag == "rss" or root.tag.endswith("}RDF"):
                head, entries = _rss(root)
            else:
                return None
    except (ET.ParseError, ValueError, AttributeError):
        return None
    base = head["site"] if (head["site"] or "").startswith("http") else feed_url
    talks = discussions(text)
    site = head["site"] and urljoin(feed_url, head["site"])
    return {
        "title": head["title"],
        "site_url": site if site != feed_url else None,
        "icon": head["icon"],
        "ttl_minutes": head["ttl"],
        "items": [_entry(e, base, talks) for e in entries],
    }


_ITEM = "guid string, url string, comments_url string, title string, author string, published_at timestamp, content_html string, content_text string, truncated boolean"
PARSED = f"feed_id long, ok boolean, feed_title string, site_url string, icon string, ttl_minutes int, items array<struct<{', '.join(x.replace(' ', ':', 1) for x in _ITEM.split(', '))}>>"


def parse_responses(responses: DataFrame, cap: int = 16 << 20) -> DataFrame:
    """One row per response (feed_id, url, body): whether it is a feed, what it says of itself, and its entries.

    Bodies over the cap are no feeds; they are told before Python sees them.
    """
    ship(responses.sparkSession)
    rows = responses.select(F.col("feed_id").cast("long").alias("feed_id"), "url", F.when(F.octet_length("body") <= cap, F.col("body")).alias("body"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(PARSED))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for feed_id, url, body in zip(*(batch.column(c).to_pylist() for c in ("feed_id", "url", "body")), strict=True):
                found = parse_feed(body or "", url or "")
                head = found or {"title": None, "site_url": None, "icon": None, "ttl_minutes": None, "items": []}
                out.append({"feed_id": feed_id, "ok": found is not None, "feed_title": head["title"], "site_url": head["site_url"], "icon": head["icon"], "ttl_minutes": head["ttl_minutes"], "items": head["items"]})
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return rows.mapInArrow(parse, PARSED)


def entries(parsed: DataFrame) -> DataFrame:
    """One row per entry, with its place in the document."""
    return parsed.where("ok").select("feed_id", F.posexplode("items").alias("pos", "item")).select("feed_id", "pos", "item.*")


def parse_opml(text: str) -> list[dict]:
    """Subscriptions in file order: outlines with an xmlUrl, folders flattened; a broken file gives what came before the break."""
    out = []
    reader = ET.XMLPullParser(events=("start",))
    try:
        reader.feed(text)
    except ET.ParseError:
        pass
    try:
        for _, node in reader.read_events():
            if node.tag != "outline":
                continue
            given = {k.lower(): v.strip() for k, v in node.attrib.items() if v.strip()}
            if "xmlurl" in given:
                out.append({"url": given["xmlurl"], "title": given.get("title") or given.get("text"), "site_url": given.get("htmlurl")})
    except ET.ParseError:
        pass
    return out


def read_opml(files: DataFrame, column: str = "body") -> DataFrame:
    """(pos, url, title, site_url) of each subscription of OPML texts."""
    ship(files.sparkSession)
    kind = "array<struct<url:string,title:string,site_url:string>>"

    @F.pandas_udf(kind)
    def parse(bodies):  # noqa: ANN001, ANN202
        return bodies.map(lambda b: parse_opml(b or ""))

    return files.select(F.posexplode(parse(F.col(column))).alias("pos", "o")).select("pos", "o.*")


def write_opml(feeds: DataFrame, now: str) -> DataFrame:
    """One OPML document of (position, title, url, site_url) rows, built of expressions alone.

    A document is one value, so its outlines meet in one task; they are as many as a reader's subscriptions.
    """
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    title = esc(F.col("title"))
    site = F.when(F.col("site_url").isNotNull(), F.concat(F.lit(' htmlUrl="'), esc(F.col("site_url")), F.lit('"'))).otherwise("")
    line = F.concat(F.lit('    <outline type="rss" text="'), title, F.lit('" title="'), title, F.lit('" xmlUrl="'), esc(F.col("url")), F.lit('"'), site, F.lit("/>\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head>\n    <title>subscriptions</title>\n    <dateCreated>{now}</dateCreated>\n  </head>\n  <body>\n'
    return feeds.agg(F.concat(F.lit(head), body, F.lit("  </body>\n</opml>\n")).alias("opml"))
