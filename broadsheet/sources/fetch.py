"""Feeds and pages over HTTP, as a plain function of one address; .web makes a source of it."""

from __future__ import annotations

import re
import socket
from collections.abc import Callable
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from ..functions.html import is_public

#: Bytes of a body, and seconds for an answer, at most.
MAX_BODY, TIMEOUT_S = 16 << 20, 60.0
AGENT = "broadsheet/1"


class Closed(OSError):
    """An address that is not on the public internet."""


def refuse_closed(url: str) -> None:
    """Every address that a url's host has must be public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"no web address: {url}")
    for _, _, _, _, at in socket.getaddrinfo(parts.hostname, parts.port or 443, proto=socket.IPPROTO_TCP):
        if not is_public(at[0].split("%")[0]):
            raise Closed(f"{parts.hostname} is not public")


class _Redirects(HTTPRedirectHandler):
    """A redirect is looked at like the address before it."""

    def __init__(self, look: Callable[[str], None]) -> None:
        self.look = look

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.look(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def _decoded(body: bytes, content_type: str) -> str:
    named = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I)
    declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w-]+)", body)
    for name in (named and named[1], declared and declared[1].decode(), "utf-8"):
        try:
            if name:
                return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")


def fetch(feed: dict, cap: int = MAX_BODY, timeout_s: float = TIMEOUT_S, allow_closed: bool = False) -> dict:
    """status, body, etag, last_modified, retry_after, content_type of a feed's address (url, and etag, last_modified,
    user_agent where known).  Validators go along, so an unchanged document is a 304 without a body.  OSError if there is no
    answer, if the host is not public or the body is over the cap."""
    look = (lambda url: None) if allow_closed else refuse_closed
    look(feed["url"])
    headers = {"User-Agent": feed.get("user_agent") or AGENT, "Accept-Encoding": "identity"}
    headers |= {name: feed[key] for name, key in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified")) if feed.get(key)}
    try:
        answer = build_opener(_Redirects(look)).open(Request(feed["url"], headers=headers), timeout=timeout_s)
    except HTTPError as e:
        answer = e
    with answer:
        body = answer.read(cap + 1) if 200 <= answer.status < 300 else b""
        got = answer.headers
        if len(body) > cap:
            raise OSError(f"response exceeded {cap} bytes")
        kind = got.get("Content-Type", "")
        return {
            "status": answer.status, "body": _decoded(body, kind) if body else None, "etag": got.get("ETag"), "last_modified": got.get("Last-Modified"),
            "retry_after": got.get("Retry-After"), "content_type": kind or None,
        }
