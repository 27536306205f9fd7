"""Data sources of Spark's own kind: subscriptions that are fetched, as a table or a stream, and events that are sent on.

    register(spark)
    spark.readStream.format("subscriptions").option("feeds", json).option("every_s", 1800).load()
    events.writeStream.format("webhook").option("url", "https://...").start()
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.request import Request, urlopen

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from ..session import ship

RESPONSE = "feed_id long, url string, status int, body string, etag string, last_modified string, retry_after string, content_type string, poll long"


def register(spark: SparkSession) -> None:
    """Makes the formats `subscriptions` and `webhook` known to a session."""
    ship(spark)
    for source in (Subscriptions, Webhook):
        spark.dataSource.register(source)


class Share(InputPartition):
    """The feeds that one task asks, one after the other."""

    def __init__(self, feeds: list[dict], poll: int) -> None:
        self.feeds, self.poll = feeds, poll


class _Fetches:
    """Options: feeds (a JSON list of id, url and, where known, etag, last_modified, user_agent), at_once (tasks, and so
    requests, at a time: 4), timeout_s, allow_closed (addresses that are not public)."""

    def __init__(self, options: dict) -> None:
        self.feeds = json.loads(options.get("feeds", "[]"))
        self.at_once = int(options.get("at_once", "4"))
        self.every_s = float(options.get("every_s", "1800"))
        self.how = {"timeout_s": float(options.get("timeout_s", "60")), "allow_closed": options.get("allow_closed", "false") == "true"}

    def shares(self, poll: int) -> list[Share]:
        return [Share(own, poll) for k in range(self.at_once) if (own := self.feeds[k :: self.at_once])]

    def read(self, partition: Share) -> Iterator[tuple]:
        from broadsheet.sources.fetch import fetch

        for feed in partition.feeds:
            try:
                got = fetch(feed, **self.how)
            except (OSError, ValueError):
                got = {}
            yield (feed["id"], feed["url"], *(got.get(k) for k in ("status", "body", "etag", "last_modified", "retry_after", "content_type")), partition.poll)


class SubscriptionsReader(_Fetches, DataSourceReader):
    def partitions(self) -> list[Share]:
        return self.shares(0)


class SubscriptionsStream(_Fetches, DataSourceStreamReader):
    """An offset is a poll's number: whole intervals since 1970.  Polls that passed while the stream was down are made up for
    by one, for a feed only ever says what it says now; a batch that is run again asks again, and what it had added
    before is known by then."""

    def _now(self) -> int:
        return int(time.time() // self.every_s)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": self._now() - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": self._now()}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.shares(end["poll"]) if end["poll"] > start["poll"] else []

    def commit(self, end: dict) -> None:
        pass


class Subscriptions(DataSource):
    """One row per feed and poll; without an answer the status is null."""

    @classmethod
    def name(cls) -> str:
        return "subscriptions"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return SubscriptionsReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SubscriptionsStream(self.options)


@dataclass
class Sent(WriterCommitMessage):
    rows: int


class WebhookWriter(DataSourceStreamWriter):
    """Each task posts its rows as lines of JSON, `most` at a time.  A task that is run again sends the same key in
    Idempotency-Key (query, part of the batch, place), by which the receiver can tell what it has."""

    def __init__(self, options: dict) -> None:
        self.url, self.most, self.key = options["url"], int(options.get("most", "256")), options.get("key", "events")

    def write(self, rows: Iterator) -> Sent:
        part, n, held = TaskContext.get().partitionId(), 0, []
        batch = TaskContext.get().getLocalProperty("streaming.sql.batchId")

        def send() -> None:
            nonlocal n
            body = "\n".join(json.dumps(x, default=str, ensure_ascii=False) for x in held).encode()
            headers = {"Content-Type": "application/x-ndjson", "Idempotency-Key": f"{self.key}-{batch}-{part}-{n}"}
            with urlopen(Request(self.url, data=body, headers=headers, method="POST"), timeout=60):
                n += len(held)
            held.clear()

        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) >= self.most:
                send()
        if held:
            send()
        return Sent(n)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        pass

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        pass


class Webhook(DataSource):
    """Rows of a stream to an address; a batch that fails is sent again when the stream goes on."""

    @classmethod
    def name(cls) -> str:
        return "webhook"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return WebhookWriter(self.options)
