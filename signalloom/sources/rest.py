"""Paged REST source as a Spark data source: one partition a (ticker, window), retries inside the reader."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRYABLE = {429, 500, 502, 503, 504}


class HttpError(Exception):
    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def delay(attempt: int, retry_after: str | None, now: float, base: float = 0.5, most: float = 30.0, jitter: float = 0.0) -> float:
    """Seconds before the next attempt: Retry-After (seconds or a date) if given, else doubling, at most ``most``."""
    if retry_after:
        try:
            wait = float(retry_after)
        except ValueError:
            wait = parsedate_to_datetime(retry_after).timestamp() - now
        return min(most, max(0.0, wait))
    return min(most, base * 2**attempt + jitter)


def with_retries(fetch: Callable[[], bytes], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Result of ``fetch``; retryable statuses and transport errors are tried again."""
    for attempt in range(attempts):
        try:
            return fetch()
        except HttpError as e:
            if e.status not in RETRYABLE or attempt + 1 == attempts:
                raise
            sleep(delay(attempt, e.retry_after, time.time(), jitter=random.random() / 10))
        except OSError:
            if attempt + 1 == attempts:
                raise
            sleep(delay(attempt, None, time.time(), jitter=random.random() / 10))
    raise AssertionError("unreachable")


def pages(fetch: Callable[[int, int], bytes], page_size: int, most: int) -> Iterator[dict]:
    """Rows by offset until a short page or ``most`` rows; a page seen before is an error."""
    seen, got = set(), 0
    while got < most:
        limit = min(page_size, most - got)
        body = fetch(got, limit)
        digest = hashlib.sha256(body).hexdigest()
        rows = json.loads(body)
        if rows and digest in seen:
            raise ValueError("the provider repeated a page")
        seen.add(digest)
        yield from rows
        got += len(rows)
        if len(rows) < limit:
            return


class _Window(InputPartition):
    def __init__(self, ticker: str, start: str, end: str):
        self.ticker, self.start, self.end = ticker, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Window]:
        return [_Window(*x.split("|")) for x in self.options["windows"].split(",")]

    def read(self, partition: _Window):
        o = self.options

        def fetch(offset: int, limit: int) -> bytes:
            query = urllib.parse.urlencode({"s": partition.ticker, "from": partition.start, "to": partition.end, "offset": offset, "limit": limit})

            def once() -> bytes:
                try:
                    with urllib.request.urlopen(f"{o['url']}?{query}", timeout=float(o.get("timeout", 30))) as r:
                        return r.read()
                except urllib.error.HTTPError as e:
                    raise HttpError(e.code, e.headers.get("Retry-After")) from None

            return with_retries(once)

        for row in pages(fetch, int(o.get("pagesize", 100)), int(o.get("most", 1000))):
            yield partition.ticker, json.dumps(row, sort_keys=True)


class PagedRest(DataSource):
    """``spark.dataSource.register(PagedRest)``; options url, windows (ticker|start|end, comma-joined), pagesize, most."""

    @classmethod
    def name(cls) -> str:
        return "pagedrest"

    def schema(self) -> str:
        return "ticker string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
