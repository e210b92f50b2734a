"""Fetching over HTTP as a Spark data source: one task per group of hosts, polite within each host.

The opener, the clock and the sleep are injected, so everything but the socket is tested without a network.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import canonical, host_of, is_private

USER_AGENT = "gleanery/1.0"


class Refused(OSError):
    """A URL that may not be fetched."""


@dataclass
class Answer:
    """What came back: where from in the end, status, content type and body."""

    url: str
    status: int
    content_type: str
    body: bytes


@dataclass
class Raw:
    """One exchange without redirects: status, headers with lower-case names, and a reader of at most n bytes."""

    status: int
    headers: dict[str, str]
    read: Callable[[int], bytes]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def open_url(url: str, timeout: float) -> Raw:
    """One exchange over the network."""
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
    try:
        got = urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout)
    except urllib.error.HTTPError as e:
        got = e
    return Raw(got.status, {k.lower(): v for k, v in got.headers.items()}, got.read)


@dataclass
class Fetcher:
    """Fetches allowed public hosts: waits between requests to a host, obeys robots.txt, follows at most ``hops``
    redirects and checks each of them, and refuses bodies beyond ``max_bytes``."""

    hosts: set[str]
    wait: float = 5
    timeout: float = 30
    max_bytes: int = 10 << 20
    hops: int = 5
    opener: Callable[[str, float], Raw] = open_url
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: dict[str, float] = field(default_factory=dict)
    _robots: dict[str, urllib.robotparser.RobotFileParser] = field(default_factory=dict)

    def _checked(self, url: str) -> str:
        url = canonical(url) or ""
        host = urlsplit(url).hostname or ""
        if not host or is_private(host) or host not in {h.lower() for h in self.hosts}:
            raise Refused(f"not allowed: {host or 'no http(s) URL'}")
        return url

    def _exchange(self, url: str) -> Raw:
        host = urlsplit(url).netloc
        due = self._last.get(host, float("-inf")) + self.wait - self.clock()
        if due > 0:
            self.sleep(due)
        try:
            return self.opener(url, self.timeout)
        finally:
            self._last[host] = self.clock()

    def _may(self, url: str) -> bool:
        root = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if root not in self._robots:
            rules = urllib.robotparser.RobotFileParser()
            got = self._exchange(root + "/robots.txt")
            rules.parse(got.read(1 << 19).decode("utf-8", "replace").splitlines() if got.status == 200 else [])
            self._robots[root] = rules
        return self._robots[root].can_fetch(USER_AGENT, url)

    def fetch(self, url: str) -> Answer:
        url = self._checked(url)
        for _ in range(self.hops + 1):
            if not self._may(url):
                raise Refused("robots.txt forbids it")
            got = self._exchange(url)
            if got.status in (301, 302, 303, 307, 308) and got.headers.get("location"):
                url = self._checked(urljoin(url, got.headers["location"]))
                continue
            if got.status >= 400:
                raise OSError(f"HTTP {got.status}")
            body = got.read(self.max_bytes + 1)
            if len(body) > self.max_bytes:
                raise OSError("larger than the limit")
            return Answer(url, got.status, got.headers.get("content-type", ""), body)
        raise OSError("too many redirects")


def fetched(urls: DataFrame, make_fetcher: Callable[[], Fetcher], tasks: int = 8) -> DataFrame:
    """``url, final_url, status, content_type, body, error`` of ``url``. All URLs of a host are in one task, in order,
    so that its wait holds; that many requests in a row to one host are meant to be slow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = make_fetcher()
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    a = fetcher.fetch(url)
                    rows.append((url, a.url, a.status, a.content_type, a.body, None))
                except OSError as e:
                    rows.append((url, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "content_type", "body", "error"], dtype=object)

    by_host = urls.select("url").repartition(tasks, host_of(F.col("url"))).sortWithinPartitions("url")
    return by_host.mapInPandas(run, "url string, final_url string, status int, content_type string, body binary, error string")
