"""Feeds and sitemaps: XML bodies to candidate rows, for whole columns of bodies."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from gleanery.functions.dates import any_date_text
from gleanery.functions.urls import canonical

CANDIDATES = "source string, position int, url string, title string, published string, published_evidence string, updated string, updated_evidence string, rejected string, error string"


#: Bytes of a body that are parsed at once; bodies beyond ``_LARGE`` are read twice rather than held as rows.
_PIECE, _LARGE = 1 << 16, 1 << 20
#: Rows that are passed on at once.
_ROWS = 5_000


def elements(body: bytes, *names: str, refused: str = "") -> Iterator[ElementTree.Element]:
    """Elements with one of ``names`` in document order. What has been read is dropped, so that no more than one of them,
    with all it holds, is in memory. Document types and entities are refused, since they can reach files or grow without
    bound, and so is a root named ``refused``."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", body, re.IGNORECASE):
        raise ValueError("document types and entities are refused")
    parser, path, depth = ElementTree.XMLPullParser(["start", "end"]), [], 0  # depth: within the outermost one of names
    for at in range(0, len(body) + 1, _PIECE):
        if piece := body[at : at + _PIECE]:
            parser.feed(piece)
        if at + _PIECE > len(body):
            parser.close()
        for event, element in parser.read_events():
            if event == "start":
                if not depth and not path and _name(element) == refused:
                    raise ValueError(f"{refused} is not a list of pages")
                if depth or _name(element) in names:
                    depth += 1
                else:
                    path.append(element)
            elif depth > 1:
                depth -= 1
            else:
                if depth:
                    depth = 0
                    yield from (e for e in element.iter() if _name(e) in names)
                else:
                    path.pop()
                if path:
                    path[-1].remove(element)


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element: ElementTree.Element) -> dict[str, str]:
    """The first text that is not blank of the children of each name, in document order."""
    texts = {}
    for child in element:
        if text := (child.text or "").strip():
            texts.setdefault(_name(child), text)
    return texts


def _first(texts: dict[str, str], *names: str) -> str | None:
    return next((text for name, text in texts.items() if name in names), None)


#: Items of a feed share their days.
_date = lru_cache(4096)(any_date_text)


def feed_items(body: bytes, base: str) -> Iterator[dict]:
    """Items of RSS 2.0, RSS 1.0 and Atom in document order; refused links come as ``rejected``."""
    for item in elements(body, "item", "entry"):
        texts = _texts(item)
        link = texts.get("link") or next(
            (c.get("href") for c in item if _name(c) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"),
            None,
        )
        if not link:
            continue
        url = canonical(link, base)
        if url is None:
            yield {"rejected": link}
            continue
        published, updated = _first(texts, "pubDate", "published", "date", "issued"), _first(texts, "updated", "modified")
        tag = "pubDate" if "pubDate" in texts else "dc:date" if "date" in texts else "published"
        row = {"url": url, "title": texts.get("title")}
        if value := _date(published):
            row |= {"published": value, "published_evidence": f"<{tag}>{published}</{tag}>"}
        if value := _date(updated):
            row |= {"updated": value, "updated_evidence": f"<updated>{updated}</updated>"}
        yield row


def sitemap_items(body: bytes, base: str, include: list[str] = (), exclude: list[str] = ()) -> Iterator[dict]:
    """Pages of a url set that pass the patterns; an index of sitemaps is refused. Its dates are not publication dates."""
    for entry in elements(body, "url", refused="sitemapindex"):
        loc = _texts(entry).get("loc")
        if not loc:
            continue
        url = canonical(loc, base)
        if url is None:
            yield {"rejected": loc}
        elif (not include or any(re.search(p, url) for p in include)) and not any(re.search(p, url) for p in exclude):
            yield {"url": url}


def candidates(bodies: DataFrame, parse, **options) -> DataFrame:
    """Candidates of each body (``source, base, body``) by ``feed_items`` or ``sitemap_items``; a body that cannot be
    read gives one row with its error, and the others are not harmed."""

    def found(body: bytes, base: str) -> Iterator[dict]:
        if len(body) <= _LARGE:
            return iter(list(parse(body, base, **options)))
        deque(parse(body, base, **options), 0)  # a body that breaks off further on gives no rows
        return parse(body, base, **options)

    def rows_of(source: str, base: str, body: bytes) -> Iterator[dict]:
        try:
            yield from ({"source": source, "position": k} | item for k, item in enumerate(found(bytes(body), base)))
        except (ValueError, ElementTree.ParseError) as e:
            yield {"source": source, "position": 0, "error": str(e)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CANDIDATES.split(", ")]
        for batch in batches:
            rows = chain.from_iterable(map(rows_of, batch["source"], batch["base"], batch["body"]))
            while some := list(islice(rows, _ROWS)):
                yield pd.DataFrame(some, columns=columns, dtype=object)

    return bodies.select("source", "base", "body").mapInPandas(run, CANDIDATES)
