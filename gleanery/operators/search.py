"""Search over articles: filters as columns, excluded undated rows, pages and the latest view."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, replace
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import dates
from gleanery.functions.text import label, searchable

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Filters:
    """A search request; empty fields do not filter. Days are inclusive."""

    q: str = ""
    tag: str = ""
    source: str = ""
    start: str = ""
    end: str = ""
    page: int = 1

    @classmethod
    def parse(cls, query: str) -> "Filters":
        """From a query string: values are cut at 200 characters, malformed days and pages are dropped."""
        got = {k: v[0][:200] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
        day = lambda k: got.get(k, "") if _DAY.fullmatch(got.get(k, "")) else ""
        page = int(got["page"]) if re.fullmatch(r"[0-9]{1,12}", got.get("page", "")) else 1
        return cls(got.get("q", ""), got.get("tag", ""), got.get("source", ""), day("from"), day("to"), min(max(page, 1), 100_000))

    def query(self) -> str:
        pairs = {"q": self.q, "tag": self.tag, "source": self.source, "from": self.start, "to": self.end, "page": self.page if self.page > 1 else ""}
        kept = {k: v for k, v in pairs.items() if v}
        return "?" + urlencode(kept) if kept else ""

    @property
    def has_period(self) -> bool:
        return bool(self.start or self.end)


def search_text(articles: DataFrame) -> Column:
    """All that full-text search looks at, one part a line, case and width folded."""
    none = F.array().cast("array<string>")
    parts = [
        F.array("title", "source_name", F.coalesce("summary.text", F.lit(""))),
        F.coalesce("summary.key_points", none),
        F.coalesce("summary.targets", none),
        F.transform("tags", lambda t: t["name"]),
    ]
    return searchable(F.array_join(F.concat(*parts), "\n"))


def has_tag(tag: str) -> Column:
    return F.exists("tags", lambda t: t["id"] == tag)


def folded_terms(q: str) -> list[str]:
    """White-space separated terms of a request, case and width folded."""
    return unicodedata.normalize("NFKC", q).lower().split()


def has_terms(text: Column, q: str) -> Column:
    """All terms of a request occur in a folded text."""
    test = F.lit(True)
    for term in folded_terms(q):
        test &= text.contains(term)
    return test


def search(articles: DataFrame, f: Filters) -> DataFrame:
    """Tag, source, period and all terms together. Cheap tests come first, and only what is asked for is tested."""
    if f.source:
        articles = articles.where(F.col("source_id") == f.source)
    if f.has_period:
        articles = articles.where(dates.overlaps(F.col("published"), f.start, f.end))
    if f.tag:
        articles = articles.where(has_tag(f.tag))
    if f.q.split():
        articles = articles.where(has_terms(search_text(articles), f.q))
    return articles


def undated_excluded(articles: DataFrame, f: Filters) -> DataFrame:
    """How many rows without a date the period left out: one row, ``n``."""
    if not f.has_period:
        return articles.limit(0).agg(F.count(F.lit(1)).alias("n"))
    return search(articles, replace(f, start="", end="")).where("published is null").agg(F.count(F.lit(1)).alias("n"))


def newest_first(articles: DataFrame) -> DataFrame:
    """By published value as a string (unknown last), then by when it was first seen; ties by id."""
    return articles.orderBy(F.coalesce("published", F.lit("")).desc(), F.col("first_seen_at").desc(), F.col("id"))


def page_bounds(total: int, size: int, page: int) -> tuple[int, int, int, int]:
    """(pages, page, start, end): at least one page, the page clamped to them."""
    pages = max(1, math.ceil(total / max(1, size)))
    page = min(max(1, page), pages)
    return pages, page, (page - 1) * size, min(total, page * size)


def page_of(rows: DataFrame, size: int, page: int) -> DataFrame:
    """One page of ordered rows, the page clamped to what there is; one count and one limited sort."""
    _, _, start, _ = page_bounds(rows.count(), size, page)
    return rows.offset(start).limit(size)


def page_links(pages: int, page: int) -> list[int | None]:
    """Page numbers to show: first, last and two around the current one; None for a gap."""
    out: list[int | None] = []
    for n in sorted({1, pages} | {n for n in range(page - 2, page + 3) if 1 <= n <= pages}):
        if out and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out


def latest(articles: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Articles published within ``days`` days up to the day of ``as_of``; undated ones are not in it."""
    day = dates.published_day(F.col("published"))
    return articles.where(day.between(F.date_sub(as_of, days - 1), as_of))


def undated(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count_if(dates.published_day(F.col("published")).isNull()).alias("n"))


def used_tags(articles: DataFrame, tags: DataFrame, selected: str = "") -> DataFrame:
    """Tag definitions that some article has, and the selected one."""
    used = articles.select(F.explode("tags.id").alias("id")).distinct()
    return tags.join(used, "id", "left_semi").unionByName(tags.where(F.col("id") == selected)).distinct()


def list_rows(articles: DataFrame) -> DataFrame:
    """What a list shows: date wording, source, title with summary or status, tags or what is missing."""
    success = F.col("summary.status") == "success"
    names = F.array_join(F.transform("tags", lambda t: t["name"]), "、")
    return articles.select(
        "id",
        dates.label_partial(F.col("published")).alias("date"),
        "source_name",
        "title",
        F.when(success, F.col("summary.text")).otherwise(label("summary_status", F.col("summary.status"))).alias("text"),
        F.when(names != "", names).otherwise(F.when(success, "タグなし").otherwise("AI未処理")).alias("tags"),
    )


ROUTES = [
    (r"^#?/?(?:\?(.*))?$", "latest"),
    (r"^#/search(?:\?(.*))?$", "search"),
    (r"^#/articles/([^?]+)$", "article"),
    (r"^#/wiki/([^?]+)$", "tag"),
    (r"^#/wiki$", "wiki"),
    (r"^#/report(?:/([^?]+))?$", "report"),
    (r"^#/status$", "status"),
    (r"^#/sources$", "sources"),
]


def route(hash_: str) -> tuple[str, str]:
    """View and its argument of a link; old links with a query but no view are searches."""
    for pattern, view in ROUTES:
        if m := re.match(pattern, hash_):
            argument = next((g for g in m.groups() if g), "")
            return ("search", argument) if view == "latest" and argument else (view, argument)
    return "latest", ""
