import json

import pytest

from gleanery.operators import sinks
from gleanery.sources import web
from gleanery.sources.web import Fetcher, Raw, Refused

PAGES = {
    "https://a.jp/robots.txt": (200, {}, b"User-agent: *\nDisallow: /private"),
    "https://a.jp/1": (200, {"content-type": "text/html"}, b"one"),
    "https://a.jp/to1": (302, {"location": "/1"}, b""),
    "https://a.jp/out": (302, {"location": "https://evil.jp/"}, b""),
    "https://a.jp/loop": (302, {"location": "/loop"}, b""),
    "https://a.jp/big": (200, {}, b"x" * 101),
    "https://b.jp/x": (200, {}, b"bee"),
}


def opener(url, timeout):
    status, headers, body = PAGES.get(url, (404, {}, b""))
    return Raw(status, headers, lambda n: body[:n])


def fetcher(**k):
    slept = []
    return Fetcher({"a.jp", "B.jp", "10.0.0.1"}, wait=5, max_bytes=100, opener=opener, sleep=slept.append, clock=lambda: 0.0, **k), slept


def test_fetcher():
    f, slept = fetcher()
    assert f.fetch("https://a.jp/1#x").body == b"one" and slept == [5.0]
    assert f.fetch("https://a.jp/to1").url == "https://a.jp/1"
    assert f.fetch("https://b.jp/x").body == b"bee"
    for url, kind, word in (("https://a.jp/private/1", Refused, "robots"), ("https://a.jp/out", Refused, "evil.jp"), ("http://10.0.0.1/", Refused, "not allowed"), ("ftp://a.jp/", Refused, "not allowed"), ("https://a.jp/loop", OSError, "redirects"), ("https://a.jp/big", OSError, "larger"), ("https://a.jp/none", OSError, "HTTP 404")):
        with pytest.raises(kind, match=word):
            f.fetch(url)


def test_fetched(spark):
    df = spark.createDataFrame([("https://a.jp/1",), ("https://a.jp/none",), ("https://b.jp/x",)], "url string")
    got = {r["url"]: (r["status"], r["error"]) for r in web.fetched(df, lambda: Fetcher({"a.jp", "b.jp"}, wait=0, opener=opener)).collect()}
    assert got == {"https://a.jp/1": (200, None), "https://a.jp/none": (None, "HTTP 404"), "https://b.jp/x": (200, None)}


def test_sinks(spark, tmp_path):
    bodies = spark.createDataFrame([("a", 1, "x"), ("a", 1, "again"), ("b", 1, None)], "article_id string, version int, text string")
    assert sinks.cache_texts(bodies, f"{tmp_path}/t") == 2 and sinks.cache_texts(bodies, f"{tmp_path}/t") == 0
    records = spark.createDataFrame([("a", "success")], "article_id string, status string")
    names = spark.createDataFrame([("n1", "a", "t1"), ("n1", "b", "t2"), ("n2", "b", "t2")], "name string, article_id string, first_seen_at string")
    assert sinks.commit_summaries(records, names, f"{tmp_path}/s") == (1, 2) and sinks.commit_summaries(records, names, f"{tmp_path}/s") == (1, 0)
    assert spark.read.parquet(f"{tmp_path}/s/summaries").count() == 2
    whole = spark.createDataFrame([("a", 1, "t1", "failed_refusal"), ("a", 1, "t2", "success")], "article_id string, article_version int, processed_at string, analysis_status string")
    assert sinks.commit_summaries(whole.limit(1), names.limit(0), f"{tmp_path}/w") == (1, 0)
    assert sinks.commit_summaries(whole, names.limit(0), f"{tmp_path}/w") == (1, 0) and sinks.commit_summaries(whole, names.limit(0), f"{tmp_path}/w") == (0, 0)
    sinks.comparison(records, spark.createDataFrame([("a", "T")], "article_id string, title string"), f"{tmp_path}/c")
    line = next((tmp_path / "c").glob("part-*.json")).read_text()
    assert json.loads(line) == {"article_id": "a", "status": "success", "title": "T"}
    sinks.text_file(spark.createDataFrame([("1,2",)], "line string"), "a,b", f"{tmp_path}/f.csv")
    assert (tmp_path / "f.csv").read_bytes() == b"\xef\xbb\xbfa,b\r\n1,2\r\n"
