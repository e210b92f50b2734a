import json
import tracemalloc

import pytest

from gleanery.sources import feeds, files, markup

RSS = """<rss><channel><item><title>A</title><link>https://a.jp/1?utm_source=f</link><pubDate>Tue, 01 Sep 2026 10:00:00 +0900</pubDate></item>
<item><title>B</title><link>ftp://a.jp/2</link></item><item><title>C</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>D</title><link rel="self" href="https://a.jp/self"/><link href="https://a.jp/3"/><published>2026-09</published><updated>2026-10-01</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>E</title><link>/4</link><dc:date>2026-09-03</dc:date></item></rdf:RDF>"""


def test_feeds(spark):
    bodies = [("rss", "https://a.jp/", RSS), ("atom", "https://a.jp/", ATOM), ("rdf", "https://a.jp/", RDF), ("bad", "https://a.jp/", "<x"), ("evil", "https://a.jp/", '<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><rss>&e;</rss>')]
    df = spark.createDataFrame([(s, b, x.encode()) for s, b, x in bodies], "source string, base string, body binary")
    got = {(r["source"], r["url"]): r for r in feeds.candidates(df, feeds.feed_items).collect()}
    assert got["rss", "https://a.jp/1"]["published"] == "2026-09-01T10:00:00+09:00"
    assert got["rss", None]["rejected"] == "ftp://a.jp/2"
    assert got["atom", "https://a.jp/3"]["published"] == "2026-09" and got["atom", "https://a.jp/3"]["updated_evidence"] == "<updated>2026-10-01</updated>"
    assert got["rdf", "https://a.jp/4"]["published_evidence"] == "<dc:date>2026-09-03</dc:date>"
    assert got["bad", None]["error"] and "refused" in got["evil", None]["error"]
    assert len(got) == 6


def test_sitemap():
    body = b"<urlset><url><loc>https://a.jp/news/1</loc></url><url><loc>https://a.jp/x</loc></url><url><loc>mailto:x</loc></url></urlset>"
    assert list(feeds.sitemap_items(body, "https://a.jp", ["/news/"])) == [{"url": "https://a.jp/news/1"}, {"rejected": "mailto:x"}]
    with pytest.raises(ValueError):
        list(feeds.sitemap_items(b"<sitemapindex/>", "https://a.jp"))


def test_large_bodies_are_read_piece_by_piece(spark):
    item = "<item><title>T</title><link>/{}</link><x><item><link>/{}/inner</link></item></x></item>"
    body = ("<rss><channel>" + "".join(item.format(k, k) for k in range(30_000)) + "</channel></rss>").encode()
    tracemalloc.start()
    count = sum(1 for _ in feeds.feed_items(body, "https://a.jp/"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 60_000 and len(body) > 2 * feeds._LARGE and peak < len(body)
    df = spark.createDataFrame([("whole", "https://a.jp/", body), ("broken", "https://a.jp/", body[:-9])], "source string, base string, body binary")
    got = feeds.candidates(df, feeds.feed_items).select("source", "position", "url", "error").collect()
    assert [r["position"] for r in got if r["source"] == "broken"] == [0] and got[-1]["error"]
    assert [(r["position"], r["url"]) for r in got[:3]] == [(0, "https://a.jp/0"), (1, "https://a.jp/0/inner"), (2, "https://a.jp/1")]
    assert len(got) == 60_001


def test_large_sitemaps_are_read_piece_by_piece():
    body = ("<urlset>" + "".join(f"<url><loc>/{k}</loc><x>y</x></url>" for k in range(50_000)) + "</urlset>").encode()
    tracemalloc.start()
    count = sum(1 for _ in feeds.sitemap_items(body, "https://a.jp/"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 50_000 and peak < len(body)


LIST = """<body><nav><a href="/nav">nav</a></nav><ul class="news"><li class="card"><span class="date">令和8年9月1日</span><a href="/1"><b class="t">One</b> x</a></li>
<li class="card"><time datetime="2026-09-02">Sept</time><a href="/2#x">Two（令和7年1月1日）</a></li><li class="card"><a href="/2">Again</a></li><li class="card"><a href="javascript:x">js</a></li>
<li><a href="/old/3">Three</a> 2026年9月</li></ul><a class="next" href="?page=2">next</a></body>"""


def test_listing():
    rows, following, repeats = markup.listing(LIST.encode(), "https://a.jp/", {"css_selector": "ul.news", "exclude": ["/old/"]}, "a.next")
    assert [r.get("url") for r in rows] == ["https://a.jp/1", "https://a.jp/2", None] and repeats == 1
    assert rows[0]["published"] == "2026-09-01" and rows[1]["published"] == "2026-09-02" and rows[1]["published_evidence"].startswith("<time")
    assert following == "https://a.jp/?page=2"
    rows, *_ = markup.listing(LIST.encode(), "https://a.jp/", {"item_selector": "li.card", "title_selector": ".t", "include": ["/1$"]})
    assert rows[0]["title"] == "One" and rows[0]["published"] == "2026-09-01"
    rows, *_ = markup.listing(LIST.encode(), "https://a.jp/", {"include": ["/old/"]})
    assert rows[-1]["published"] == "2026-09"


def test_paging():
    pages = {"https://a.jp/": LIST, "https://a.jp/?page=2": LIST.replace("?page=2", "?page=3").replace("/1", "/9")}

    def fetch(url):
        if url not in pages:
            raise OSError("timeout")
        return pages[url].encode()

    rows, n, error = markup.pages_of(fetch, "https://a.jp/", {}, "a.next", 5)
    assert n == 2 and error == "timeout" and any(r.get("url") == "https://a.jp/9" for r in rows)
    assert markup.pages_of(fetch, "https://a.jp/", {}, "a.next", 1)[1:] == (1, None)
    with pytest.raises(OSError):
        markup.pages_of(fetch, "https://a.jp/none", {}, None, 3)


def test_page():
    body = """<html><head><title>T</title><meta property="article:modified_time" content="2026-09-05"></head><body><header>H</header><h1>Head<br>line</h1>
    <main><div class="breadcrumb">x</div><p>公開日：2026年9月1日</p><p>Body&nbsp;text <a href="/a.PDF?v=1">doc</a> <a href="/a.PDF?v=1">again</a></p><script>s()</script></main></body></html>"""
    got = markup.page(body, "https://a.jp/")
    assert got["title"] == "Head line" and got["text"] == "公開日:2026年9月1日\nBody text\ndoc\nagain"
    assert (got["published"], got["published_method"], got["updated"], got["updated_method"]) == ("2026-09-01", "html_text", "2026-09-05", "html_meta")
    assert got["pdf_links"] == [("https://a.jp/a.PDF?v=1", "doc")]
    nuxt = json.dumps([{"data": 1}, {"k": 2}, {"title": 3, "body": 4, "_meta": 5}, "NT", "<p>nuxt body</p>", {"publishedAt": 6}, "2026-09-07"])
    got = markup.page(f'<body><script id="__NUXT_DATA__">{nuxt}</script></body>')
    assert (got["title"], got["text"], got["published"]) == ("NT", "NT\nnuxt body", "2026-09-07")
    assert markup.page("<body></body>")["status"] == "unsupported" and markup.page("")["text"] == ""


def test_extracted_batches(spark):
    df = spark.createDataFrame([(1, "https://a.jp/", "<main>x<a href='/b.pdf'>y</a></main>"), (2, None, None)], "id long, url string, body string")
    got = {r["id"]: r for r in markup.extracted(df).collect()}
    assert got[1]["text"] == "x\ny" and got[1]["pdf_links"][0]["url"] == "https://a.jp/b.pdf" and got[2]["status"] == "unsupported"
    assert markup.pdf_text(b"%PDF-")["status"] == "unsupported"


def test_files(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/run_1.json").write_text(json.dumps({"schema_version": 1, "run": {"run_id": "run_1", "status": "partial", "sources": []}}, indent=1))
    (tmp_path / "runs/run_2.json").write_text(json.dumps({"schema_version": 1, "run": {"run_id": "run_2", "status": "success", "sources": []}}))
    (tmp_path / "runs/run_3.json").write_text("{broken")
    runs = files.json_documents(spark, f"{tmp_path}/runs", "run")
    assert {r["file"]: r["broken"] is not None for r in runs.collect()} == {"run_1.json": False, "run_2.json": False, "run_3.json": True}
    assert files.newest_run(runs.where("run is not null")).first()["status"] == "success"
    (tmp_path / "a.yaml").write_text("a: 2026-01-01\nb: [1]\n")
    (tmp_path / "b.yaml").write_text("a: 1\na: 2\n")
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.yaml").write_text("a: over\n")
    assert files.config_file(tmp_path / "a.yaml") == {"a": "2026-01-01", "b": [1]}
    with pytest.raises(files.DuplicateKey):
        files.config_file(tmp_path / "b.yaml")
    assert files.config_file(files.config_path("a.yaml", tmp_path, tmp_path / "o")) == {"a": "over"}
    assert files.config_path("b.yaml", tmp_path, tmp_path / "o") == tmp_path / "b.yaml"
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a_1_v2.txt").write_text("x\ny")
    assert [tuple(r) for r in files.cached_texts(spark, f"{tmp_path}/t").collect()] == [("a_1", 2, "x\ny")]
    assert files.dataset_folder("real", "/r") == ("/r/data", None)


def test_fixture_responses(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>hi</p>")
    routes = [{"url": "u1", "file": "p.html", "type": "text/html"}, {"url": "u2", "redirect": "u1"}, {"url": "u3", "timeout": True}, {"url": "u4", "status": 404}, {"url": "u5", "redirect": "u5"}]
    asked = spark.createDataFrame([(f"u{k}",) for k in range(1, 7)], "url string")
    got = {r["url"]: (r["final_url"], r["error"], r["body"] and bytes(r["body"])) for r in files.fixture_responses(spark, routes, str(tmp_path), asked).collect()}
    assert got["u1"] == got["u1"][:1] + (None, b"<p>hi</p>") and got["u2"][0] == "u1" and got["u2"][2] == b"<p>hi</p>"
    assert [got[f"u{k}"][1] for k in (3, 4, 5, 6)] == ["timeout", "HTTP 404", "too many redirects", "HTTP 404"]
