"""Queries over small tables whose rows an input cut would lose."""

import datetime

import pytest

from gleanery.plans.catalog import ORACLES, QUERIES
from gleanery.sources import feeds


def tables(spark, path, **found):
    for name, (rows, schema) in found.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_rule_tags_of_long_documents(spark, tmp_path):
    long = "x " * 15_000 + "the end"
    path = tables(spark, tmp_path, documents=([(1, long, "en", "src10", len(long)), (2, "der Hut", "de", "s", 7), (3, "no", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = QUERIES["rule_tags_match"](spark, path).collect()
    assert sorted((r["doc_id"], r["tag_id"]) for r in got) == [(1, "articles"), (1, "sources"), (2, "articles")]


def test_search_of_long_documents(spark, tmp_path):
    long = "x " * 4_000 + "The man"
    path = tables(spark, tmp_path, documents=([(1, long, "en", "s", len(long)), (2, "an other", "en", "s", 8), (3, "x", "en", "s", 1), (4, "the man", "de", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r["doc_id"] for r in QUERIES["search_terms_all"](spark, path).collect()) == [1, 2]


def test_runs_of_every_source_and_week(spark, tmp_path):
    end = datetime.datetime(2024, 6, 30, 3)
    at = lambda weeks: end - datetime.timedelta(days=7 * weeks)
    events = [(1, at(0), 3, "click"), (2, at(11), 900, "error"), (3, at(11), 900, "view"), (4, at(20), 22, "error")]
    path = tables(spark, tmp_path, events=(events, "event_id long, ts timestamp, user_id long, event_type string"))
    got = {(r["k"], r["user_id"]): (r["runs"], r["failed"]) for r in QUERIES["weekly_source_runs"](spark, path).collect()}
    want = {(k, u): (0, 0) for k in range(12) for u in (3, 22, 900)}
    assert got == want | {(0, 3): (1, 0), (11, 900): (2, 1)}


def test_pages_of_whole_urls(spark, tmp_path):
    pages = [(3, "https://a.org/p1?utm_source=x"), (2, "https://A.org/p1#top"), (5, "https://a.org/p2"), (7, "https://a.org/p20")]
    path = tables(spark, tmp_path, pages=(pages, "page_id long, url string"))
    got = sorted(map(tuple, QUERIES["dedupe_keep_first_url"](spark, path).select("url", "page_id", "duplicates").collect()))
    assert got == [("https://a.org/p1", 2, 1), ("https://a.org/p2", 5, 0), ("https://a.org/p20", 7, 0)]


def test_counts_of_all_suppliers_and_nations_without(spark, tmp_path):
    path = tables(spark, tmp_path, supplier=([(1, 0, 5.0), (2, 0, -1.0), (3, 0, 2.0)], "s_suppkey long, s_nationkey int, s_acctbal double"), nation=([(0, "A"), (1, "B")], "n_nationkey int, n_name string"))
    got = sorted(map(tuple, QUERIES["source_counts_with_zero"](spark, path).select("n_nationkey", "articles", "date_unknown").collect()))
    assert got == [(0, 3, 1), (1, 0, 0)]


def test_all_orders_are_runs_and_csv_rows(spark):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert QUERIES["external_csv_rows"](spark, folder).count() == orders.count()
    weeks = QUERIES["weekly_new_counts"](spark, folder)
    days = [str(r[0])[:10] for r in orders.select("o_orderdate").collect()]
    assert all(r["runs"] == sum(r["from"] <= d <= r["to"] for d in days) for r in weeks.collect())


def test_answers_to_short_blank_and_composed_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["A.", "", None, " \u3000\n", "abc", "ab   ", "x\n" + " " * 40 + "y", "ae\u0301", "e\u0301" * 40, "\uff76\uff9e" * 40, "\u1100\u1161\u11a8" * 20, "a\U0001f600" * 30]
    docs = [(8 * n + k, x, "en", "s", len(x or "")) for n, x in enumerate(texts) for k in range(8)]
    path = tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, problem, notes, dates, tags FROM ({ORACLES['judged_answers']})").fetchall()
    assert sorted(map(tuple, QUERIES["judged_answers"](spark, path).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["feed_scan", "sitemap_scan"])
def test_large_sources_come_in_several_bodies(spark, tmp_path, monkeypatch, name):
    duckdb = pytest.importorskip("duckdb")
    day = datetime.datetime(1995, 5, 1)
    keys = [*range(2_500), *[7] * 1_200, *range(60_000, 60_100), 10**10, -5]
    path = tables(spark, tmp_path, customer=([(1, 3), (2, 4)], "c_custkey long, c_nationkey int"), orders=([(k, 1 + (k % 100 == 99), day) for k in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp"))
    sizes, whole = [], feeds.candidates

    def counted(bodies, parse, **options):
        sizes.extend(r["body"].count(b"<item>") + r["body"].count(b"<entry>") + r["body"].count(b"<url>") for r in bodies.collect())
        return whole(bodies, parse, **options)

    monkeypatch.setattr(feeds, "candidates", counted)
    got = QUERIES[name](spark, path)
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(sizes) == len(keys) and max(sizes) == 1_000
