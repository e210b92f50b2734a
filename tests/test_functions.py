import unicodedata
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import dates, text, urls


def column(spark, values, f, kind="string"):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1).select("i", f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "raw, value, precision",
    [
        ("2026", "2026", "year"),
        ("2026-09", "2026-09", "month"),
        (" 2026-09-01 ", "2026-09-01", "day"),
        ("2026-09-01T10:30:00+09:00", "2026-09-01T10:30:00+09:00", "datetime"),
        ("2026-09-01T10:30:00Z", "2026-09-01T10:30:00+00:00", "datetime"),
        ("2026-09-01 10:30", "2026-09-01T10:30:00+09:00", "datetime"),
        ("2026-09-01T10:30:00.123-0500", "2026-09-01T10:30:00-05:00", "datetime"),
        ("2026-13", None, None),
        ("2026-02-30", None, None),
        ("2026-09-01T25:00:00Z", None, None),
        ("2026/09/01", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_iso(spark, raw, value, precision):
    got = column(spark, [raw], dates.parse_iso)[0]
    assert (got and tuple(got)) == ((value, precision) if value else None)
    assert dates.parse_iso_text(raw or "") == value


@pytest.mark.parametrize(
    "raw, want",
    [
        ("令和8年9月1日", ("2026-09-01", "day", "令和8年9月1日")),
        ("公表 令和元年５月１日まで", ("2019-05-01", "day", "令和元年5月1日")),
        ("平成31年4月30日", ("2019-04-30", "day", "平成31年4月30日")),
        ("２０２６／０９／０１", ("2026-09-01", "day", "2026/09/01")),
        ("R8.9.1", ("2026-09-01", "day", "R8.9.1")),
        ("2026年13月40日 2026年9月2日", ("2026-09-02", "day", "2026年9月2日")),
        ("令和8年9月号", ("2026-09", "month", "令和8年9月")),
        ("26/9/1", None),
        ("no date", None),
        (None, None),
    ],
)
def test_japanese(raw, want):
    assert dates.japanese_date(raw) == want


def test_rfc822_and_any(spark):
    got = column(spark, ["Tue, 01 Sep 2026 10:00:00 +0900", "2026-09", "令和8年9月1日", "x", ""], dates.parse_any)
    assert got == ["2026-09-01T10:00:00+09:00", "2026-09", "2026-09-01", None, None]


@given(st.dates(date(1950, 1, 1), date(2090, 12, 31)))
@settings(max_examples=200)
def test_era_round_trip(d):
    if d >= date(2019, 5, 1):
        assert dates.japanese_date(f"令和{d.year - 2018}年{d.month}月{d.day}日")[0] == d.isoformat()
    assert dates.japanese_date(f"{d.year}.{d.month}.{d.day}")[0] == d.isoformat()
    assert dates.parse_iso_text(d.isoformat()[:7]) == d.isoformat()[:7]


def test_ranges_and_days(spark):
    values = ["2026", "2024-02", "2026-09-21T16:00:00+00:00", "2026-09-21", None]
    assert column(spark, values, lambda v: dates.range_lo(v)) == [date(2026, 1, 1), date(2024, 2, 1), date(2026, 9, 22), date(2026, 9, 21), None]
    assert column(spark, values, lambda v: dates.range_hi(v)) == [date(2026, 12, 31), date(2024, 2, 29), date(2026, 9, 22), date(2026, 9, 21), None]
    assert column(spark, values, lambda v: dates.range_lo(v, literal=True))[2] == date(2026, 9, 21)
    assert column(spark, values, dates.published_day) == [None, None, date(2026, 9, 22), date(2026, 9, 21), None]
    assert column(spark, values, lambda v: dates.in_period(v, "2026-09-22", None)) == [True, False, True, False, None]
    assert column(spark, values, lambda v: dates.overlaps(v, "2026-09-22", "")) == [True, False, False, False, False]
    assert column(spark, values, lambda v: dates.overlaps(v, "", "")) == [True] * 5
    assert column(spark, values, dates.label_partial) == ["2026年（月日不明）", "2024年2月（日不明）", "2026年9月21日", "2026年9月21日", "日付不明"]


@given(st.dates(date(2020, 1, 1), date(2027, 1, 1)), st.integers(0, 200), st.integers(1, 60))
@settings(max_examples=15, deadline=None)
def test_windows_cover_without_overlap(spark, as_of, back, days):
    earliest = as_of - timedelta(days=back)
    row = spark.range(1).select(dates.week_windows(F.lit(as_of), F.lit(earliest), days).alias("w")).first()["w"]
    assert row[0]["to"] == as_of and len(row) <= 12
    for a, b in zip(row, row[1:]):
        assert b["to"] == a["from"] - timedelta(days=1)
    assert all((w["to"] - w["from"]).days == days - 1 for w in row)
    assert len(row) == 12 or row[-1]["from"] <= earliest
    assert all(w["from"] > earliest for w in row[:-1])


def test_stored_and_merged(spark):
    got = spark.range(1).select(dates.stored(F.lit("2026-09-21T16:00:00+00:00"), F.lit("e" * 300)).alias("s"), *dates.merged_dates(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), dates.chosen_date(F.lit(None), F.lit("page"), F.lit("pdf_metadata"), F.lit("list"))).first()
    assert got["s"]["value"] == "2026-09-22T01:00:00+09:00" and len(got["s"]["evidence"]) == 200 and got["s"]["precision"] == "datetime"
    assert tuple(got)[1:] == ("a", "d", "list")


def test_hash_text(spark):
    raw = ["a\r\nb\rc", " x \t　y ", "a\n\n\n\n\nb", "e\u0301", "a\u0085b", None]
    assert column(spark, raw, text.hash_text) == ["a\nb\nc", "x y", "a\n\n\nb", "é", "a\u0085b", None]
    got = column(spark, ["ｱ１\n\n b\u2028c", "A"], text.content_hash)
    import hashlib

    assert got == ["sha256:" + hashlib.sha256(x.encode()).hexdigest() for x in ("ア1\nb\nc", "A")]
    fields = spark.range(1).select(text.hash_fields(F.lit("t"), F.lit("b"), F.lit("html"), F.lit("ok"), F.array(F.struct(F.lit("ok").alias("status")))).alias("a"), text.hash_fields(F.lit("t"), F.lit(""), F.lit("html"), F.lit("ok"), F.lit(None).cast("array<struct<status:string>>")).alias("b")).first()
    assert fields["a"]["scope"] == "title+main_text+attachments" and fields["a"]["hash"] == hashlib.sha256(b"t\nb").hexdigest()
    assert tuple(fields["b"]) == (None, "unavailable", None)


def test_cells_and_marks(spark):
    assert column(spark, ["a", "=1", " +1", "\tx", 'q"r', "a,b", "-", "＝", None], text.csv_cell) == ["a", "'=1", "' +1", "'\tx", '"q""r"', '"a,b"', "'-", "＝", ""]
    assert column(spark, ["a_b*c\nd", "[x](y)"], text.markdown) == ["a\\_b\\*c d", "\\[x\\]\\(y\\)"]
    assert column(spark, ["a b(c)<d>"], text.markdown_url) == ["a%20b%28c%29%3Cd%3E"]
    assert column(spark, ["<b>x</b> &amp;  y", "<i></i>"], text.plain_text) == ["x & y", "<i></i>"]
    assert column(spark, ["a  b", "x" * 130], text.short) == ["a b", "x" * 119 + "…"]
    assert column(spark, ["𠮷a", "é"], text.utf16_length) == [3, 1]
    assert column(spark, ["javascript:x", "https://a", "#top", "HTTP://b"], text.safe_href) == ["#", "https://a", "#top", "HTTP://b"]
    assert column(spark, ["サイズ上限を超過", "添付の取得", "x"], text.retry_kind) == ["size_limit", "attachment", "other"]
    assert column(spark, ["</script>&\u2028"], text.embedded_json) == ["\\u003c/script\\u003e\\u0026\\u2028"]
    assert column(spark, ["sk-" + "a" * 16, "sk-short", "my-value-12"], lambda v: text.has_secret(v, ["my-value-12", "short"])) == [True, False, True]


def test_excerpt_is_cut_by_utf16_units(spark):
    long = "𠮷" * 600
    got = spark.range(1).select(text.excerpt(F.lit("success"), F.lit(long), F.array()), text.excerpt(F.lit("success"), F.lit("s"), F.array(F.lit("p"), F.lit(""), F.lit("q"))), text.excerpt(F.lit("failed"), F.lit("s"), F.array())).first()
    assert got[0].endswith("…") and got[1] == "s 【主な論点】p / q" and got[2] == ""


URLS = [
    ("HTTPS://Example.GO.JP:443/a/?utm_source=x&b=1#top", "https://example.go.jp/a/?b=1"),
    ("http://example.jp", "http://example.jp/"),
    ("http://example.jp:8080/x", "http://example.jp:8080/x"),
    ("https://example.jp./a?UTM_Medium=1&fbclid=2&ref=3", "https://example.jp/a?ref=3"),
    ("https://example.jp/a?b=&c", "https://example.jp/a?b=&c="),
    ("ftp://example.jp/", None),
    ("javascript:void(0)", None),
    ("https://user:pw@example.jp/", None),
    ("https://", None),
    (None, None),
]


def test_urls(spark):
    assert [urls.canonical(u) for u, _ in URLS] == [w for _, w in URLS]
    assert column(spark, [u for u, _ in URLS], urls.canonical_url) == [w for _, w in URLS]
    simple = [(u, w) for u, w in URLS if u and ":443" not in u and "@" not in u]
    assert column(spark, [u for u, _ in simple], urls.simple_canonical_url) == [w for _, w in simple]
    assert urls.canonical("../b.html", "https://a.jp/x/y/") == "https://a.jp/x/b.html"
    assert [urls.is_private(h) for h in ("localhost", "10.0.0.1", "127.0.0.1", "a.internal", "8.8.8.8", "example.jp", "[::1]")] == [True, True, True, True, False, False, True]
    got = column(spark, ["https://a.jp/", "https://b.jp/", "http://10.0.0.1/"], lambda u: urls.allowed(u, F.array(F.lit("A.jp"), F.lit("10.0.0.1"))))
    assert got == [True, False, False]
    assert column(spark, ["/news/1", "/news/old", "/x"], lambda u: urls.selected(u, ["^/news/"], ["old$"])) == [True, False, False]
    assert unicodedata.normalize("NFKC", column(spark, ["ＡＢ"], text.searchable)[0]) == "ab"
