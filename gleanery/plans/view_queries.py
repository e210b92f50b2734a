"""Queries of views and of text, date and tag functions over the driver's tables, with DuckDB SQL.

Values that Unicode normalisation changes are made from plain ones by ``translate`` on the Spark side, so the SQL can
state the expected result without normalising.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import dates, text, urls
from gleanery.operators import rules as R
from gleanery.operators import search as Q
from gleanery.operators import sinks as SK
from gleanery.operators import summaries as SU
from gleanery.operators import tags as G
from gleanery.operators import versions as V
from gleanery.plans import weekly as WK
from gleanery.plans.queries import ARTICLES_SQL, order_weeks, orders_as_articles
from gleanery.plans.registry import query, shared_folder

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: The same letters in full width, which NFKC turns back.
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in LETTERS)
A_SQL = ARTICLES_SQL.split("), w AS")[0] + ")"


def widened(c):
    return F.translate(c, LETTERS, WIDE)


# ---------------------------------------------------------------- search and lists


@query(f"""WITH {A_SQL}, h AS (SELECT *, CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE o_orderpriority || '、archived' END AS names FROM a WHERE contains(lower('order ' || id || chr(10) || source_name), '17') AND contains(lower('order ' || id || chr(10) || source_name), 'customer#') AND published IS NOT NULL
  AND CASE length(published) WHEN 4 THEN published || '-12-31' WHEN 7 THEN published || '-31' ELSE substr(published, 1, 10) END >= '1996-01-01' AND rpad(substr(published, 1, 10), 10, CASE length(published) WHEN 4 THEN '-01-01' ELSE '-01' END) <= '1996-12-31'),
u AS (SELECT count(*) AS undated FROM a WHERE contains('order ' || id || chr(10) || lower(source_name), '17') AND contains(lower('order ' || id || chr(10) || source_name), 'customer#') AND published IS NULL)
SELECT id, CASE length(published) WHEN 4 THEN published || '年（月日不明）' WHEN 7 THEN substr(published, 1, 4) || '年' || CAST(substr(published, 6, 2) AS INTEGER) || '月（日不明）' ELSE substr(published, 1, 4) || '年' || CAST(substr(published, 6, 2) AS INTEGER) || '月' || CAST(substr(published, 9, 2) AS INTEGER) || '日' END AS date,
  CASE WHEN o_orderstatus = 'P' THEN '未要約（AI処理なし）' ELSE 'total ' || o_orderstatus END AS text, CASE WHEN names <> '' THEN names WHEN o_orderstatus = 'P' THEN 'AI未処理' ELSE 'タグなし' END AS tags, n AS total, undated
FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY published DESC, seen DESC, id) - 1 AS place FROM h), u WHERE place // 20 = least(1, (n - 1) // 20)""")
def search_view(t):
    """A search from a query string to the rows of its second page. Titles,
    sources and the terms are in full width; NFKC and case folding make them meet."""
    a = orders_as_articles(t).withColumns({"title": widened(F.col("title")), "source_name": widened(F.upper("source_name"))})
    f = Q.Filters.parse("?q=%EF%BC%91%EF%BC%97+Customer%23&from=1996-01-01&to=1996-12-31&page=2&tag=")
    hits = Q.search(a, f)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = Q.list_rows(Q.page_of(Q.newest_first(hits), 20, f.page)).select("id", "date", "text", "tags")
    return page.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(Q.undated_excluded(a, f).select(F.col("n").alias("undated"))))


@query(f"""WITH {ARTICLES_SQL}, m AS (SELECT k, 'new' AS kind, id, o_orderkey, day, seen, o_orderstatus FROM a JOIN w ON day BETWEEN lo AND hi UNION ALL SELECT k, 'changed', id, o_orderkey, day, seen, o_orderstatus FROM a JOIN w ON changed_on BETWEEN lo AND hi WHERE o_orderkey % 3 = 0 AND day IS NOT NULL AND NOT day BETWEEN lo AND hi)
SELECT CAST(k AS INTEGER) AS k, kind, id, 'order ' || id AS title, CASE kind WHEN 'changed' THEN '2' END AS version, CASE o_orderstatus WHEN 'P' THEN 'not_processed' ELSE 'success' END AS summary_status FROM m WHERE k = 1""")
def report_items(t):
    """The items of one chosen week."""
    a = orders_as_articles(t)
    weeks = order_weeks(t, a)
    second = weeks.where("k = 1").select(F.concat_ws("_", F.date_format("from", "yyyy-MM-dd"), F.date_format("to", "yyyy-MM-dd"))).first()
    week = WK.selected_week(weeks, second[0] if second else None)
    return WK.items(week, a, 7).select("k", "kind", "id", "title", F.col("version").cast("string").alias("version"), "summary_status")


@query(f"""WITH {ARTICLES_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY day DESC, seen DESC, id) AS place FROM a JOIN w ON k = 0 AND day BETWEEN lo AND hi) SELECT id, place FROM n""")
def report_order(t):
    """O2: the newest week's new articles by published day and first sight, newest first."""
    from pyspark.sql import Window as W

    a = orders_as_articles(t)
    new = WK.items(order_weeks(t, a).where("k = 0"), a, 7).where("kind = 'new'")
    place = F.row_number().over(W.orderBy(*WK.item_order()))
    return new.select("id", place.cast("long").alias("place"))


@query("""WITH r AS (SELECT n_nationkey AS k FROM nation) SELECT k, CASE k % 9 WHEN 0 THEN 'latest' WHEN 1 THEN 'search' WHEN 2 THEN 'article' WHEN 3 THEN 'tag' WHEN 4 THEN 'wiki' WHEN 5 THEN 'report' WHEN 6 THEN 'search' WHEN 7 THEN 'status' ELSE 'latest' END AS view,
  CASE k % 9 WHEN 1 THEN 'q=n' || k WHEN 2 THEN 'a_' || k WHEN 3 THEN 't' || k WHEN 6 THEN 'q=old' || k ELSE '' END AS argument,
  CASE k % 9 WHEN 1 THEN 'n' || k WHEN 6 THEN 'old' || k ELSE '' END AS q FROM r""")
def routes(t):
    """links to views, old ones with a query among them, and the filters in them."""

    def run(batches):
        for batch in batches:
            rows = []
            for k in batch["n_nationkey"]:
                link = [
                    f"#/",
                    f"#/search?q=n{k}",
                    f"#/articles/a_{k}",
                    f"#/wiki/t{k}",
                    "#/wiki",
                    "#/report",
                    f"#/?q=old{k}",
                    "#/status",
                    "#nothing",
                ][k % 9]
                view, argument = Q.route(link)
                rows.append((k, view, argument, Q.Filters.parse(argument).q if view == "search" else ""))
            yield pd.DataFrame(rows, columns=["k", "view", "argument", "q"])

    return t("nation").select("n_nationkey").mapInPandas(run, "k int, view string, argument string, q string")


@query("""WITH p AS (SELECT CAST(p AS INTEGER) AS page FROM range(1, 13) r(p)), n AS (SELECT page, unnest(list_sort(list_distinct([1, 12] || list_filter([page - 2, page - 1, page, page + 1, page + 2], lambda x: x BETWEEN 1 AND 12)))) AS n FROM p),
g AS (SELECT page, n, lag(n) OVER (PARTITION BY page ORDER BY n) AS b FROM n) SELECT page, string_agg(CASE WHEN n - b > 1 THEN '… ' ELSE '' END || n, ' ' ORDER BY n) AS links FROM g GROUP BY page""")
def pager_window(t):
    """First, last and neighbouring pages with gaps, for each page of twelve."""
    rows = [(page, " ".join("…" if n is None else str(n) for n in Q.page_links(12, page))) for page in range(1, 13)]
    return t("region").sparkSession.createDataFrame(rows, "page int, links string")


@query("SELECT CAST(n AS INTEGER) AS attempt, least(pow(2, n), 30) AS seconds FROM range(0, 9) r(n)")
def backoff_seconds(t):
    """Waits between attempts double up to half a minute."""
    return t("region").sparkSession.createDataFrame([(n, float(SU.backoff(n))) for n in range(9)], "attempt int, seconds double")


@query("""SELECT 'a' || p_partkey AS id, CASE WHEN p_size < 5 THEN 'x' WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS fixed, CASE WHEN p_size < 5 THEN 'unknown' WHEN p_brand = 'Brand#1' THEN '' ELSE '情報源の設定：' || p_type || 'の記事すべてに付けています' END AS reason FROM part WHERE p_size >= 5 AND p_brand <> 'Brand#1'""")
def fixed_tags(t):
    """Tags that a source gives to all of its articles, with the reason."""
    p = t("part")
    source = F.concat("p_type", F.lit("|"), "p_brand")
    articles = p.where("p_size >= 5").select(F.concat(F.lit("a"), "p_partkey").alias("article_id"), source.alias("source_id"))
    sources = p.select(
        source.alias("source_id"),
        F.col("p_type").alias("name"),
        F.when(F.col("p_brand") == "Brand#1", F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("fixed_tags"),
    ).distinct()
    return G.fixed_tags(articles, sources).select(F.col("article_id").alias("id"), F.col("tag_id").alias("fixed"), "reason")


@query("SELECT DISTINCT p_brand AS tag_id FROM part WHERE length(p_brand) = 8 AND p_brand <> 'Brand#13'")
def selectable_tags(t):
    """tags that AI may choose: enabled and not left to rules."""
    b = t("part").select(F.col("p_brand").alias("tag_id")).distinct()
    return G.selectable(
        b.select("tag_id", (F.length("tag_id") == 8).alias("enabled"), F.when(F.col("tag_id") == "Brand#13", True).alias("rule_only"))
    ).select("tag_id")


@query("""SELECT r_regionkey AS k, 'rule ' || r_regionkey AS label, 'r' || r_regionkey AS tag_id, CASE r_regionkey WHEN 4 THEN 4 ELSE 1 + r_regionkey END AS place FROM region WHERE r_regionkey <> 3""")
def rules_in_order(t):
    """Rules of enabled tags in written order; their version changes with them."""
    names = [r[0] for r in t("region").orderBy("r_regionkey").select("r_regionkey").collect()]
    tags = [{"id": f"r{k}", "enabled": k != 3, "auto_rules": [{"label": f"rule {k}", "pattern": str(k)}]} for k in names]
    rules = R.load_rules(tags)
    if R.rules_version(rules) == R.rules_version(rules[1:]) or R.rules_version(rules) != R.rules_version([dict(r) for r in rules]):
        raise AssertionError("versions of rules")
    rows = [(int(r["tag_id"][1:]), r["label"], r["tag_id"], n) for n, r in enumerate(rules, 1)]
    return t("region").sparkSession.createDataFrame(rows, "k int, label string, tag_id string, place int")


# ---------------------------------------------------------------- text


@query("""SELECT event_id, lower(event_type || ' ' || user_id) AS searchable, event_type || user_id AS squeezed, CASE event_id % 4 WHEN 0 THEN event_type || ' & <' || user_id || '>' WHEN 1 THEN '<br>' ELSE event_type || ' ' || user_id END AS plain,
  CASE WHEN event_id % 2 = 0 THEN repeat('x', 119) || '…' ELSE event_type || ' a b' END AS short FROM events""")
def text_functions(t):
    """Folding for search and evidence, markup out of evidence, cut texts."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    wide = widened(F.concat("event_type", F.lit(" "), user))
    marked = F.when(
        k % 4 == 0,
        F.concat(F.lit("<b>"), "event_type", F.lit(" &amp;\n &lt;"), user, F.lit("&gt;</b> ")),
    ).when(k % 4 == 1, "<br>").otherwise(F.concat(F.lit("<time datetime='x'>"), "event_type", F.lit("</time>\t "), user))
    long = F.when(k % 2 == 0, F.repeat(F.lit("x"), 121)).otherwise(F.concat(F.lit("  "), "event_type", F.lit("\n a \t b ")))
    return t("events").select(
        "event_id",
        text.searchable(wide).alias("searchable"),
        text.squeezed(F.concat(F.lit("　"), wide, F.lit(" \n"))).alias("squeezed"),
        text.plain_text(marked).alias("plain"),
        text.short(long).alias("short"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'size_limit' WHEN event_id % 5 = 1 THEN 'attachment' ELSE 'other' END AS retry, CASE event_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pdf' ELSE 'html' END AS kind,
  substr('＜document>' || event_type || '＜/document> ' || repeat('y', 30000), 1, 20000) AS prompt, CASE event_id % 4 WHEN 0 THEN 'https://a.jp/' || event_id WHEN 1 THEN '#/x' ELSE '#' END AS href,
  '{"a": "' || chr(92) || 'u003c' || event_type || chr(92) || 'u0026' || chr(92) || 'u2028"}' AS embedded FROM events""")
def classified_texts(t):
    """Kinds of failures and documents, texts for prompts, safe links, JSON within pages."""
    k = F.col("event_id")
    reason = F.when(k % 5 == 0, "サイズ上限を超過（添付）").when(k % 5 == 1, "添付PDFの取得に失敗").otherwise("HTTP 500")
    kind = text.document_type(
        F.when(k % 4 == 0, "Application/PDF").otherwise("text/html"),
        F.when(k % 4 == 1, "https://a.jp/X.PDF").otherwise("https://a.jp/x"),
        F.when(k % 4 == 2, "%PDF-1.7").otherwise("<html>"),
    )
    prompt = text.prompt_text(F.concat(F.lit("<document>"), "event_type", F.lit("</document> "), F.repeat(F.lit("y"), 30000)))
    href = text.safe_href(
        F.when(
            k % 4 == 0,
            F.concat(F.lit("https://a.jp/"), k),
        ).when(k % 4 == 1, "#/x").when(k % 4 == 2, "javascript:x()").otherwise("data:text/html,x")
    )
    json_ = F.concat(F.lit('{"a": "<'), "event_type", F.lit('& "}'))
    return t("events").select(
        "event_id",
        text.retry_kind(reason).alias("retry"),
        kind.alias("kind"),
        prompt.alias("prompt"),
        href.alias("href"),
        text.embedded_json(json_).alias("embedded"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '要約済み' WHEN 1 THEN '未要約（AI APIエラー）' ELSE 'strange' END AS summary, CASE c_custkey % 2 WHEN 0 THEN '本文取得済み' ELSE '本文未取得（未対応の形式）' END AS content, CASE c_custkey % 2 WHEN 0 THEN '一覧に見当たらない' ELSE '自動取得の対象外' END AS article,
  CASE c_custkey % 2 WHEN 0 THEN 'RSSの公開日' ELSE 'ページに埋め込まれたデータ' END AS method, CASE c_custkey % 2 WHEN 0 THEN '月まで' ELSE '不明' END AS "precision", CASE c_custkey % 4 WHEN 0 THEN 'AI' WHEN 1 THEN '人が追加' WHEN 2 THEN '設定' ELSE '一致' END AS origin, CASE c_custkey % 2 WHEN 0 THEN '一部失敗' ELSE '実行中' END AS run FROM customer""")
def wording(t):
    """The wording of statuses, methods, precisions and origins; unknown values stand for themselves."""
    k = F.col("c_custkey")
    two = lambda a, b: F.when(k % 2 == 0, a).otherwise(b)
    three = F.when(k % 3 == 0, "success").when(k % 3 == 1, "failed_api_error").otherwise("strange")
    origin = F.when(k % 4 == 0, "ai").when(k % 4 == 1, "human").when(k % 4 == 2, "source").otherwise("rule")
    shown = {
        "summary": ("summary_status", three),
        "content": ("content_status", two("ok", "unsupported")),
        "article": ("article_status", two("missing_from_listing", "unsupported")),
        "method": ("date_method", two("rss_pubdate", "page_data")),
        "precision": ("precision", two("month", "unknown")),
        "origin": ("origin", origin),
        "run": ("run_status", two("partial", "running")),
    }
    return t("customer").select("c_custkey", *(text.label(kind, value).alias(name) for name, (kind, value) in shown.items()))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'https://e.org/' || c_custkey WHEN 2 THEN 'page ' || c_custkey ELSE repeat('x', 300) END AS title, CASE WHEN c_custkey % 5 = 0 THEN 'pdf' WHEN c_custkey % 3 = 0 THEN 'html+pdf(2files,30pages,exclude:a|b)' WHEN c_custkey % 3 = 1 THEN 'html+pdf(3files,30pages)' ELSE 'html' END AS profile,
  CASE WHEN c_custkey % 5 = 0 THEN 'notice_pdf' ELSE 'news' END AS csv_type, CASE WHEN c_custkey % 7 = 0 THEN 'A_B_1' ELSE 'CSV' || c_custkey END AS csv_id FROM customer""")
def titles_and_profiles(t):
    """Which title counts, how a body is read, types and ids in the external CSV."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    url = F.concat(F.lit("https://e.org/"), k)
    title = F.when(k % 4 == 0, V.chosen_title(F.lit("pdf"), F.lit("candidate"), F.lit("page"), url)).when(k % 4 == 1, V.chosen_title(F.lit("html"), F.lit(" "), none, url)).when(
        k % 4 == 2,
        V.chosen_title(F.lit("html"), F.lit("candidate"), F.concat(F.lit("page "), k), url),
    ).otherwise(V.chosen_title(F.lit("pdf"), none, F.repeat(F.lit("x"), 400), url))
    profile = V.extraction_profile(
        F.when(k % 5 == 0, "pdf").otherwise("html"),
        k % 3 != 2,
        F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")),
        F.when(k % 3 == 0, 2),
    )
    link = F.concat(url, F.when(k % 5 == 0, "/X.Pdf?y=1#z").otherwise("?f=a.pdf"))
    return t("customer").select(
        "c_custkey",
        title.alias("title"),
        profile.alias("profile"),
        text.csv_source_type(link, F.lit("")).alias("csv_type"),
        text.csv_source_id(F.when(k % 7 != 0, F.concat(F.lit("CSV"), k)), F.lit("a-b.1")).alias("csv_id"),
    )


@query("""SELECT CAST(doc_id AS VARCHAR) AS article_id, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'html' END AS content_type, CAST(CASE WHEN doc_id % 3 <> 0 THEN length(text) END AS VARCHAR) AS text_length, CASE WHEN doc_id % 3 = 0 THEN 'HTTP 500' END AS error FROM documents""")
def version_rows(t):
    """Versions of results of extraction; a failure has neither hash nor length."""
    k = F.col("doc_id")
    results = t("documents").select(
        k.cast("string").alias("article_id"),
        F.lit(1).alias("version"),
        F.when(k % 3 == 0, "failed").otherwise("ok").alias("status"),
        F.md5("text").alias("content_hash"),
        F.lit("t").alias("fetched_at"),
        F.when(k % 3 != 0, "html").alias("content_type"),
        "text",
        F.when(k % 3 == 0, "HTTP 500").alias("error"),
        F.lit("new").alias("change_type"),
    )
    return V.version_records(results).select(
        "article_id",
        "content_hash",
        "content_type",
        F.col("text_length").cast("string").alias("text_length"),
        F.col("extraction_error").alias("error"),
    )


@query("""WITH l AS (SELECT l_orderkey AS k, string_agg('[添付PDF]' || l_returnflag || l_linenumber || chr(10) || 'text ' || l_quantity, chr(10) ORDER BY l_linenumber, l_partkey, l_extendedprice) AS t FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS k, 'body ' || o_orderkey || coalesce(chr(10) || t, '') AS text FROM orders LEFT JOIN l ON k = o_orderkey""")
def bodies_with_attachments(t):
    """Bodies with the texts of their readable attachments, each under its title, normalised as a whole."""
    pos = F.struct("l_linenumber", "l_partkey", "l_extendedprice")
    a = t("lineitem").select(
        F.col("l_orderkey").alias("article_id"),
        pos.alias("position"),
        F.concat("l_returnflag", "l_linenumber").alias("title"),
        F.when(F.col("l_linestatus") == "F", "ok").otherwise("failed").alias("status"),
        F.concat(F.lit("\n text　"), "l_quantity", F.lit(" \n\n")).alias("text"),
    )
    bodies = t("orders").select(F.col("o_orderkey").alias("article_id"), F.concat(F.lit("body "), "o_orderkey").alias("text"))
    return V.with_attachments(bodies, a).select(F.col("article_id").alias("k"), "text")


@query("""WITH p AS (SELECT page_id FROM pages) SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'T' ELSE 'T ' || page_id END AS title, CASE WHEN page_id % 5 = 4 THEN 'own text' ELSE 'T ' || page_id || chr(10) || 'body ' || page_id END AS text,
  CASE page_id % 5 WHEN 0 THEN '2026-09-07' WHEN 1 THEN '2026-09-08' END AS published, CASE WHEN page_id % 5 < 2 THEN 'page_data' END AS method FROM p""")
def carried_page_data(t):
    """Pages without text of their own, read from the data for their script: wrapped, dated, shared and looping
    parts; a page with text of its own does not need it."""
    from gleanery.sources.markup import extracted

    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    parts = F.concat(F.lit('"T '), n, F.lit('","<p>body '), n, F.lit('</p>"'))
    plain = F.concat(F.lit('[{"data":1},{"k":2},{"title":3,"body":4,"_meta":5},'), parts, F.lit(',{"publishedAt":6},"2026-09-07"]'))
    wrapped = F.concat(
        F.lit('[["Reactive",1],{"data":2},["ShallowRef",3],{"k":4},{"title":5,"body":6,"_meta":7},'),
        parts,
        F.lit(',{"publishedAt":8},["Date","2026-09-08"]]'),
    )
    looping = F.concat(F.lit('[{"data":1},{"k":2,"again":1},{"title":3,"body":4,"_meta":5,"up":0},'), parts, F.lit(',["Set",6],["Ref",6]]'))
    data = F.when(k == 0, plain).when(k == 1, wrapped).otherwise(looping)
    body = F.when(k == 4, "<body><h1>T</h1><main>own text</main></body>").otherwise(
        F.concat(F.lit('<body><script id="__NUXT_DATA__" type="application/json">'), data, F.lit("</script></body>"))
    )
    pages = t("pages").select(F.col("page_id").alias("id"), F.lit("https://a.jp/").alias("url"), body.alias("body"))
    return extracted(pages).select(F.col("id").alias("page_id"), "title", "text", "published", F.col("published_method").alias("method"))


@query("""SELECT page_id, 'H ' || page_id AS title, '掲載日:2026年9月' || (1 + page_id % 28) || '日' || chr(10) || 'Body ' || page_id || chr(10) || 'doc' AS text, CASE WHEN page_id % 2 = 0 THEN '2026-01-02' ELSE '2026-09-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') END AS published,
  CASE WHEN page_id % 2 = 0 THEN 'html_meta' ELSE 'html_text' END AS method, 'https://a.jp/f/' || page_id || '.pdf' AS pdf FROM pages""")
def page_extraction(t):
    """Main text without what surrounds it, stated and labelled dates, links to PDF files."""
    from gleanery.sources.markup import extracted

    n = F.col("page_id").cast("string")
    day = (1 + F.col("page_id") % 28).cast("string")
    meta = F.when(F.col("page_id") % 2 == 0, '<meta name="date" content="2026-01-02">').otherwise("")
    body = F.concat(
        F.lit("<html><head><title>x</title>"),
        meta,
        F.lit("</head><body><header>top</header><nav>n</nav><h1>H "),
        n,
        F.lit('</h1><main><div class="share">s</div><p>掲載日：２０２６年９月'),
        day,
        F.lit("日</p><p>Body&nbsp; "),
        n,
        F.lit(' <a href="/f/'),
        n,
        F.lit('.pdf">doc</a></p><script>x()</script></main><footer>f</footer></body></html>'),
    )
    got = extracted(t("pages").select(F.col("page_id").alias("id"), F.lit("https://a.jp/").alias("url"), body.alias("body")))
    return got.select(
        F.col("id").alias("page_id"),
        "title",
        "text",
        "published",
        F.col("published_method").alias("method"),
        F.col("pdf_links")[0]["url"].alias("pdf"),
    )


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'unsupported' ELSE 'ok' END AS status, CAST(CASE page_id % 3 WHEN 0 THEN 0 ELSE 3 END AS INTEGER) AS pages, CAST(CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS INTEGER) AS pages_read,
  CASE page_id % 3 WHEN 1 THEN 'Page 1 of ' || page_id || chr(10) || 'Page 2 of ' || page_id || chr(10) || 'Page 3 of ' || page_id WHEN 2 THEN 'Page 1 of ' || page_id || chr(10) || 'Page 2 of ' || page_id ELSE '' END AS text FROM pages""")
def pdf_scan(t):
    """Text, pages and pages read of PDF files, with a cap on pages; what is no PDF is unsupported."""
    from gleanery.sources import pdf

    def run(batches):
        for batch in batches:
            rows = []
            for k in batch["page_id"]:
                body = b"no PDF" if k % 3 == 0 else pdf.written([f"Page {n} of {k}" for n in (1, 2, 3)])
                got = pdf.read(body, 2 if k % 3 == 2 else None)
                rows.append((k, got["status"], got["pages"] or 0, got["pages_read"] or 0, got["text"]))
            yield pd.DataFrame(rows, columns=["page_id", "status", "pages", "pages_read", "text"])

    return t("pages").select("page_id").mapInPandas(run, "page_id long, status string, pages int, pages_read int, text string")


@query("SELECT page_id, 'https://' || lower('EXAMPLE.org') || '/' || page_id AS url, page_id % 4 = 0 AS allowed, page_id % 3 <> 0 AND page_id % 10 <> 7 AS selected FROM pages")
def url_predicates(t):
    """Patterns to include and exclude; hosts that are allowed and not private."""
    k = F.col("page_id")
    url = urls.canonical_url(F.concat(F.lit("HTTPS://EXAMPLE.org:443/"), k, F.lit("?utm_source=x#top")))
    host = F.when(k % 4 == 0, "example.org").when(k % 4 == 1, "10.0.0.7").when(k % 4 == 2, "printer.local").otherwise("other.org")
    other = F.concat(F.lit("https://"), host, F.lit("/"), k)
    allowed = urls.allowed(other, F.array(F.lit("Example.org"), F.lit("10.0.0.7"), F.lit("printer.local")))
    path = F.concat(F.lit("/"), F.when(k % 3 == 0, "old/").otherwise("new/"), k)
    return t("pages").select("page_id", url.alias("url"), allowed.alias("allowed"), urls.selected(path, ["/new/"], ["7$"]).alias("selected"))


@query("SELECT event_type || ',' || count(*) AS line FROM events GROUP BY event_type")
def text_download(t):
    """A text file as it is downloaded, read back."""
    spark = t("events").sparkSession
    folder = shared_folder(spark, "download")
    lines = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type").select(
        text.csv_line(F.col("event_type"), F.col("n")).alias("line")
    )
    SK.text_file(lines, "kind,n", f"{folder}/x.csv")
    return spark.read.option("lineSep", "\r\n").text(f"{folder}/x.csv").where(~F.col("value").endswith("kind,n")).select(F.col("value").alias("line"))


# ---------------------------------------------------------------- dates


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT k, CASE k % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') || 'T10:00:00+09:00' WHEN 2 THEN strftime(d, '%Y-%m-%d') END AS found,
  CASE k % 3 WHEN 0 THEN 'feed' WHEN 1 THEN 'page' ELSE 'list' END AS chosen, CASE k % 2 WHEN 0 THEN '1990' ELSE 'new' END AS published, CASE k % 3 WHEN 0 THEN 'old' ELSE 'new' END AS updated,
  CASE k % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d + 1, '%Y-%m-%dT05:30:00+09:00') WHEN 2 THEN strftime(d, '%Y-%m') END AS stored, CASE WHEN k % 4 = 0 THEN strftime(d, '%Y-%m-%d') WHEN k % 4 = 1 THEN strftime(d + 1, '%Y-%m-%d') ELSE '' END AS day FROM o""")
def date_rules(t):
    """Dates of any form, which of several counts, late ones, how they are kept."""
    k, iso, none = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string")
    era = F.concat(F.lit("平成"), F.year("o_orderdate") - 1988, F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.dayofmonth("o_orderdate"), F.lit("日"))
    raw = F.when(k % 4 == 0, iso).when(
        k % 4 == 1,
        F.date_format("o_orderdate", "EEE, dd MMM yyyy 10:00:00 '+0900'"),
    ).when(k % 4 == 2, era).otherwise("no date")
    chosen = dates.chosen_date(
        F.when(k % 3 == 0, "feed"),
        F.when(k % 3 == 1, "page").otherwise("pdf"),
        F.when(k % 3 == 1, "html_meta").otherwise("pdf_metadata"),
        F.lit("list"),
    )
    published, updated = dates.merged_dates(F.when(k % 2 == 0, "1990"), F.lit("new"), F.lit("old"), F.when(k % 3 != 0, "new"))
    value = F.when(k % 4 == 0, iso).when(k % 4 == 1, F.concat(iso, F.lit("T20:30:00+00:00"))).when(k % 4 == 2, F.substring(iso, 1, 7))
    return t("orders").select(
        k.alias("k"),
        dates.parse_any(raw).alias("found"),
        chosen.alias("chosen"),
        published.alias("published"),
        updated.alias("updated"),
        dates.stored(value, F.lit("e"))["value"].alias("stored"),
        dates.day_or_empty(value).alias("day"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT k, strftime(CASE k % 4 WHEN 0 THEN d - 14 WHEN 1 THEN d - 30 WHEN 2 THEN DATE '1995-01-01' END, '%Y-%m-%d') AS lo, strftime(CASE k % 4 WHEN 2 THEN NULL WHEN 3 THEN DATE '1996-01-01' ELSE d END, '%Y-%m-%d') AS hi FROM o""")
def collection_windows(t):
    """From two weeks before the last success, a month back at first, or the period asked for."""
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    lo, hi = dates.collection_window(
        day,
        F.when(k == 0, day),
        start=F.when(k == 2, F.lit("1995-01-01").cast("date")),
        end=F.when(k == 3, F.lit("1996-01-01").cast("date")),
    )
    return t("orders").select(
        F.col("o_orderkey").alias("k"),
        F.date_format(lo, "yyyy-MM-dd").alias("lo"),
        F.date_format(hi, "yyyy-MM-dd").alias("hi"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT max(d) AS m FROM o) SELECT count(*) AS n, strftime(min(d), '%Y-%m-%d') AS lo, strftime(max(d), '%Y-%m-%d') AS hi FROM o, m WHERE d BETWEEN m - 6 AND m""")
def latest_window_edges(t):
    """A window of seven days holds its first and last day."""
    as_of = t("orders").agg(F.to_date(F.max("o_orderdate")).alias("as_of"))
    rows = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("published")).crossJoin(F.broadcast(as_of))
    got = Q.latest(rows, F.col("as_of"), 7)
    return got.agg(F.count(F.lit(1)).alias("n"), F.min("published").alias("lo"), F.max("published").alias("hi"))


@query("""SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS any_r, bool_and(l_quantity > 5) AS all_large, string_agg(l_linenumber || ':' || l_returnflag, '; ' ORDER BY l_linenumber, l_partkey, l_extendedprice, l_returnflag) AS joined, arg_max(l_returnflag, (l_linenumber, l_partkey, l_extendedprice, l_returnflag)) AS last, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS suppliers FROM lineitem GROUP BY 1""")
def nested_records(t):
    """Arrays in records: the last element, mapped and filtered ones, any and all, joined strings, unique
    elements."""
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_suppkey")
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return a.select(
        "k", F.exists(
            "lines",
            lambda x: x["l_returnflag"] == "R",
        ).alias("any_r"), F.forall("lines", lambda x: x["l_quantity"] > 5).alias("all_large"),
        F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"], F.lit(":"), x["l_returnflag"])), "; ").alias("joined"),
        F.element_at("lines", -1)["l_returnflag"].alias("last"), F.size(
            F.array_distinct(F.transform("lines", lambda x: x["l_suppkey"]))
        ).alias("suppliers"),
    )
