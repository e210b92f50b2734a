"""Queries over records, settings, runs and states built from the driver's tables, with DuckDB SQL.

Bindings: customers are articles with versions, attachments and summaries, nations their sources, market segments and
regions their tags, suppliers sources with states and retry queues, orders candidates and runs.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import schema as SC
from gleanery.functions import text
from gleanery.operators import rules as R
from gleanery.operators import search as Q
from gleanery.operators import sinks as SK
from gleanery.operators import state as S
from gleanery.operators import summaries as SU
from gleanery.operators import tags as G
from gleanery.operators import versions as V
from gleanery.plans import public as PB
from gleanery.plans import status as ST
from gleanery.plans import validate as VA
from gleanery.plans.registry import query, shared_folder
from gleanery.schemas import SCHEMAS, SUMMARY

# ---------------------------------------------------------------- bindings: article files and what belongs to them

#: Customers as articles, in SQL: one row each with all that the public data set is made of.
ARTICLE_SQL = """a AS (SELECT *, c_custkey AS ck, 'https://example.org/c/' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '.PDF?x=1' ELSE '' END AS url FROM customer), b AS (
  SELECT *, 'a_' || substr(sha256(url), 1, 16) AS id, CAST(1 + ck % 3 AS INTEGER) AS latest, ck % 7 = 0 AS failed, ck % 6 = 0 AS attached,
    CASE ck % 4 WHEN 1 THEN '2026' WHEN 2 THEN '2026-0' || (1 + ck % 9) WHEN 3 THEN '2026-03-' || lpad(CAST(1 + ck % 28 AS VARCHAR), 2, '0') END AS published,
    '2026-04-' || lpad(CAST(1 + ck % 27 AS VARCHAR), 2, '0') || 'T08:00:00+09:00' AS seen,
    CASE WHEN ck % 3 = 0 THEN 'none' WHEN ck % 4 = 1 THEN 'failed_api_error' ELSE 'success' END AS s, CAST(CASE WHEN ck % 9 = 1 THEN 1 ELSE 1 + ck % 3 END AS INTEGER) AS sv FROM a)"""


def article_files(t) -> DataFrame:
    """Customers with the schema of article files."""
    ck, none = F.col("ck"), F.lit(None).cast("string")
    c = t("customer").withColumn("ck", F.col("c_custkey"))
    url = F.concat(F.lit("https://example.org/c/"), ck, F.when(ck % 5 == 0, ".PDF?x=1").otherwise(""))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    published = F.when(ck % 4 == 1, "2026").when(ck % 4 == 2, F.concat(F.lit("2026-0"), 1 + ck % 9)).when(
        ck % 4 == 3,
        F.concat(F.lit("2026-03-"), two(1 + ck % 28)),
    )
    basis = F.struct(F.lit("rss_pubdate").alias("method"), F.concat(F.lit("<b> "), "c_mktsegment", F.lit(" &amp;  co</b>")).alias("evidence"))
    seen = F.concat(F.lit("2026-04-"), two(1 + ck % 27), F.lit("T08:00:00+09:00"))
    latest = (1 + ck % 3).cast("int")
    attachment = F.struct(
        F.lit("https://example.org/x.pdf").alias("url"),
        F.concat(F.lit("doc "), ck).alias("title"),
        F.lit("failed").alias("status"),
        F.lit("why").alias("error"),
        F.lit(None).cast("int").alias("text_length"),
        F.lit(3).alias("pages"),
        F.lit(None).cast("int").alias("pages_read"),
    )

    def version(k):
        bad = (k == latest) & (ck % 7 == 0)
        return F.struct(
            F.col("id").alias("article_id"),
            k.cast("int").alias("version"),
            F.when(~bad, F.concat(F.lit("h"), k)).alias("content_hash"),
            F.concat(F.lit("2026-05-0"), k, F.lit("T00:00:00+09:00")).alias("fetched_at"),
            F.lit("html").alias("content_type"),
            F.when(~bad, 10).alias("text_length"),
            F.when(bad, "failed").otherwise("ok").alias("extraction_status"),
            F.when(bad, "HTTP 500").alias("extraction_error"),
            F.when(k == 1, "new").when(k == 2, "content_changed").otherwise("extraction_changed").alias("change_type"),
            F.lit("html").alias("extraction_profile"),
            F.when(ck % 2 == 1, F.concat(F.lit("e"), k)).alias("export_hash"),
            F.when(ck % 2 == 1, "ok").alias("export_hash_status"),
            F.when(ck % 2 == 1, "title+main_text").alias("export_hash_scope"),
            F.when((k == latest) & (ck % 6 == 0), F.array(attachment)).alias("attachments"),
        )

    kind = F.when(published.isNull(), "unknown").when(F.length(published) == 4, "year").when(F.length(published) == 7, "month").otherwise("day")
    base = c.withColumn("url", url).withColumn("id", text.article_id(F.col("url")))
    article = F.struct(
        F.col("id").alias("article_id"),
        F.concat(F.lit("n"), "c_nationkey").alias("source_id"),
        F.col("url").alias("canonical_url"),
        F.concat("c_name", F.lit(" "), "c_mktsegment").alias("title"),
        published.alias("published_at"),
        none.alias("updated_at"),
        F.struct(
            F.when(published.isNotNull(), basis).alias("published"),
            F.lit(None).cast("struct<method:string,evidence:string>").alias("updated"),
        ).alias("date_basis"),
        F.struct(kind.alias("published"), F.lit("unknown").alias("updated")).alias("date_precision"),
        seen.alias("first_seen_at"),
        F.lit("2026-06-01T08:00:00+09:00").alias("last_seen_at"),
        latest.alias("latest_version"),
        F.lit("active").alias("status"),
    )
    return base.select(
        F.lit(1).alias("schema_version"),
        article.alias("article"),
        F.transform(F.sequence(F.lit(1), latest), version).alias("versions"),
        "ck",
        "c_mktsegment",
    )


def summary_rows(t) -> DataFrame:
    """Summaries of two thirds of the articles; a fifth of them have an older one that failed."""
    a = article_files(t).select(
        "ck",
        "c_mktsegment",
        F.col("article.article_id").alias("article_id"),
        F.col("article.latest_version").alias("latest"),
    ).where("ck % 3 <> 0")
    ck, none = F.col("ck"), lambda kind: F.lit(None).cast(kind)
    good = ck % 4 != 1
    strings = lambda c: F.when(good, F.array(c))
    dates_ = F.when(good, F.array(F.struct(F.lit("l").alias("label"), F.lit("2026").alias("value"), F.lit("e").alias("evidence"))))
    tags = F.when(
        good,
        F.array(
            F.struct(F.col("c_mktsegment").alias("tag_id"), F.lit("r").alias("reason")),
            F.struct(F.lit("picked").alias("tag_id"), F.lit("p").alias("reason")),
        ),
    )
    usage = F.struct(
        F.lit(100).cast("long").alias("input_tokens"),
        (ck % 50).alias("output_tokens"),
        F.lit(0).alias("retries"),
        F.lit(0.25).alias("estimated_cost_usd"),
    )

    def row(version, status, error, at, full):
        keep = lambda c, kind: (c if full else none(kind))
        return [
            "article_id", version.cast("int").alias("article_version"), status.alias("analysis_status"), error.alias("error"),
            keep(
                F.when(good, F.concat(F.lit("About "), "c_mktsegment")),
                "string",
            ).alias("summary"), keep(strings(F.lit("point")), "array<string>").alias("key_points"), keep(strings(F.lit("all")), "array<string>").alias("targets"),
            keep(
                dates_,
                "array<struct<label:string,value:string,evidence:string>>",
            ).alias("dates"), keep(tags, "array<struct<tag_id:string,reason:string>>").alias("ai_tags"), keep(F.when(good, F.array().cast("array<string>")), "array<string>").alias("uncertainties"),
            F.lit("mock").alias("provider"), F.lit("m1").alias("model"), F.lit("v1").alias("prompt_version"), F.lit("t1").alias("tags_version"), usage.alias("usage"), F.lit(at).alias("processed_at"), F.lit("h").alias("content_hash"), F.lit(False).alias("input_truncated"),
        ]

    version = F.when(ck % 9 == 1, 1).otherwise(F.col("latest"))
    now = a.select(*row(version, F.when(good, "success").otherwise("failed_api_error"), F.when(~good, "HTTP 529"), "2026-05-09T00:00:00+09:00", True))
    old = a.where("ck % 5 = 1").select(*row(version, F.lit("failed_refusal"), F.lit("no"), "2026-05-01T00:00:00+09:00", False))
    return now.unionByName(old)


def nation_sources(t) -> DataFrame:
    n = t("nation").withColumn("k", F.col("n_nationkey"))
    return n.where("k <> 24").select(
        F.concat(F.lit("n"), "k").alias("source_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("k") % 2 == 0, "gov").alias("source_type"),
        F.array(F.concat(F.lit("region"), "n_regionkey")).alias("fixed_tags"),
        (F.col("k") % 5 != 0).alias("enabled"),
    )


def tag_definitions(t) -> DataFrame:
    seg = t("customer").select(F.col("c_mktsegment").alias("tag_id")).distinct().select(
        "tag_id",
        F.initcap("tag_id").alias("name"),
        F.col("tag_id").startswith("M").alias("enabled"),
    )
    region = t("region").select(F.concat(F.lit("region"), "r_regionkey").alias("tag_id"), F.col("r_name").alias("name"), F.lit(True).alias("enabled"))
    return seg.unionByName(region)


def public_data(t) -> DataFrame:
    files = article_files(t)
    base = files.select(
        "article.article_id",
        "article.title",
        "ck",
        F.concat(F.lit("region"), F.lit("")).alias("x"),
        "c_mktsegment",
        "article.source_id",
    )
    region = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.concat(F.lit("region"), "n_regionkey").alias("fixed"))
    overrides = base.where("ck % 10 = 3").join(region, "source_id").select(
        "article_id",
        F.array(F.lit("byhand")).alias("add"),
        F.array("fixed").alias("remove"),
        F.concat(F.lit("because "), "ck").alias("reason"),
    )
    bodies = base.select("article_id", "title", F.when(F.col("ck") % 8 == 0, "the body has gold").alias("body"))
    matches = R.matches(bodies, [{"tag_id": "metal", "label": "gold", "pattern": "GOLD"}, {"tag_id": "nine", "label": "9", "pattern": r"9 [A-Z]"}])
    return PB.public_articles(files.select("article", "versions"), summary_rows(t), nation_sources(t), tag_definitions(t), overrides, matches)


PUBLIC_SQL = f"""WITH {ARTICLE_SQL}, n AS (SELECT b.*, n_name, CAST(n_regionkey AS VARCHAR) AS rk, r_name FROM b JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), g AS (
  SELECT id, c_mktsegment AS tag, 'ai' AS origin, 0 AS p, 0 AS pos FROM n WHERE s = 'success' UNION ALL SELECT id, 'picked', 'ai', 0, 1 FROM n WHERE s = 'success'
  UNION ALL SELECT id, 'region' || rk, 'source', 1, 0 FROM n WHERE c_nationkey <> 24 AND ck % 10 <> 3
  UNION ALL SELECT id, 'metal', 'rule', 2, 0 FROM n WHERE ck % 8 = 0 UNION ALL SELECT id, 'nine', 'rule', 2, 1 FROM n WHERE ck % 10 = 9 UNION ALL SELECT id, 'byhand', 'human', 3, 0 FROM n WHERE ck % 10 = 3),
  l AS (SELECT id, string_agg(tag || '@' || origin, ' ' ORDER BY p, pos) AS tags FROM g GROUP BY id)
SELECT n.id, 'n' || c_nationkey AS source_id, CASE WHEN c_nationkey = 24 THEN 'n24' ELSE n_name END AS source_name, url, published,
  CASE ck % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE 'day' END AS "precision", CASE WHEN published IS NOT NULL THEN 'rss_pubdate:' || c_mktsegment || ' & co' END AS basis, seen AS first_seen_at,
  CASE WHEN failed THEN 'failed' ELSE 'ok' END AS content_status, CASE WHEN failed THEN 'HTTP 500' END AS content_error, latest AS latest_version,
  CASE latest WHEN 1 THEN '1:new' WHEN 2 THEN '1:new 2:content_changed' ELSE '1:new 2:content_changed 3:extraction_changed' END AS versions, CASE WHEN attached THEN 'doc ' || ck || ':why' ELSE '' END AS attachments,
  CASE s WHEN 'none' THEN 'not_processed' ELSE s END AS status, CASE WHEN s = 'success' THEN 'About ' || c_mktsegment END AS text, CASE WHEN s = 'failed_api_error' THEN 'HTTP 529' END AS error,
  s <> 'none' AND sv < latest AS outdated, CASE WHEN s = 'success' THEN '1' END AS points, CASE WHEN ck % 5 = 0 THEN 'notice_pdf' WHEN c_nationkey % 2 = 0 AND c_nationkey <> 24 THEN 'gov' ELSE 'news' END AS csv_type,
  CASE WHEN ck % 2 = 1 THEN 'e' || latest END AS csv_hash, CASE WHEN ck % 2 = 1 THEN 'ok' ELSE 'unavailable' END AS csv_hash_status, coalesce(tags, '') AS tags,
  CASE WHEN ck % 10 = 3 AND c_nationkey <> 24 THEN 'region' || rk || '=' || r_name ELSE '' END AS removed, CASE WHEN ck % 10 = 3 THEN 'because ' || ck END AS override_reason
FROM n LEFT JOIN l USING (id)"""


@query(PUBLIC_SQL)
def public_dataset(t):
    """The public data set as an allow-list of articles joined to all that they show."""
    joined = lambda c, f: F.array_join(F.transform(c, f), " ")
    return public_data(t).select(
        "id", "source_id", "source_name", "url", "published", F.col("published_info.precision").alias("precision"),
        F.concat(
            "published_info.basis.method",
            F.lit(":"),
            "published_info.basis.evidence",
        ).alias("basis"), "first_seen_at", "content_status", "content_error", "latest_version",
        joined(
            "versions",
            lambda v: F.concat(v["version"], F.lit(":"), v["change_type"]),
        ).alias("versions"), joined("attachments", lambda a: F.concat(a["title"], F.lit(":"), a["note"])).alias("attachments"),
        F.col("summary.status").alias("status"), F.col("summary.text").alias("text"), F.col("summary.error").alias("error"), F.col("summary.outdated").alias("outdated"), F.when(
            F.col("summary.key_points").isNotNull(),
            F.size("summary.key_points").cast("string"),
        ).alias("points"),
        F.col("csv.source_type").alias("csv_type"), F.col("csv.hash").alias("csv_hash"), F.col("csv.hash_status").alias("csv_hash_status"), joined(
            "tags",
            lambda x: F.concat(x["id"], F.lit("@"), x["origin"]),
        ).alias("tags"),
        joined(
            "removed_tags",
            lambda x: F.concat(x["id"], F.lit("="), x["name"]),
        ).alias("removed"), F.col("tag_override_reason").alias("override_reason"),
    )


@query(f"""WITH p AS ({PUBLIC_SQL}) SELECT id, CAST(len(list_filter(string_split(tags, ' '), lambda x: ends_with(x, '@ai'))) AS INTEGER) AS ai, CAST(len(list_filter(string_split(tags, ' '), lambda x: ends_with(x, '@source'))) AS INTEGER) AS source,
  CAST(len(list_filter(string_split(tags, ' '), lambda x: ends_with(x, '@rule'))) AS INTEGER) AS rule, CAST(len(list_filter(string_split(tags, ' '), lambda x: ends_with(x, '@human'))) AS INTEGER) AS human, latest_version AS history FROM p WHERE id = (SELECT min(id) FROM p WHERE published = '2026')""")
def article_detail(t):
    """Q9: one article with its tags split by origin and its history."""
    a = public_data(t)
    wanted = a.where("published = '2026'").agg(F.min("id")).first()[0] or ""
    return PB.detail(a, wanted).select("id", *(F.size(f"tags_{o}").alias(o) for o in G.ORIGINS), F.size("versions").alias("history"))


@query(f"""WITH p AS ({PUBLIC_SQL}), c AS (SELECT *, string_split(tags, ' ') AS ts FROM p), d AS (SELECT c_mktsegment AS i, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'region' || r_regionkey, r_name FROM region),
x AS (SELECT id, unnest(ts) AS g, generate_subscripts(ts, 1) AS k FROM c WHERE tags <> ''), y AS (SELECT id, split_part(g, '@', 2) AS o, string_agg(coalesce(n, split_part(g, '@', 1)), ';' ORDER BY k) AS names FROM x LEFT JOIN d ON i = split_part(g, '@', 1) GROUP BY ALL),
z AS (SELECT id, max(names) FILTER (o = 'ai') AS ai, max(names) FILTER (o = 'source') AS src, max(names) FILTER (o = 'rule') AS rule, max(names) FILTER (o = 'human') AS human FROM y GROUP BY id)
SELECT p.id || ',' || coalesce(published, '') || ',' || "precision" || ',,' || first_seen_at || ',' || source_name || ',' || (SELECT c_name || ' ' || c_mktsegment FROM customer WHERE 'a_' || substr(sha256('https://example.org/c/' || c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '.PDF?x=1' ELSE '' END), 1, 16) = p.id)
  || ',' || url || ',' || coalesce(text, '') || ',' || status || ',' || coalesce(ai, '') || ',' || coalesce(src, '') || ',' || coalesce(rule, '') || ',' || coalesce(human, '') || ',' || CASE WHEN removed = '' THEN '' ELSE split_part(removed, '=', 2) END || ',' || content_status || ',' || latest_version AS line
FROM p LEFT JOIN z USING (id)""")
def article_list_csv(t):
    """K4, K6: the lines of the article list, written as a file with its mark and line ends, and read back."""
    spark = t("customer").sparkSession
    folder = shared_folder(spark, "list")
    SK.text_file(PB.list_csv(public_data(t)), ",".join(PB.LIST_COLUMNS), f"{folder}/list.csv")
    whole = spark.read.option("lineSep", "\r\n").text(f"{folder}/list.csv")
    return whole.where(~F.col("value").contains("記事ID,公開日,")).select(F.col("value").alias("line"))


@query(f"""WITH p AS ({PUBLIC_SQL}) SELECT 'open' AS release_mode, id, status, tags FROM p""")
def filtered_json_export(t):
    """K7, K2: articles as JSON with the release mode, written and read back."""
    spark = t("customer").sparkSession
    folder = shared_folder(spark, "json")
    a = public_data(t)
    PB.filtered_json(a, "open").write.text(folder)
    got = spark.read.schema("release_mode string, id string, summary struct<status:string>, tags array<struct<id:string,origin:string>>").json(folder)
    return got.select(
        "release_mode",
        "id",
        F.col("summary.status").alias("status"),
        F.array_join(F.transform("tags", lambda x: F.concat(x["id"], F.lit("@"), x["origin"])), " ").alias("tags"),
    )


@query(f"""WITH p AS ({PUBLIC_SQL}) SELECT id, status, latest_version FROM p WHERE latest_version = 3""")
def published_version(t):
    """K1: staged publication: a version that breaks a check is refused, and what was published before stays whole."""
    spark = t("customer").sparkSession
    folder = shared_folder(spark, "public")
    a = public_data(t).select("id", "title", F.col("summary.status").alias("status"), "latest_version")
    PB.publish(a.where("latest_version = 3"), folder, VA.public(a))
    try:
        PB.publish(a, folder, VA.public(a.withColumn("title", F.lit("AKIA" + "A" * 16))))
    except ValueError:
        pass
    else:
        raise AssertionError("a secret was published")
    return PB.published(spark, folder).drop("title")


@query("SELECT 'source' AS kind, 'n' || n_nationkey AS id, n_name AS name, n_nationkey % 5 = 0 AS retired FROM nation WHERE n_nationkey <> 24 UNION ALL SELECT 'tag', 'region' || r_regionkey, r_name, false FROM region UNION ALL SELECT DISTINCT 'tag', c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), NOT starts_with(c_mktsegment, 'M') FROM customer")
def site_meta(t):
    """What the site knows of sources and tags."""
    sources, tags = PB.meta(nation_sources(t), tag_definitions(t))
    return sources.select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), "name", "retired").unionByName(
        tags.select(F.lit("tag").alias("kind"), F.col("tag_id").alias("id"), "name", "retired")
    )


@query(f"WITH {ARTICLE_SQL} SELECT CAST(count(*) AS BIGINT) AS articles, count(*) FILTER (published IS NULL) AS undated, min(id) AS first_id FROM b")
def public_json_load(t):
    """The data set that a page carries, and the same from its files."""
    spark = t("customer").sparkSession
    a = article_files(t).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("article.published_at").isNull()).alias("undated"),
        F.min("article.article_id").alias("first_id"),
    ).first()
    folder = shared_folder(spark, "site")
    schemas = {"meta": "site string", "articles": "articles bigint, undated bigint, first_id string", "status": "runs int", "reports": "weeks int"}
    data = {
        "meta": {"site": "s <&>"},
        "articles": {"articles": a["n"], "undated": a["undated"], "first_id": a["first_id"]},
        "status": {"runs": 1},
        "reports": {"weeks": 2},
    }
    for name, value in data.items():
        SK.text_file(
            spark.createDataFrame([(x,) for x in PB.pretty_json(value).splitlines()], "line string").coalesce(1),
            "",
            f"{folder}/{name}.json",
            end="\n",
            mark=False,
        )
    safe = spark.createDataFrame([(json.dumps(data),)], "v string").select(text.embedded_json(F.col("v"))).first()[0]
    carried = PB.load_public(spark, folder, schemas, page=f'<body><script type="application/json" id="{PB.EMBEDDED_ID}">{safe}</script></body>')
    files = PB.load_public(spark, folder, schemas)
    both = files["articles"].intersect(carried["articles"])
    return both.join(
        files["meta"].intersect(carried["meta"]).where("site = 's <&>'").select(F.lit(1)),
        how="cross",
    ).select("articles", "undated", "first_id")


# ---------------------------------------------------------------- record files


@query("""SELECT 'run_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.json' AS file, CASE WHEN n_nationkey <> 7 THEN 'run_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS run_id, CASE WHEN n_nationkey <> 7 THEN n_name END AS status, n_nationkey = 7 AS broken, n_nationkey = (SELECT max(n_nationkey) FROM nation) AS newest FROM nation""")
def record_scan(t):
    """A folder of JSON records, a broken one among them, and the newest run."""
    from gleanery.sources import files

    spark = t("nation").sparkSession
    folder = shared_folder(spark, "runs")
    for r in t("nation").collect():  # one file for each of 25 nations
        name = f"run_{r['n_nationkey']:02d}"
        whole = PB.pretty_json({"schema_version": 1, "run": {"run_id": name, "status": r["n_name"], "sources": []}})
        write_text(spark, f"{folder}/{name}.json", whole if r["n_nationkey"] != 7 else whole[:30])
    runs = files.json_documents(spark, folder, "run")
    newest = files.newest_run(runs.where("run is not null")).select(F.col("run_id").alias("newest_id"))
    return runs.join(newest, how="cross").select(
        "file",
        "run.run_id",
        "run.status",
        F.col("broken").isNotNull().alias("broken"),
        F.coalesce(F.col("run.run_id") == F.col("newest_id"), F.lit(False)).alias("newest"),
    )


@query("""SELECT 'a_' || n_nationkey AS article_id, n_name AS title, 'n' || n_regionkey AS source_id, CASE n_regionkey % 2 WHEN 0 THEN r_name END AS last_success_at, n_regionkey AS failures, CAST(1 + n_nationkey % 2 AS INTEGER) AS versions FROM nation JOIN region ON r_regionkey = n_regionkey""")
def keyed_records(t):
    """Article files by id and the state file by source, read back as rows that meet by key."""
    from gleanery.sources import files

    spark = t("nation").sparkSession
    folder = shared_folder(spark, "records")
    for r in t("nation").collect():  # one file for each of 25 nations
        k = r["n_nationkey"]
        versions = [{"article_id": f"a_{k}", "version": n} for n in range(1, 2 + k % 2)]
        write_text(
            spark,
            f"{folder}/articles/a_{k}.json",
            PB.pretty_json(
                {
                    "schema_version": 1,
                    "article": {"article_id": f"a_{k}", "title": r["n_name"], "source_id": f"n{r['n_regionkey']}"},
                    "versions": versions,
                }
            ),
        )
    states = {
        f"n{r['r_regionkey']}": {
            "source_id": f"n{r['r_regionkey']}",
            "last_success_at": r["r_name"] if r["r_regionkey"] % 2 == 0 else None,
            "consecutive_failures": r["r_regionkey"],
            "retry_queue": [],
        } for r in t("region").collect()
    }
    write_text(spark, f"{folder}/state/state.json", PB.pretty_json({"schema_version": 1, "sources": states}))
    articles = files.json_documents(spark, f"{folder}/articles", "article").where(F.col("file") == F.concat("article.article_id", F.lit(".json")))
    state = files.json_documents(spark, f"{folder}/state", "state").select(F.explode("sources").alias("key", "s")).select(
        F.col("key").alias("source_id"),
        "s.last_success_at",
        F.col("s.consecutive_failures").alias("failures"),
    )
    return articles.select(
        "article.article_id",
        "article.title",
        "article.source_id",
        F.size("versions").alias("versions"),
    ).join(state, "source_id").select("article_id", "title", "source_id", "last_success_at", "failures", "versions")


def write_text(spark, path: str, body: str) -> None:
    """One small file in a shared folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(body.encode())
    out.close()


@query("""SELECT 'a_' || n_nationkey AS article_id, CAST(1 + n_nationkey % 3 AS INTEGER) AS version, n_name || chr(10) || 'ü' AS text FROM nation""")
def text_cache_scan(t):
    """Bodies in files that are named by article and version."""
    from gleanery.sources import files

    spark = t("nation").sparkSession
    folder = shared_folder(spark, "cache")
    for r in t("nation").collect():  # one file for each of 25 nations
        write_text(spark, f"{folder}/a_{r['n_nationkey']}_v{1 + r['n_nationkey'] % 3}.txt", r["n_name"] + "\nü")
    return files.cached_texts(spark, folder)


@query("""SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, CASE WHEN n_nationkey % 4 = 0 THEN 'true' ELSE 'false' END AS over FROM nation UNION ALL SELECT 'twice', NULL, NULL""")
def configuration(t):
    """Settings in YAML and JSON, files of an overlay in place of others, a repeated key as an error."""
    from gleanery.sources import files

    base, over = [], []
    for r in t("nation").collect():
        base.append((f"{r['n_name']}.yaml", f"region: '{r['n_regionkey']}'\nover: false\n"))
        if r["n_nationkey"] % 4 == 0:
            over.append((f"{r['n_name']}.yaml", f"region: '{r['n_regionkey']}'\nover: true\n"))
    spark = t("nation").sparkSession
    frame = lambda rows: spark.createDataFrame(rows, "name string, text string")
    twice = [("twice.json", '{"region": 1, "region": 2}')]
    read = files.parsed_files(files.overlaid(frame(base + twice), frame(over)))
    return read.select(
        F.regexp_extract("name", r"^(.*)\.", 1).alias("name"),
        F.get_json_object("value", "$.region").alias("region"),
        F.get_json_object("value", "$.over").alias("over"),
    )


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), d AS (SELECT k, 'https://example.org/' || k AS url, CASE k % 5 WHEN 1 THEN 'https://example.org/' || (k - 1) ELSE 'https://example.org/' || k END AS final_url FROM s)
SELECT url, final_url, CASE k % 5 WHEN 2 THEN 'timeout' WHEN 3 THEN 'HTTP 404' WHEN 4 THEN 'HTTP 404' END AS error, CASE WHEN k % 5 < 2 THEN '<p>hi</p>' END AS body FROM d""")
def fixture_scan(t):
    """A fake web of files, redirects, timeouts, errors and unknown URLs."""
    from gleanery.sources import files

    spark = t("supplier").sparkSession
    folder = shared_folder(spark, "fixture")
    write_text(spark, f"{folder}/page.html", "<p>hi</p>")
    keys = [r[0] for r in t("supplier").select("s_suppkey").collect()]
    url = "https://example.org/{}".format
    kinds = [
        lambda k: {"file": "page.html", "type": "text/html"},
        lambda k: {"redirect": url(k - 1)},
        lambda k: {"timeout": True},
        lambda k: {"status": 404},
    ]
    routes = [{"url": url(k)} | kinds[k % 5](k) for k in keys if k % 5 < 4]
    asked = t("supplier").select(F.concat(F.lit("https://example.org/"), "s_suppkey").alias("url"))
    return files.fixture_responses(spark, routes, folder, asked).select("url", "final_url", "error", F.col("body").cast("string").alias("body"))


def _opened(url: str, timeout: float):
    """A web without a network: by the number that ends a URL."""
    from gleanery.sources.web import Raw

    if url.endswith("robots.txt"):
        rules = b"User-agent: *\nDisallow: /closed/"
        return Raw(200, {}, lambda n: rules[:n])
    k = int(url.rstrip("x").rpartition("/")[2])
    if k % 6 == 1:
        return Raw(302, {"location": f"/p/{k}x"} if not url.endswith("x") else {}, lambda n: b"")
    if k % 6 == 2:
        return Raw(500, {}, lambda n: b"")
    body = f"page {k}".encode() * (1 if k % 6 != 3 else 1000)
    return Raw(200, {"content-type": "text/html"}, lambda n: body[:n])


def _fetcher():
    from gleanery.sources.web import Fetcher

    return Fetcher({"example.org"}, wait=0, max_bytes=4096, opener=_opened, sleep=lambda s: None)


@query("""WITH s AS (SELECT s_suppkey AS k, 'https://' || CASE WHEN s_suppkey % 6 = 5 THEN 'other.org' ELSE 'example.org' END || CASE WHEN s_suppkey % 6 = 4 THEN '/closed/' ELSE '/p/' END || s_suppkey AS url FROM supplier)
SELECT url, CASE k % 6 WHEN 0 THEN url WHEN 1 THEN url || 'x' END AS final_url, CASE k % 6 WHEN 0 THEN 'page ' || k WHEN 1 THEN '' END AS body,
  CASE k % 6 WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'larger than the limit' WHEN 4 THEN 'robots.txt forbids it' WHEN 5 THEN 'not allowed: other.org' END AS error FROM s""")
def http_scan(t):
    """Fetching with redirects, robots.txt, byte caps and allowed hosts, by an injected opener."""
    from gleanery.sources import web

    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://"), F.when(k % 6 == 5, "other.org").otherwise("example.org"), F.when(k % 6 == 4, "/closed/").otherwise("/p/"), k)
    got = web.fetched(t("supplier").select(url.alias("url")), _fetcher, 4)
    return got.select("url", "final_url", F.col("body").cast("string").alias("body"), "error")


def _listed(t) -> DataFrame:
    """Orders of each nation's customers, numbered."""
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))


#: Items of one body at most, and the span of keys whose items of a source are put in order together.
_BODY_ITEMS, _BODY_SPAN = 1_000, 25_000


def _bodies(items: DataFrame, head, tail) -> DataFrame:
    """XML bodies from the items of each source, in order of their keys. As large feeds and sitemaps do, a source comes in
    several bodies, so that none of them, no group and no task grows with the source."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("source", "span").orderBy("k")) - 1
    paged = items.withColumn("span", F.expr(f"k div {_BODY_SPAN}")).withColumn("page", (place / _BODY_ITEMS).cast("int"))
    grouped = paged.groupBy("source", "span", "page").agg(F.array_sort(F.collect_list(F.struct("k", "xml"))).alias("items"))
    body = F.concat(head, F.array_join(F.transform("items", lambda i: i["xml"]), ""), tail)
    return grouped.select("source", F.lit("https://example.org/").alias("base"), body.cast("binary").alias("body"))


@query("""WITH o AS (SELECT 'n' || c_nationkey AS source, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, c_nationkey % 3 AS kind FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT source, CASE WHEN k % 50 <> 0 THEN 'https://example.org/i/' || k END AS url, CASE WHEN k % 50 = 0 THEN 'ftp://example.org/i/' || k || CASE kind WHEN 0 THEN '?utm_source=f' ELSE '' END END AS rejected, CASE WHEN k % 50 <> 0 THEN 'T & ' || k END AS title,
  CASE WHEN k % 50 = 0 OR k % 11 = 0 THEN NULL WHEN kind = 0 THEN strftime(d, '%Y-%m-%d') || 'T10:00:00+09:00' ELSE strftime(d, '%Y-%m-%d') END AS published FROM o
UNION ALL SELECT 'bad', NULL, NULL, NULL, NULL""")
def feed_scan(t):
    """RSS 2.0, Atom and RSS 1.0 bodies, of one kind for each nation; a broken body gives one row."""
    from gleanery.sources import feeds

    o = _listed(t)
    kind = F.substring("source", 2, 9).cast("int") % 3
    link = F.concat(F.when(F.col("k") % 50 == 0, "ftp://example.org").otherwise(""), F.lit("/i/"), "k")
    rfc = F.date_format("day", "EEE, dd MMM yyyy")
    dated = lambda x: F.when(F.col("k") % 11 == 0, "").otherwise(x)
    title = F.concat(F.lit("<title>T &amp; "), "k", F.lit("</title>"))
    rss = F.concat(
        F.lit("<item>"),
        title,
        F.lit("<link>"),
        link,
        F.lit("?utm_source=f</link>"),
        dated(F.concat(F.lit("<pubDate>"), rfc, F.lit(" 10:00:00 +0900</pubDate>"))),
        F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"),
        title,
        F.lit('<link href="'),
        link,
        F.lit('"/>'),
        dated(F.concat(F.lit("<published>"), F.date_format("day", "yyyy-MM-dd"), F.lit("</published>"))),
        F.lit("</entry>"),
    )
    rdf = F.concat(
        F.lit("<item>"),
        title,
        F.lit("<link>"),
        link,
        F.lit("</link>"),
        dated(F.concat(F.lit("<dc:date>"), F.date_format("day", "yyyy-MM-dd"), F.lit("</dc:date>"))),
        F.lit("</item>"),
    )
    items = o.select("source", "k", F.when(kind == 0, rss).when(kind == 1, atom).otherwise(rdf).alias("xml"))
    head = F.when(kind == 0, "<rss><channel>").when(kind == 1, '<feed xmlns="http://www.w3.org/2005/Atom">').otherwise(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    )
    tail = F.when(kind == 0, "</channel></rss>").when(kind == 1, "</feed>").otherwise("</rdf:RDF>")
    bad = o.sparkSession.createDataFrame([("bad", "https://example.org/", bytearray(b"<x"))], "source string, base string, body binary")
    return feeds.candidates(_bodies(items, head, tail).unionByName(bad), feeds.feed_items).select("source", "url", "rejected", "title", "published")


@query("""SELECT 'n' || c_nationkey AS source, CASE WHEN o_orderkey % 40 <> 1 THEN 'https://example.org/news/' || o_orderkey END AS url, CASE WHEN o_orderkey % 40 = 1 THEN 'mailto:' || o_orderkey END AS rejected
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 OR o_orderkey % 40 = 1""")
def sitemap_scan(t):
    """Sitemaps with patterns to include and exclude; dates in them are not publication dates."""
    from gleanery.sources import feeds

    k = F.col("k")
    loc = F.when(k % 40 == 1, F.concat(F.lit("mailto:"), k)).when(k % 3 == 0, F.concat(F.lit("/old/"), k)).otherwise(F.concat(F.lit("/news/"), k))
    items = _listed(t).select("source", "k", F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>2026-01-01</lastmod></url>")).alias("xml"))
    return feeds.candidates(
        _bodies(items, F.lit("<urlset>"), F.lit("</urlset>")),
        feeds.sitemap_items,
        include=["/news/", "/old/"],
        exclude=["^https://example.org/old/"],
    ).select("source", "url", "rejected")


@query("""WITH o AS (SELECT 'n' || c_nationkey AS source, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS n FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT source, 'https://example.org/i/' || k AS url, 'T ' || k AS title, CASE k % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m') END AS published FROM o WHERE n < 60 AND k % 9 <> 5""")
def paged_listing(t):
    """Lists in pages of twenty, three pages at most: scope, items, titles, dates of several forms,
    patterns, and the next page."""
    from pyspark.sql import Window as W

    from gleanery.sources import markup

    o = _listed(t).withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("k")) - 1)
    ja = F.concat(F.year("day"), F.lit("年"), F.month("day"), F.lit("月"))
    date_ = F.when(
        F.col("k") % 4 == 0,
        F.concat(F.lit('<time datetime="'), F.date_format("day", "yyyy-MM-dd"), F.lit('">x</time>')),
    ).when(F.col("k") % 4 == 1, F.concat(F.lit('<span class="date">'), ja, F.dayofmonth("day"), F.lit("日</span>"))).when(F.col("k") % 4 == 2, F.concat(F.lit('<span class="date">'), ja, F.lit("号</span>"))).otherwise("")
    item = F.concat(
        F.lit('<li class="c">'),
        date_,
        F.lit('<a href="'),
        F.when(F.col("k") % 9 == 5, "/old/").otherwise("/i/"),
        "k",
        F.lit('#x"><b>T '),
        "k",
        F.lit("</b> more</a></li>"),
    )
    page = (F.col("n") / 20).cast("int")
    grouped = o.select(
        "source",
        page.alias("page"),
        F.struct("k", item.alias("xml")).alias("i"),
    ).groupBy("source", "page").agg(F.array_sort(F.collect_list("i")).alias("items"))
    last = grouped.groupBy("source").agg(F.max("page").alias("last"))
    of = lambda p: F.concat(F.lit("https://example.org/"), "source", F.lit("/"), p)
    follow = F.when(
        F.col("page") < F.col("last"),
        F.concat(F.lit('<a class="next" href="'), of(F.col("page") + 1), F.lit('">next</a>')),
    ).otherwise("")
    body = F.concat(
        F.lit('<body><nav><a href="/nav">n</a></nav><ul class="l">'),
        F.array_join(F.transform("items", lambda i: i["xml"]), ""),
        F.lit("</ul>"),
        follow,
        F.lit("</body>"),
    )
    pages = grouped.join(last, "source").select("source", of(F.col("page")).alias("url"), body.alias("body"), (F.col("page") == 0).alias("entry"))
    rules = {"css_selector": "ul.l", "item_selector": "li.c", "title_selector": "b", "date_selector": ".date", "exclude": ["/old/"]}
    return markup.paged(pages, rules, "a.next", 3).select("source", "url", "title", "published")


# ---------------------------------------------------------------- sources, states and runs


def supplier_state(t) -> DataFrame:
    k = F.col("s_suppkey")
    item = lambda n: F.struct(
        F.concat(F.lit("https://example.org/r/"), k, F.lit("/"), F.lit(n)).alias("url"),
        F.concat(F.lit("x"), k).alias("article_id"),
        F.lit("fetch" if n == 0 else "summarize").alias("stage"),
        F.lit("サイズ上限を超過" if n == 0 else "添付の失敗").alias("reason"),
        F.lit("2026-01-01").alias("first_failed_at"),
        F.lit(n + 1).alias("attempts"),
    )
    queue = F.when(k % 4 == 0, F.array(item(0), item(1))).otherwise(
        F.array().cast("array<struct<url:string,article_id:string,stage:string,reason:string,first_failed_at:string,attempts:int>>")
    )
    span = F.struct(F.lit("2025-01-01").alias("oldest"), F.lit("2026-01-01").alias("newest"), F.lit(1).alias("pages"))
    return t("supplier").where("s_suppkey % 6 <> 5").select(
        k.cast("string").alias("source_id"),
        F.when(k % 3 != 0, "2026-01-01T00:00:00+09:00").alias("last_success_at"),
        F.lit("2026-01-02T00:00:00+09:00").alias("last_attempt_at"),
        F.when(k % 3 != 0, "success").otherwise("failed").alias("last_attempt_status"),
        (k % 3).cast("int").alias("consecutive_failures"),
        span.alias("explored_range"),
        queue.alias("retry_queue"),
    )


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 < 5 THEN 'success' WHEN s_suppkey % 10 < 8 THEN 'failed' WHEN s_suppkey % 10 = 8 THEN 'skipped' END AS now, s_suppkey % 6 <> 5 AS known FROM supplier)
SELECT CAST(k AS VARCHAR) AS source_id, CASE WHEN now = 'success' THEN 't9' WHEN known AND k % 3 <> 0 THEN '2026-01-01T00:00:00+09:00' END AS last_success_at, CASE WHEN now IS NOT NULL THEN 't9' WHEN known THEN '2026-01-02T00:00:00+09:00' END AS last_attempt_at,
  coalesce(now, CASE WHEN known THEN CASE WHEN k % 3 <> 0 THEN 'success' ELSE 'failed' END END) AS last_attempt_status, CAST(CASE WHEN now = 'success' THEN 0 ELSE CASE WHEN known THEN k % 3 ELSE 0 END + CASE WHEN now = 'failed' THEN 1 ELSE 0 END END AS INTEGER) AS failures,
  CASE WHEN now = 'success' THEN 'new' WHEN known THEN '2025-01-01' END AS oldest, CASE WHEN now IN ('success', 'failed') THEN '1' WHEN known THEN CASE WHEN k % 4 = 0 THEN '2' ELSE '0' END END AS queued FROM s""")
def state_after_run(t):
    """The state of each source after a run: success point, range, failures in a row, retry queue."""
    sources = t("supplier").select(F.col("s_suppkey").cast("string").alias("source_id"))
    k = F.col("s_suppkey") % 10
    span = F.struct(F.lit("new").alias("oldest"), F.lit("new").alias("newest"), F.lit(2).alias("pages"))
    queue = F.array(
        F.struct(
            F.lit("u").alias("url"),
            F.lit(None).cast("string").alias("article_id"),
            F.lit("fetch").alias("stage"),
            F.lit("r").alias("reason"),
            F.lit("t").alias("first_failed_at"),
            F.lit(1).alias("attempts"),
        )
    )
    results = t("supplier").where(k < 9).select(
        F.col("s_suppkey").cast("string").alias("source_id"),
        F.when(k < 5, "success").when(k < 8, "failed").otherwise("skipped").alias("status"),
        F.lit("t9").alias("attempted_at"),
        span.alias("explored_range"),
        queue.alias("retry_queue"),
    )
    got = S.merged_state(sources, supplier_state(t), results)
    return got.select(
        "source_id",
        "last_success_at",
        "last_attempt_at",
        "last_attempt_status",
        F.col("consecutive_failures").alias("failures"),
        F.col("explored_range.oldest").alias("oldest"),
        F.when(F.col("retry_queue").isNotNull(), F.size("retry_queue").cast("string")).alias("queued"),
    )


@query("""WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS source_id, 'https://example.org/r/' || l_suppkey || '/' || (l_linenumber % 3) AS url, max(l_quantity) > 49 AS out_ FROM lineitem GROUP BY ALL),
r AS (SELECT CAST(s_suppkey AS VARCHAR) AS source_id, 'https://example.org/r/' || s_suppkey || '/0' AS url FROM supplier WHERE s_suppkey % 6 <> 5 AND s_suppkey % 4 = 0)
SELECT source_id, url, out_ IS NULL AS added, coalesce(NOT out_, true) OR (source_id, url) IN (SELECT (source_id, url) FROM r) AS fetched FROM (SELECT source_id, url, out_ FROM c UNION ALL SELECT source_id, url, NULL FROM r ANTI JOIN c USING (source_id, url))""")
def candidates_and_retries(t):
    """Candidates with the URLs to fetch again (not those whose summary failed), and which are worth fetching."""
    c = t("lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("source_id"),
        F.concat(F.lit("https://example.org/r/"), "l_suppkey", F.lit("/"), F.col("l_linenumber") % 3).alias("url"),
    ).agg((F.max("l_quantity") > 49).alias("out_"))
    items = supplier_state(t).select("source_id", F.explode("retry_queue").alias("r")).select("source_id", "r.url", "r.stage")
    both = S.with_retries(c, items).join(c, ["source_id", "url"], "left").withColumn("judged", ~F.col("out_"))
    good = S.worth_fetching(both, items.where("stage = 'fetch'")).select("source_id", "url", F.lit(True).alias("fetched"))
    return both.join(good, ["source_id", "url"], "left").select(
        "source_id",
        "url",
        F.col("out_").isNull().alias("added"),
        F.coalesce("fetched", F.lit(False)).alias("fetched"),
    )


@query("""WITH r AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS source_id, s_suppkey % 8 AS listed, s_suppkey % 8 AS uniq, s_suppkey % 3 AS merged, s_suppkey % 2 AS rejected, s_suppkey % 9 = 0 AS err, s_suppkey % 5 AS re, CASE WHEN s_suppkey % 10 <> 0 THEN 9 END AS before FROM supplier),
w AS (SELECT source_id, unnest([CASE WHEN merged > 0 THEN '同じURLを指す一覧の項目 ' || merged || '件を1件にまとめました（#以降だけが違うリンクなど）' END, CASE WHEN rejected > 0 THEN '取得対象外のリンク ' || rejected || '件を除外しました（http(s)以外など）' END, CASE WHEN uniq > 6 THEN '取得上限（6件）に達したため、残りは次回に回します' END,
  CASE WHEN NOT err AND listed = 0 THEN '一覧から記事を1件も抽出できませんでした（抽出規則が壊れている可能性があります）' END, CASE WHEN NOT err AND before >= 4 AND uniq < before * 0.5 THEN '候補が前回（' || before || '件）から' || uniq || '件に大きく減りました' END,
  CASE WHEN re > 0 THEN '抽出方法の変更（添付PDFを読む等）により ' || re || '件に版を追加しました（原文の変更ではありません）' END]) AS w, unnest(range(6)) AS n FROM r)
SELECT source_id, coalesce(string_agg(w, '|' ORDER BY n), '') AS warnings FROM w GROUP BY source_id""")
def run_warnings(t):
    """What a run warns of for each source, against the run before."""
    k = F.col("s_suppkey")
    rows = t("supplier").select(
        k.cast("string").alias("source_id"),
        (k % 8).alias("listed"),
        (k % 8).alias("unique"),
        (k % 3).alias("merged"),
        (k % 2).alias("rejected"),
        F.when(k % 9 == 0, "HTTP 500").alias("error"),
        (k % 5).alias("reextracted"),
    )
    before = t("supplier").where("s_suppkey % 10 <> 0").select(k.cast("string").alias("source_id"), F.lit(9).alias("candidates"))
    return S.run_warnings(rows, before, 6).select("source_id", F.array_join("warnings", "|").alias("warnings"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS source_id, l_orderkey, l_linenumber, more FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n, greatest(count(*) OVER (PARTITION BY l_suppkey) - 10, 0) AS more FROM lineitem) WHERE n <= 10")
def dry_run_head(t):
    """The first ten candidates of each source."""
    c = t("lineitem").select(
        F.col("l_suppkey").cast("string").alias("source_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("position"),
        "l_orderkey",
        "l_linenumber",
    )
    return S.head(c, 10).select("source_id", "l_orderkey", "l_linenumber", "more")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS source_id, true AS enabled FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_suppkey % 4 <> 0 FROM supplier WHERE s_suppkey IN (3, 4)")
def chosen_sources(t):
    """F16: enabled sources, and sources by name; an unknown name is an error."""
    s = t("supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), (F.col("s_suppkey") % 4 != 0).alias("enabled"))
    try:
        S.chosen_sources(s, ["3", "none"])
    except ValueError:
        return S.chosen_sources(s).unionByName(S.chosen_sources(s, ["3", "4"]))
    raise AssertionError("an unknown source was accepted")


STATUS_SQL = """e AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, user_id % 10 AS sk, event_type FROM events), last AS (SELECT max(run_id) AS r FROM e),
res AS (SELECT sk, CASE WHEN count(*) FILTER (event_type = 'error') * 3 > count(*) THEN 'failed' ELSE 'success' END AS st, count(*) FILTER (event_type = 'click') AS n FROM e, last WHERE run_id = r GROUP BY sk)"""


@query(f"""WITH {STATUS_SQL}, a AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS sk, count(*) AS articles, count(*) FILTER (c_acctbal < 0) AS date_unknown FROM customer GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 3 <> 0 THEN '2026-01-01T00:00:00+09:00' END AS last_success_at, CAST(CASE WHEN s_suppkey % 6 <> 5 THEN s_suppkey % 3 ELSE 0 END AS INTEGER) AS consecutive_failures,
  CAST(CASE WHEN s_suppkey % 6 <> 5 AND s_suppkey % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS retry_count, res.st AS last_status, CAST(res.n AS VARCHAR) AS last_new, coalesce(articles, 0) AS articles, coalesce(date_unknown, 0) AS date_unknown,
  CASE WHEN s_suppkey % 2 = 0 THEN '2 30 draft' WHEN s_suppkey % 5 = 1 THEN '3 30 ' END AS attachments FROM supplier LEFT JOIN res ON res.sk = s_suppkey LEFT JOIN a ON a.sk = s_suppkey""")
def status_sources(t):
    """Each configured source with its state, its result in the last run, its articles
    and its settings for attachments."""
    k = F.col("s_suppkey")
    none = lambda kind: F.lit(None).cast(kind)
    with_ = F.struct(
        F.lit(True).alias("pdf"),
        F.when(k % 2 == 0, 2).alias("max_files"),
        none("int").alias("max_bytes"),
        none("int").alias("max_pages"),
        F.when(k % 2 == 0, F.array(F.lit("draft"))).alias("exclude_titles"),
    )
    off = F.struct(
        F.lit(False).alias("pdf"),
        none("int").alias("max_files"),
        none("int").alias("max_bytes"),
        none("int").alias("max_pages"),
        none("array<string>").alias("exclude_titles"),
    )
    config = t("supplier").select(
        k.cast("string").alias("source_id"),
        F.col("s_name").alias("name"),
        F.when((k % 2 == 0) | (k % 5 == 1), with_).otherwise(off).alias("attachments"),
    )
    e = t("events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), (F.col("user_id") % 10).cast("string").alias("source_id"), "event_type")
    last = e.agg(F.max("run_id").alias("run_id"))
    results = e.join(F.broadcast(last), "run_id").groupBy("source_id").agg(
        F.when(F.count_if(F.col("event_type") == "error") * 3 > F.count(F.lit(1)), "failed").otherwise("success").alias("status"),
        F.count_if(F.col("event_type") == "click").alias("new"),
    )
    many = t("supplier").count()  # read from file footers
    articles = t("customer").select(
        (F.col("c_custkey") % many).cast("string").alias("source_id"),
        F.when(F.col("c_acctbal") >= 0, "2026").alias("published"),
    )
    rows = ST.attachment_settings(ST.sources(config, supplier_state(t), results, articles))
    shown = F.when(
        F.col("attachments").isNotNull(),
        F.concat_ws(" ", "attachments.max_files", "attachments.max_pages", F.array_join("attachments.exclude_titles", "|")),
    )
    return rows.select(
        "source_id",
        "name",
        "last_success_at",
        "consecutive_failures",
        "retry_count",
        F.col("last_run.status").alias("last_status"),
        F.col("last_run.new").cast("string").alias("last_new"),
        "articles",
        "date_unknown",
        shown.alias("attachments"),
    )


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, max(o_orderkey) AS id, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 2 THEN 'partial' ELSE 'success' END AS status FROM orders GROUP BY 1), f AS (SELECT *, CASE WHEN id % 5 <> 0 THEN d || 'e' END AS fin FROM r)
SELECT arg_max(status, d) AS last_run_status, arg_max(coalesce(fin, d), d) AS last_run_at, (SELECT fin FROM f WHERE status = 'success' ORDER BY d DESC LIMIT 1) AS last_full_success_at,
  max(d) FILTER (id % 3 <> 1) AS data_as_of, (SELECT string_agg(d, ' ' ORDER BY d DESC) FROM (SELECT d FROM f ORDER BY d DESC LIMIT 5)) AS newest FROM f""")
def runs_and_dates(t):
    """The last run, the last one without failure, when data were collected, and runs newest first."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd")
    r = t("orders").groupBy(at.alias("started_at")).agg(
        F.max("o_orderkey").alias("id"),
        F.when(F.count_if(F.col("o_orderstatus") == "P") > 2, "partial").otherwise("success").alias("status"),
    )
    runs = r.select(
        "started_at",
        F.col("id").cast("string").alias("run_id"),
        F.when(F.col("id") % 5 != 0, F.concat("started_at", F.lit("e"))).alias("finished_at"),
        "status",
        F.when(F.col("id") % 3 == 0, "collect").when(F.col("id") % 3 == 1, "summarize").otherwise("collect_and_summarize").alias("kind"),
    )
    seen = t("orders").select(F.lit("0").alias("first_seen_at"))
    newest = ST.run_list(runs).limit(5).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("started_at"), asc=False), lambda x: x), " ").alias("newest")
    )
    return ST.last_runs(runs).crossJoin(PB.data_as_of(runs, seen)).crossJoin(newest)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS source_id, 'https://example.org/r/' || s_suppkey || '/' || n AS url, CASE WHEN c_name IS NOT NULL THEN c_name END AS title, CASE n WHEN 0 THEN 'size_limit' ELSE 'attachment' END AS kind, CAST(n + 1 AS INTEGER) AS attempts
FROM supplier CROSS JOIN range(2) r(n) LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 8 = 0 WHERE s_suppkey % 6 <> 5 AND s_suppkey % 4 = 0""")
def retry_table(t):
    """Unfinished items of all sources with titles where the article is known."""
    known = t("customer").where("c_custkey % 8 = 0").select(F.concat(F.lit("x"), "c_custkey").alias("id"), F.col("c_name").alias("title"))
    return ST.retries(supplier_state(t), known).select("source_id", "url", "title", "kind", "attempts")


@query("SELECT count(*) FILTER (s_suppkey % 4 <> 0) AS enabled, count(*) FILTER (s_suppkey % 4 = 0) AS candidates FROM supplier")
def source_catalogue(t):
    """How many sources are in use and how many are candidates."""
    return ST.catalogue(t("supplier").select((F.col("s_suppkey") % 4 != 0).alias("enabled")))


# ---------------------------------------------------------------- summaries


@query(f"""WITH {ARTICLE_SQL} SELECT id AS article_id, latest AS version FROM b WHERE NOT failed AND NOT (s = 'success' AND sv = latest)""")
def unprocessed_articles(t):
    """Read versions whose last summary is not a success under the same keys."""
    files = article_files(t)
    latest = files.select(
        "article.article_id",
        F.col("article.latest_version").alias("version"),
        F.element_at("versions", -1)["extraction_status"].alias("extraction_status"),
        F.col("article.first_seen_at").alias("first_seen_at"),
        F.lit("m1").alias("model"),
        F.lit("t1").alias("tags_version"),
    )
    grouped = summary_rows(t).groupBy("article_id").agg(
        F.array_sort(F.collect_list(F.struct("processed_at", F.struct(*summary_columns(t)).alias("s")))).alias("x")
    )
    done = SU.last_for_version(grouped.select("article_id", F.transform("x", lambda v: v["s"]).alias("summaries")))
    return SU.needs_processing(latest, done, ["model", "tags_version"]).select("article_id", "version")


def summary_columns(t) -> list[str]:
    return summary_rows(t).columns


@query(f"""WITH {ARTICLE_SQL} SELECT count(*) FILTER (s = 'success') AS summarized, count(*) FILTER (s = 'failed_api_error') + count(*) FILTER (s <> 'none' AND ck % 5 = 1) AS failed, CAST(0 AS BIGINT) AS skipped, CAST(100 * (count(*) FILTER (s <> 'none') + count(*) FILTER (s <> 'none' AND ck % 5 = 1)) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(ck % 50) FILTER (s <> 'none'), 0) + coalesce(sum(ck % 50) FILTER (s <> 'none' AND ck % 5 = 1), 0) AS BIGINT) AS output_tokens, round(0.25 * (count(*) FILTER (s <> 'none') + count(*) FILTER (s <> 'none' AND ck % 5 = 1)), 6) AS cost FROM b""")
def usage_totals(t):
    """Requests that went well and badly, tokens and cost."""
    return SU.usage_totals(summary_rows(t))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'success' WHEN c_custkey % 2 = 0 THEN 'failed_refusal' ELSE 'failed_limit_exceeded' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS summary, CASE WHEN c_custkey % 3 <> 0 THEN '1' END AS tags, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 5 AS VARCHAR) END AS tokens FROM customer""")
def summary_record(t):
    """A record's answer fields are null, not empty, for a failure; zero tokens are unknown."""
    ok, none = F.col("c_custkey") % 3 != 0, lambda k: F.lit(None).cast(k)
    a = F.struct(
        F.col("c_name").alias("summary"),
        F.array().cast("array<string>").alias("key_points"),
        F.array().cast("array<string>").alias("targets"),
        none("array<string>").alias("dates"),
        F.array(F.lit("x")).alias("ai_tags"),
        none("array<string>").alias("uncertainties"),
    )
    status = F.when(ok, "success").when(F.col("c_custkey") % 2 == 0, "failed_refusal").otherwise("failed_limit_exceeded")
    got = t("customer").select("c_custkey", SU.record(status, a, F.col("c_custkey") % 5, F.lit(1)).alias("r"))
    return got.select(
        "c_custkey",
        F.col("r.analysis_status").alias("status"),
        F.col("r.summary").alias("summary"),
        F.when(F.col("r.ai_tags").isNotNull(), F.size("r.ai_tags").cast("string")).alias("tags"),
        F.col("r.input_tokens").cast("string").alias("tokens"),
    )


def _provider():
    """Outcomes by what a prompt holds: every kind once or until the retries end."""
    good = SU.Outcome("ok", "{}", 10, 1)
    return SU.MockProvider({
        "k0.": [good],
        "k1.": [SU.Outcome("retryable_error", tokens_in=10)],
        "k2.": [SU.Outcome("refusal", tokens_in=10)],
        "k3.": [SU.Outcome("truncated", "{", 10, 5)],
        "k4.": [SU.Outcome("api_error")],
        "k5.": [SU.Outcome("ok", "not JSON", 10, 2)],
    })


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS article_id, CASE s_suppkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'retryable_error' WHEN 2 THEN 'refusal' WHEN 3 THEN 'truncated' WHEN 4 THEN 'api_error' ELSE 'invalid' END AS kind, CAST(CASE WHEN s_suppkey % 6 IN (1, 3, 5) THEN 2 ELSE 0 END AS INTEGER) AS retries FROM supplier""")
def provider_outcomes(t):
    """Calls of a model with every outcome; which ones are tried again, and how often."""
    prompt = F.concat(text.prompt_text(F.col("s_name")), F.lit(" k"), F.col("s_suppkey") % 6, F.lit("."))
    asked = t("supplier").select(F.col("s_suppkey").cast("string").alias("article_id"), prompt.alias("prompt"))
    return SU.completed(asked, _provider, 2, pause=False).select("article_id", "kind", "retries")


@query("SELECT p_brand AS name, min(p_partkey) AS first_seen_at, arg_min(p_name, p_partkey) AS reason FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 0) GROUP BY p_brand")
def proposed_tags(t):
    """Proposed names that are not known, each once with its first proposal; appended once, however often."""
    spark = t("part").sparkSession
    found = t("part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("reason"), F.col("p_partkey").alias("first_seen_at"))
    folder = shared_folder(spark, "summaries")
    records = summary_rows(t)
    known = found.where("first_seen_at % 50 = 0")
    SK.commit_summaries(records, known, folder)
    for _ in range(2):
        SK.commit_summaries(records.limit(0), found, folder)
    return spark.read.schema(found.schema).parquet(f"{folder}/tag_candidates").join(known.select("name").distinct(), "name", "left_anti")


@query(f"""WITH {ARTICLE_SQL} SELECT id AS article_id, CASE s WHEN 'success' THEN 'About ' || c_mktsegment END AS summary, c_name || ' ' || c_mktsegment AS title FROM b WHERE s <> 'none'""")
def comparison_output(t):
    """Results joined to titles, written beside the data."""
    spark = t("customer").sparkSession
    folder = shared_folder(spark, "comparison")
    results = summary_rows(t).where("processed_at >= '2026-05-09'").select("article_id", "summary")
    SK.comparison(results, article_files(t).select("article.article_id", "article.title"), folder)
    return spark.read.schema("article_id string, summary string, title string").json(folder)


@query("SELECT CAST(doc_id AS VARCHAR) AS article_id, CAST(1 + doc_id % 2 AS INTEGER) AS version, md5(text) AS digest FROM documents")
def body_sink(t):
    """Bodies written once, however often they come."""
    spark = t("documents").sparkSession
    folder = shared_folder(spark, "bodies")
    bodies = t("documents").select(F.col("doc_id").cast("string").alias("article_id"), (1 + F.col("doc_id") % 2).cast("int").alias("version"), "text")
    SK.cache_texts(bodies.where("version = 1"), folder)
    SK.cache_texts(bodies, folder)
    return spark.read.schema(bodies.schema).parquet(folder).select("article_id", "version", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- integrity


@query(f"""WITH {ARTICLE_SQL} SELECT 'file_name' AS "check", id || '.txt' AS key FROM b WHERE ck % 50 = 1 UNION ALL SELECT 'article_id', id FROM b WHERE ck % 50 = 2 UNION ALL SELECT DISTINCT 'source', 'n24' FROM b WHERE c_nationkey = 24
UNION ALL SELECT 'latest_version', id FROM b WHERE ck % 50 = 3 UNION ALL SELECT 'first_version', id FROM b WHERE ck % 50 = 4 UNION ALL SELECT 'version_article', id FROM b WHERE ck % 50 = 5 UNION ALL SELECT 'versions', id FROM b WHERE ck % 50 = 6
UNION ALL SELECT 'version_state', id FROM b WHERE ck % 50 = 8 AND NOT (failed AND latest = 1) UNION ALL SELECT 'dates', id FROM b WHERE ck % 50 = 9 AND published IS NOT NULL""")
def article_integrity(t):
    """Article files against every rule, with files that break one each."""
    k = F.col("ck") % 50
    a, v = F.col("article"), F.col("versions")
    edit = lambda f: F.transform("versions", f)
    bad = article_files(t).select(
        F.when(k == 2, a.withField("canonical_url", F.lit("u"))).when(k == 3, a.withField("latest_version", F.lit(9))).when(
            k == 9,
            a.withField("date_precision", a["date_precision"].withField("published", F.lit("unknown"))),
        ).otherwise(a).alias("article"),
        F.when(k == 4, edit(lambda x: x.withField("change_type", F.lit("content_changed")))).when(k == 5, edit(lambda x: x.withField("article_id", F.lit("z")))).when(k == 6, edit(lambda x: x.withField("version", x["version"] + 1))).when(
            k == 8,
            edit(lambda x: x.withField("content_hash", F.lit(None).cast("string"))),
        ).otherwise(v).alias("versions"),
        F.concat("article.article_id", F.when(k == 1, ".txt").otherwise(".json")).alias("file"),
    )
    six = bad.withColumn(
        "article",
        F.when(F.element_at("versions", 1)["version"] == 2, a.withField("latest_version", a["latest_version"] + 1)).otherwise(a),
    )
    return VA.articles(six, nation_sources(t)).select("check", "key")


@query(f"""WITH {ARTICLE_SQL}, x AS (SELECT DISTINCT 'summary_tag' AS "check", c_mktsegment AS key FROM b WHERE s = 'success' AND NOT starts_with(c_mktsegment, 'M')) SELECT * FROM x UNION ALL SELECT 'summary_tag', 'picked' WHERE EXISTS (SELECT 1 FROM b WHERE s = 'success')
UNION ALL SELECT 'summary_article', id FROM b WHERE s <> 'none' AND ck % 40 = 1 UNION ALL SELECT 'summary_success', id FROM b WHERE s = 'success' AND ck % 40 = 2 UNION ALL SELECT 'summary_failure', id FROM b WHERE s = 'failed_api_error' AND ck % 40 = 5 UNION ALL SELECT 'summary_reason', id FROM b WHERE s = 'failed_api_error' AND ck % 40 = 17""")
def summary_integrity(t):
    """Summaries of unknown articles, with unknown tags, with too much or too little."""
    keys = article_files(t).select("ck", F.col("article.article_id").alias("article_id"))
    s = summary_rows(t).where("processed_at >= '2026-05-09'").join(keys, "article_id").withColumn("k", F.col("ck") % 40)
    bad = s.withColumn(
        "summary",
        F.when(F.col("k") == 2, F.repeat(F.lit("x"), 301)).when(F.col("k") == 5, F.lit("x")).otherwise(F.col("summary")),
    ).withColumn("error", F.when(F.col("k") != 17, F.col("error")))
    return VA.summaries(bad, keys.where("ck % 40 <> 1"), tag_definitions(t).where("enabled")).select("check", "key")


@query("""SELECT 'override_add' AS "check", 'off' AS key UNION ALL SELECT 'override_remove', 'none' UNION ALL SELECT 'override_both', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 9 = 3 UNION ALL SELECT 'override_twice', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 9 = 4 UNION ALL SELECT 'override_article', '7'""")
def override_integrity(t):
    """Tags added or removed by hand that are unknown, disabled, repeated or in both lists."""
    k = F.col("s_suppkey") % 9
    add = F.when(k == 1, F.array(F.lit("off"))).when(k == 4, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    remove = F.when(k == 2, F.array(F.lit("none"))).when(k == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = t("supplier").select(F.col("s_suppkey").cast("string").alias("article_id"), add.alias("add"), remove.alias("remove"))
    tags = rows.sparkSession.createDataFrame([("x", True), ("off", False)], "tag_id string, enabled boolean")
    return VA.overrides(rows.unionByName(rows.where("article_id = '7'")), tags).select("check", "key")


@query("""SELECT 'state_source' AS "check", CAST(s_suppkey AS VARCHAR) AS key FROM supplier WHERE s_suppkey % 6 <> 5 AND s_suppkey % 10 = 1 UNION ALL SELECT 'retry_article', 'x' || s_suppkey FROM supplier WHERE s_suppkey % 6 <> 5 AND s_suppkey % 4 = 0 AND s_suppkey % 3 = 0
UNION ALL SELECT 'run_source', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 1 UNION ALL SELECT 'run_totals', 'r' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 0""")
def state_and_run_integrity(t):
    """States and runs of unknown sources, retries of unknown articles, totals that are not the sums."""
    config = t("supplier").where("s_suppkey % 10 <> 1").select(F.col("s_suppkey").cast("string").alias("source_id"))
    known = t("supplier").where("s_suppkey % 3 <> 0").select(F.concat(F.lit("x"), "s_suppkey").alias("article_id"))
    k = F.col("s_suppkey")
    result = lambda n: F.struct(
        k.cast("string").alias("source_id"),
        F.lit(n).alias("new"),
        F.lit(1).alias("changed"),
        F.lit(0).alias("unchanged"),
    )
    totals = F.struct(F.when(k % 7 == 0, 9).otherwise(3).alias("new"), F.lit(2).alias("changed"), F.lit(0).alias("unchanged"))
    runs = t("supplier").select(F.concat(F.lit("r"), k).alias("run_id"), F.array(result(1), result(2)).alias("sources"), totals.alias("totals"))
    return VA.all_of(VA.state(supplier_state(t), config, known), VA.runs(runs, config)).select("check", "key")


@query("""WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS id FROM supplier) SELECT 'source_id' AS "check", '3' AS key, count(*) AS n FROM s WHERE k = 3 UNION ALL SELECT 'csv_id', 'C' || (k - 1), count(*) FROM s WHERE k % 10 = 5 GROUP BY k UNION ALL SELECT 'entry_host', id, 1 FROM s WHERE k % 10 = 1
UNION ALL SELECT 'pattern', id, 1 FROM s WHERE k % 10 = 2 UNION ALL SELECT 'fixed_tag', id, CASE k WHEN 3 THEN 4 ELSE 2 END FROM s WHERE k % 10 = 3 UNION ALL SELECT 'csv_field', id, 2 FROM s WHERE k % 10 = 6
UNION ALL SELECT 'tag_id', 'T4', 1 UNION ALL SELECT 'tag_name', 'name 4', 1 UNION ALL SELECT 'rule_only', 'T1', 1 UNION ALL SELECT 'rule_label', 'T2', 1 UNION ALL SELECT 'pattern', 'T3', 1""")
def configuration_integrity(t):
    """Settings of sources and tags against every rule, with settings that break one each."""
    sources = []
    for r in t("supplier").select("s_suppkey").orderBy("s_suppkey").collect():
        k = r[0]
        s = {
            "id": str(k),
            "entry_url": f"https://Example.org/{k}",
            "allowed_hosts": ["example.org"] if k % 10 != 1 else ["other.org"],
            "enabled": k % 10 != 7,
            "csv_id": f"C{k - 1 if k % 10 == 5 else k}",
            "publisher": "p",
            "source_type": "news",
            "fixed_tags": ["T0"],
        }
        s |= {
            2: {"link_rules": {"include": ["ok", "("]}},
            3: {"fixed_tags": ["none", "T5", "T0"]},
            6: {"publisher": "", "source_type": None},
            7: {"publisher": None},
        }.get(k % 10, {})
        sources += [s] * (2 if k == 3 else 1)
    for s in sources:
        if int(s["id"]) == 3 and sum(x is s for x in sources) == 2:
            s["csv_id"] = ""
            s["enabled"] = False
    rule = lambda label, pattern="x": {"label": label, "pattern": pattern}
    tags = [
        {"id": "T0", "name": "n"},
        {"id": "T1", "name": "name 1", "auto_rules": [rule("a")]},
        {"id": "T2", "name": "name 2", "rule_only": True, "auto_rules": [rule("a"), rule("a")]},
        {"id": "T3", "name": "name 3", "rule_only": True, "auto_rules": [rule("a", "[")]},
        {"id": "T4", "name": "name 4"},
        {"id": "T4", "name": "name 4"},
        {"id": "T5", "name": "name 5"},
    ]
    found = VA.sources(sources, {x["id"] for x in tags}, {"T5"}) + VA.tags(tags)
    rows = t("supplier").sparkSession.createDataFrame(found, "check string, key string, message string")
    return rows.groupBy("check", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ARTICLE_SQL} SELECT 'rule_article' AS "check", id AS key FROM b WHERE ck % 30 = 1 UNION ALL SELECT 'rule_version', id FROM b WHERE ck % 30 = 2 UNION ALL SELECT 'rule_tag', 'odd' UNION ALL SELECT 'candidate_article', id FROM b WHERE ck % 30 = 1 AND ck % 2 = 0
UNION ALL SELECT 'summary_version', id FROM b WHERE s <> 'none' AND ck % 30 = 4 UNION ALL SELECT 'state_key', 'key' || s_suppkey FROM supplier WHERE s_suppkey % 6 <> 5 AND s_suppkey % 10 = 2 UNION ALL SELECT 'run_period', 'r' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 3""")
def reference_integrity(t):
    """Remembered rule tags, proposed tags, summaries, states and runs that refer to what is not there."""
    a = article_files(t).select("ck", "article.article_id", F.col("article.latest_version").alias("latest_version"))
    k = F.col("ck") % 30
    tag = F.array(F.struct(F.when(k == 3, "odd").otherwise("metal").alias("tag_id")))
    entries = a.select(
        "article_id",
        F.when(k == 2, F.col("latest_version") + 1).otherwise(F.col("latest_version")).alias("article_version"),
        tag.alias("tags"),
    )
    known = a.where(k != 1).select("article_id", "latest_version")
    definitions = t("region").sparkSession.createDataFrame([("metal",)], "tag_id string")
    rules = VA.rule_tags(entries, known, definitions)
    proposed = VA.tag_candidates(a.where("ck % 2 = 0").select("article_id"), known)
    s = summary_rows(t).where("processed_at >= '2026-05-09'").join(a, "article_id")
    late = s.withColumn("article_version", F.when(k == 4, F.col("latest_version") + 1).otherwise(F.col("article_version"))).drop("latest_version")
    versions = VA.summaries(late, a, tag_definitions(t)).where(F.col("check") == "summary_version")
    state = supplier_state(t).withColumn(
        "key",
        F.when(F.col("source_id").cast("int") % 10 == 2, F.concat(F.lit("key"), "source_id")).otherwise(F.col("source_id")),
    )
    keys = VA.state(state, state.select("source_id"), state.select(F.explode("retry_queue.article_id").alias("article_id")))
    period = F.struct(F.lit("2026-02-01").alias("start"), F.when(F.col("s_suppkey") % 10 == 3, "2026-01-01").otherwise("2026-03-01").alias("end"))
    result = F.struct(F.col("s_suppkey").cast("string").alias("source_id"), *(F.lit(0).alias(c) for c in ("new", "changed", "unchanged")))
    runs = t("supplier").select(
        F.concat(F.lit("r"), "s_suppkey").alias("run_id"),
        F.array(result).alias("sources"),
        F.struct(*(F.lit(0).alias(c) for c in ("new", "changed", "unchanged"))).alias("totals"),
        period.alias("period"),
    )
    periods = VA.runs(runs, t("supplier").select(F.col("s_suppkey").cast("string").alias("source_id")))
    return VA.all_of(rules, proposed, versions, keys, periods).select("check", "key")


#: A schema of this module's records: references, conditions, combinations, closed objects.
RECORD_SCHEMA = {
    "$defs": {"id": {"type": "string", "pattern": "^[a-z][0-9]+$"}},
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "status", "tags"],
    "properties": {
        "id": {"$ref": "#/$defs/id"},
        "status": {"enum": ["ok", "failed"]},
        "n": {"oneOf": [{"type": "null"}, {"type": "integer", "minimum": 0}]},
        "tags": {"type": "array", "uniqueItems": True, "maxItems": 3, "items": {"type": "string", "minLength": 1}},
        "error": {"type": ["string", "null"]},
    },
    "if": {"properties": {"status": {"const": "failed"}}},
    "then": {"required": ["error"]},
}


@query("""SELECT s_suppkey, CASE s_suppkey % 9 WHEN 1 THEN 'id: pattern' WHEN 2 THEN 'status: enum' WHEN 3 THEN '(root): required error' WHEN 4 THEN 'n: oneOf' WHEN 5 THEN 'tags: unique' WHEN 6 THEN 'tags/1: length|tags/1: type' WHEN 7 THEN '(root): unknown extra' WHEN 8 THEN '(root): not JSON' ELSE '' END AS errors FROM supplier""".replace("'tags/1: length|tags/1: type'", "'tags/1: type'"))
def json_schema_errors(t):
    """JSON records against a schema, with the errors in order."""
    k = F.col("s_suppkey") % 9
    j = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    id_ = F.when(k == 1, "Bad").otherwise(F.concat(F.lit("s"), "s_suppkey"))
    status = F.when(k == 2, "odd").when(k == 3, "failed").otherwise("ok")
    tags = F.when(k == 5, '["x","x"]').when(k == 6, '["x",1]').otherwise('["x","y"]')
    record = F.concat(
        F.lit('{"id":'),
        j(id_),
        F.lit(',"status":'),
        j(status),
        F.lit(',"tags":'),
        tags,
        F.when(k == 4, ',"n":-1').otherwise(',"n":null'),
        F.when(k == 7, ',"extra":1').otherwise(""),
        F.when(k == 8, "").otherwise("}"),
    )
    found = SC.schema_errors(RECORD_SCHEMA)(record)
    return t("supplier").select("s_suppkey", F.array_join(found, "|").alias("errors"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 'a/.env' WHEN 2 THEN '.env.local' WHEN 3 THEN '.env.example' WHEN 4 THEN 'web/node_modules/x.js' WHEN 5 THEN 'run.log' WHEN 6 THEN 'logs/x' ELSE 'src/' || doc_id || '.py' END AS path FROM documents)
SELECT path, CASE doc_id % 10 WHEN 1 THEN '.env' WHEN 2 THEN '.env' WHEN 4 THEN 'node_modules/' WHEN 5 THEN '.log' WHEN 6 THEN 'logs/' WHEN 7 THEN 'secret' END AS problem FROM f WHERE doc_id % 10 IN (1, 2, 4, 5, 6, 7)
UNION ALL SELECT path, 'secret' FROM f JOIN documents USING (doc_id) WHERE doc_id % 10 IN (0, 3, 8) AND octet_length(encode(text)) <= 2000000 AND regexp_matches(text, 'sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|xox[baprs]-[A-Za-z0-9-]{10,}')""")
def repository_guard(t):
    """files that must not be committed, by path or by a token in their text; files with a zero byte are
    not searched."""
    k = F.col("doc_id") % 10
    path = F.when(k == 1, "a/.env").when(k == 2, ".env.local").when(k == 3, ".env.example").when(k == 4, "web/node_modules/x.js").when(k == 5, "run.log").when(k == 6, "logs/x").otherwise(
        F.concat(F.lit("src/"), "doc_id", F.lit(".py"))
    )
    key = F.lit(" ghp_" + "a1" * 12)
    body = F.when(k == 7, F.concat("text", key)).when(k == 9, F.concat("text", F.lit("\x00"), key)).otherwise(F.col("text"))
    return text.unsafe_files(t("documents").select(path.alias("path"), body.cast("binary").alias("content")))


@query("SELECT doc_id FROM documents WHERE contains(text, (SELECT substr(text, 1, 14) FROM benchmark WHERE item_id = 1)) OR contains(text, (SELECT substr(text, 5, 9) FROM benchmark WHERE item_id = 2))")
def environment_secrets(t):
    """texts that hold a value of the environment's variables with secret names; short values and other
    variables do not count."""
    items = {r["item_id"]: r["text"] for r in t("benchmark").where("item_id in (1, 2)").collect()}
    values = text.secret_values({"API_KEY": items.get(1, "")[:14], "my_token": items.get(2, "")[4:13], "PASSWORD": " the ", "HOME": " the the"})
    return t("documents").where(text.has_secret(F.col("text"), values)).select("doc_id")


@query("""SELECT n AS place, 'd' || lpad(CAST(n AS VARCHAR), 2, '0') AS title, CAST(1 + n % 3 AS INTEGER) AS versions, CASE n % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'year' WHEN 2 THEN 'month' ELSE 'day' END AS "precision" FROM range(1, 21) r(n)""")
def demo_data(t):
    """Twenty fictional articles and four runs, the same at every call; their records pass the integrity checks."""
    from gleanery.sources import demo

    spark = t("region").sparkSession
    files = demo.articles(spark)
    problems = VA.articles(files.withColumn("file", F.concat("article.article_id", F.lit(".json"))), demo.sources(spark))
    if problems.count() or demo.runs(spark).count() != 4:
        raise AssertionError("the fictional data are not whole")
    return files.select(
        F.substring("article.title", 2, 9).cast("long").alias("place"),
        F.col("article.title").alias("title"),
        F.size("versions").alias("versions"),
        F.col("article.date_precision.published").alias("precision"),
    )
