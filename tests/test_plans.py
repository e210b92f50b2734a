import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from gleanery.operators import rules as R
from gleanery.plans import external_csv, public, status, validate, weekly, wiki
from gleanery.functions.text import article_id
from gleanery.schemas import SCHEMAS, SUMMARY
from gleanery.streaming import flows


def version(n, kind="content_changed", at="2026-09-15T10:00:00+09:00", ok=True, **k):
    return {"article_id": k.pop("id"), "version": n, "content_hash": "sha256:x" if ok else None, "fetched_at": at, "content_type": "html", "text_length": 3, "extraction_status": "ok" if ok else "failed", "extraction_error": None if ok else "HTTP 500", "change_type": kind} | k


def record(id_, url, published=None, versions=None, source="s1", seen="2026-09-16T08:00:00+09:00"):
    vs = versions or [version(1, "new", id=id_)]
    basis = {"method": "m", "evidence": "<b>e</b>"} if published else None
    precision = {None: "unknown", 4: "year", 7: "month", 10: "day"}[len(published) if published else None]
    return {"schema_version": 1, "article": {"article_id": id_, "source_id": source, "canonical_url": url, "title": f"T {id_}", "published_at": published, "updated_at": None, "date_basis": {"published": basis, "updated": None}, "date_precision": {"published": precision, "updated": "unknown"}, "first_seen_at": seen, "last_seen_at": seen, "latest_version": len(vs), "status": "active"}, "versions": vs}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    urls = [f"https://a.jp/{k}" for k in range(5)]
    ids = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1).select(article_id(F.col("u"))).collect()]
    files = [
        record(ids[0], urls[0], "2026-09-16"),
        record(ids[1], urls[1], "2026-08-01", [version(1, "new", "2026-08-01T00:00:00+09:00", id=ids[1]), version(2, id=ids[1]), version(3, at="2026-09-17T23:00:00+09:00", id=ids[1], attachments=[{"url": "u", "title": "t", "status": "ok", "error": None, "text_length": 1, "pages": 2, "pages_read": 2}])]),
        record(ids[2], urls[2], None),
        record(ids[3], urls[3], "2026-09", source="nowhere"),
        record(ids[4], urls[4], "2026-09-20", [version(1, "new", id=ids[4]), version(2, at="2026-09-15T15:30:00+00:00", id=ids[4])]),
    ]
    folder = tmp_path_factory.mktemp("articles")
    for f in files:
        (folder / f"{f['article']['article_id']}.json").write_text(json.dumps(f))
    articles = spark.read.schema(SCHEMAS["article"]).option("multiLine", True).json(str(folder))
    good = {"article_id": ids[0], "article_version": 1, "analysis_status": "success", "error": None, "summary": "sum", "key_points": ["p"], "targets": ["t"], "dates": [], "ai_tags": [{"tag_id": "x", "reason": "r"}], "uncertainties": [], "processed_at": "t2"}
    summaries = [good, good | {"analysis_status": "failed", "processed_at": "t1", "error": "e"}, good | {"article_id": ids[1], "article_version": 2}, {"article_id": ids[2], "article_version": 1, "analysis_status": "failed", "error": "bad", "processed_at": "t"}]
    s = spark.createDataFrame([(json.dumps(x),) for x in summaries], "j string").select(F.from_json("j", SUMMARY).alias("s")).select("s.*")
    sources = spark.createDataFrame([("s1", "Source", None, ["fixed"])], "source_id string, name string, source_type string, fixed_tags array<string>")
    defs = spark.createDataFrame([("x", "Ex", True), ("fixed", "Fixed", True), ("rule", "Rule", True)], "tag_id string, name string, enabled boolean")
    overrides = spark.createDataFrame([(ids[0], ["added"], ["fixed"], "why")], "article_id string, add array<string>, remove array<string>, reason string")
    bodies = articles.select("article.article_id", "article.title", F.lit("body").alias("body"))
    matches = R.matches(bodies.where(F.col("article_id") == ids[2]), [{"tag_id": "rule", "label": "b", "pattern": "BODY"}])
    return ids, articles, s, public.public_articles(articles, s, sources, defs, overrides, matches).cache()


def test_public(data):
    ids, _, _, out = data
    rows = {r["id"]: r for r in out.collect()}
    assert [r["id"] for r in out.collect()] == [ids[4], ids[0], ids[3], ids[1], ids[2]]
    a = rows[ids[0]]
    assert [(t["id"], t["origin"], t["retired"]) for t in a["tags"]] == [("x", "ai", False), ("added", "human", True)] and [t["name"] for t in a["removed_tags"]] == ["Fixed"]
    assert a["summary"]["status"] == "success" and a["summary"]["text"] == "sum" and a["published_info"]["basis"]["evidence"] == "e" and a["tag_override_reason"] == "why"
    b = rows[ids[1]]
    assert b["summary"]["outdated"] and len(b["attachments"]) == 1 and b["csv"]["hash_status"] == "unavailable" and len(b["versions"]) == 3
    c = rows[ids[2]]
    assert c["summary"]["status"] == "failed" and c["summary"]["key_points"] is None and [t["id"] for t in c["tags"]] == ["fixed", "rule"]
    d = rows[ids[3]]
    assert d["source_name"] == "nowhere" and d["summary"]["status"] == "not_processed" and d["tags"] == []
    assert public.detail(out, ids[0]).first()["tags_human"][0]["id"] == "added"
    lines = [r["line"] for r in public.list_csv(out).collect()]
    text = public.csv_text(public.LIST_COLUMNS, lines)
    assert text.startswith("﻿記事ID,") and text.endswith("\r\n") and len(lines[0].split(",")) == 17
    assert json.loads(public.filtered_json(out, "real").first()["value"])["release_mode"] == "real"


def test_weekly(spark, data):
    ids, _, _, out = data
    weeks = weekly.windows(spark.createDataFrame([(date(2026, 9, 21),)], "day date"), out).cache()
    got = sorted((r["k"], r["id"], r["kind"], r["version"]) for r in weekly.members(weeks, out, 7).collect() if r["k"] < 2)
    assert got == sorted([(0, ids[0], "new", None), (0, ids[4], "new", None), (0, ids[1], "changed", 3)])
    runs = spark.createDataFrame([("r1", "2026-09-14T15:30:00+00:00", [("s1", "failed", 1, 2, "why")]), ("r2", "2026-09-01T00:00:00+09:00", [])], "run_id string, started_at string, sources array<struct<source_id:string,status:string,new:int,changed:int,error:string>>")
    counts = {r["k"]: tuple(r)[3:] for r in weekly.counts(weeks, out, runs, 7).collect()}
    assert counts[0] == (2, 1, 2, 1, 0, 1)
    kept = [tuple(r) for r in weekly.source_runs(weeks.where("k < 2"), runs, spark.createDataFrame([("s1", "S"), ("s2", "T")], "source_id string, name string")).select("k", "source_id", "run_id").collect()]
    assert sorted(kept, key=str) == sorted([(0, "s1", "r1"), (0, "s2", None), (1, "s1", None), (1, "s2", None)], key=str)
    lines = {k: [] for k in ("new", "changed")}
    for r in weekly.items(weeks.where("k = 0"), out, 7).select("kind", weekly.item_line(F.col("kind")).alias("line")).collect():
        lines[r["kind"]].append(r["line"])
    assert "（第3版）" in lines["changed"][0] and lines["new"][0].startswith("- 2026年9月20日　Source　[T a\\_")
    week = weekly.counts(weeks, out, runs, 7).where("k = 0").first().asDict()
    text = weekly.markdown(week, lines, [("Ex", 1)], "site")
    assert "| 新規 | 2 |" in text and "## 変更（1件）" in text and "| Ex | 1 |" in text
    assert weekly.selected_week(weeks, "2026-09-08_2026-09-14").first()["k"] == 1 and weekly.selected_week(weeks, "x").first()["k"] == 0


def test_csv_and_wiki(spark, data):
    ids, _, _, out = data
    config = spark.createDataFrame([("s1", None, "Pub", None)], "source_id string, csv_id string, publisher string, list_url string")
    wanted = spark.createDataFrame([(ids[0],), (ids[0],), (ids[2],), ("none",)], "id string")
    rows = external_csv.rows(out, config, wanted)
    assert rows.columns == external_csv.COLUMNS
    got = rows.collect()
    assert [r["published_date"] for r in got] == ["2026-09-16", ""] and got[0]["record_id"] == "S1_20260916_001" or got[0]["record_id"].startswith("S1_20260916_")
    assert got[0]["category"] == "Ex" and got[0]["excerpt"] == "sum 【主な論点】p" and got[0]["fetched_at"] == "2026-09-16T08:00:00+09:00" and got[1]["publisher"] == "Pub"
    assert external_csv.lines(rows).count() == 2
    n = spark.range(998, 1001).select(external_csv.padded(F.col("id"))).collect()
    assert [r[0] for r in n] == ["998", "999", "1000"] and spark.range(7, 8).select(external_csv.padded(F.col("id"))).first()[0] == "007"
    name = spark.range(1).select(external_csv.file_name(F.lit("2026-09-01T00:05:00Z").cast("timestamp"))).first()[0]
    assert name == "external_news_20260901_0905.csv"
    tags = spark.createDataFrame([("x",), ("unused",)], "tag_id string")
    assert {r["tag_id"]: (r["n"], r["latest"]) for r in wiki.index(out, tags).collect()} == {"x": (2, "2026-09-16"), "unused": (0, None)}
    assert [(r["month"], r["ids"]) for r in wiki.groups(out, "fixed").collect()] == [("2026-09", [ids[4]]), ("2026-08", [ids[1]]), ("日付不明", [ids[2]])]


def test_status(spark, data):
    ids, _, _, out = data
    assert tuple(status.overall(out).first()) == (5, 1, 0, 3, 1)
    config = spark.createDataFrame([("s1", "One", True, None), ("s2", "Two", True, None), ("s3", "Off", False, None)], "source_id string, name string, enabled boolean, attachments struct<pdf:boolean,max_files:int,max_bytes:int,max_pages:int,exclude_titles:array<string>>")
    state = spark.createDataFrame([("s1", "2026-09-01T00:00:00+09:00", 0, [("u", ids[0], "fetch", "添付を取得できない", "t", 1)])], "source_id string, last_success_at string, consecutive_failures int, retry_queue array<struct<url:string,article_id:string,stage:string,reason:string,first_failed_at:string,attempts:int>>")
    results = spark.createDataFrame([("s1", "success", ["抽出0件"])], "source_id string, status string, warnings array<string>")
    rows = status.sources(config, state, results, out)
    got = {r["source_id"]: r for r in rows.collect()}
    assert got["s1"]["articles"] == 4 and got["s1"]["date_unknown"] == 1 and got["s1"]["retry_count"] == 1 and got["s2"]["articles"] == 0 and got["s2"]["last_run"] is None
    warned = status.warnings(rows.withColumn("last_warnings", F.col("last_run.warnings")), F.lit("2026-09-21T00:00:00+09:00").cast("timestamp"), 8)
    assert [(r["source_id"], r["place"]) for r in warned.orderBy("source_id", "place").collect()] == [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 0)]
    assert "20日" in warned.where("source_id = 's1' and place = 0").first()["warning"]
    assert [(r["title"], r["kind"]) for r in status.retries(state, out).collect()] == [(f"T {ids[0]}", "attachment")]
    assert tuple(status.catalogue(config).first()) == (2, 1)
    runs = spark.createDataFrame([("r1", "t1", "t1e", "success", "collect"), ("r2", "t2", None, "partial", "summarize")], "run_id string, started_at string, finished_at string, status string, kind string")
    assert tuple(status.last_runs(runs).first()) == ("partial", "t2", "t1e") and status.run_list(runs).first()["run_id"] == "r2"
    assert public.data_as_of(runs, out).first()[0] == "t1" and public.data_as_of(runs.limit(0), out).first()[0] == "2026-09-16T08:00:00+09:00"
    with_settings = status.attachment_settings(config.withColumn("attachments", F.when(F.col("source_id") == "s1", F.struct(F.lit(True).alias("pdf"), F.lit(1).alias("max_files"), F.lit(None).cast("int").alias("max_bytes"), F.lit(None).cast("int").alias("max_pages"), F.lit(None).cast("array<string>").alias("exclude_titles")))))
    assert {r["source_id"]: r["attachments"] and tuple(r["attachments"]) for r in with_settings.collect()} == {"s1": (1, 10 << 20, 30, []), "s2": None, "s3": None}


def checks(df):
    return {r["check"] for r in df.collect()}


def test_validation(spark, data):
    ids, articles, summaries, out = data
    known = spark.createDataFrame([("s1",), ("nowhere",)], "source_id string")
    files = articles.withColumn("file", F.concat("article.article_id", F.lit(".json")))
    assert checks(validate.articles(files, known)) == set()
    bad = {
        "file_name": files.withColumn("file", F.lit("x.json")),
        "article_id": files.withColumn("article", F.col("article").withField("canonical_url", F.lit("u"))),
        "latest_version": files.withColumn("article", F.col("article").withField("latest_version", F.lit(9))),
        "first_version": files.withColumn("versions", F.transform("versions", lambda v: v.withField("change_type", F.lit("content_changed")))),
        "version_article": files.withColumn("versions", F.transform("versions", lambda v: v.withField("article_id", F.lit("z")))),
        "versions": files.withColumn("versions", F.transform("versions", lambda v: v.withField("version", F.lit(3)))),
        "version_state": files.withColumn("versions", F.transform("versions", lambda v: v.withField("content_hash", F.lit(None).cast("string")))),
        "dates": files.withColumn("article", F.col("article").withField("published_at", F.lit("2026"))),
    }
    for name, df in bad.items():
        assert name in checks(validate.articles(df, known)), name
    assert checks(validate.articles(files, known.where("source_id = 's1'"))) == {"source"}
    tags = spark.createDataFrame([("x", True), ("off", False)], "tag_id string, enabled boolean")
    a = articles.select("article.article_id")
    assert checks(validate.summaries(summaries, a, tags)) == {"summary_failure"}  # a failure with content is among them
    assert checks(validate.summaries(summaries.where("analysis_status = 'success'").withColumn("key_points", F.array(*[F.lit("p")] * 6)), a.limit(0), tags.limit(0))) == {"summary_article", "summary_tag", "summary_success"}
    o = spark.createDataFrame([("a", ["off"], ["z"]), ("b", ["x", "x"], ["x"]), ("b", [], [])], "article_id string, add array<string>, remove array<string>")
    assert checks(validate.overrides(o, tags)) == {"override_add", "override_remove", "override_both", "override_twice", "override_article"}
    config = [{"id": "a", "entry_url": "https://h.jp/", "allowed_hosts": ["H.jp"], "fixed_tags": ["x"]}, {"id": "a", "entry_url": "https://h.jp/", "allowed_hosts": [], "fixed_tags": ["no"], "link_rules": {"include": ["("]}}]
    assert {c for c, _, _ in validate.sources(config, {"x"})} == {"source_id", "entry_host", "pattern", "fixed_tag"}
    st = spark.createDataFrame([("s9", -1, [("no",)])], "source_id string, consecutive_failures int, retry_queue array<struct<article_id:string>>")
    assert checks(validate.state(st, known, a)) == {"state_source", "retry_article", "state_failures"}
    runs = spark.createDataFrame([("r", [("s9", 1, 0, 0)], (2, 0, 0)), ("r", [], (0, 0, 0))], "run_id string, sources array<struct<source_id:string,new:int,changed:int,unchanged:int>>, totals struct<new:int,changed:int,unchanged:int>")
    assert checks(validate.runs(runs, known)) == {"run_source", "run_totals", "run_id"}
    assert checks(validate.public(out)) == set() and checks(validate.public(out.withColumn("title", F.lit("ghp_" + "a" * 20)))) == {"secret"}


def test_publish(spark, data, tmp_path):
    _, _, _, out = data
    folder = f"{tmp_path}/public"
    public.publish(out.limit(2), folder, validate.public(out))
    assert public.published(spark, folder).count() == 2
    for _ in range(2):
        public.publish(out.limit(3), folder)
    assert public.published(spark, folder).count() == 3 and len(list((tmp_path / "public").glob("v*"))) == 2
    with pytest.raises(ValueError):
        public.publish(out, folder, validate.public(out.withColumn("title", F.lit("AKIA" + "A" * 16))))
    assert public.published(spark, folder).count() == 3


def test_streams_carry_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, place long, hash string, ok boolean, profile string"
    rows = [("a", 0, "x", True, "p"), ("a", 1, "x", True, "p"), ("b", 0, None, False, "p")], [("a", 2, "z", True, "p"), ("c", 0, "q", True, "p"), ("b", 1, "y", True, "p2"), ("a", 3, "w", True, "p2"), ("a", 4, None, False, "p2"), ("a", 5, "w", True, "p3")]
    out = None
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = flows.caught_up(flows.versions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/s")
    got = {(r["key"], r["place"]): (r["version"], r["change_type"]) for r in out.collect()}
    assert got == {("a", 0): (1, "new"), ("a", 1): (1, "unchanged"), ("a", 2): (2, "content_changed"), ("a", 3): (3, "extraction_changed"), ("a", 4): (3, "unchanged"), ("a", 5): (3, "unchanged"), ("b", 0): (1, "new"), ("b", 1): (2, "content_changed"), ("c", 0): (1, "new")}
    spark.createDataFrame([("u1", "2026-01-01 00:00:00"), ("u1", "2026-01-02 00:00:00"), ("u2", "2026-01-01 00:00:00")], "url string, ts string").selectExpr("url", "cast(ts as timestamp) ts").write.parquet(f"{tmp_path}/urls")
    unique = flows.unique_urls(spark.readStream.schema("url string, ts timestamp").parquet(f"{tmp_path}/urls"))
    assert sorted(r["url"] for r in flows.caught_up(unique, f"{tmp_path}/u").collect()) == ["u1", "u2"]
