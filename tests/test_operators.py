import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import rules as R
from gleanery.operators import search as Q
from gleanery.operators import state as S
from gleanery.operators import summaries as SU
from gleanery.operators import tags as G
from gleanery.operators import versions as V

ARTICLE = (
    "id string, source_id string, source_name string, title string, published string, first_seen_at string, "
    "tags array<struct<id:string,name:string,origin:string,reason:string,retired:boolean>>, summary struct<status:string,text:string,key_points:array<string>,targets:array<string>,outdated:boolean>"
)


def article(id_, source="s1", title="", published=None, tags=(), text=None, points=None, seen="2026-01-01T00:00:00+09:00"):
    return (id_, source, source.upper(), title, published, seen, [(t, t.title(), "ai", None, False) for t in tags], ("success" if text else "not_processed", text, points, None, False))


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        article("a1", title="ＡＢＣ 通知", published="2026-09-01", tags=["x"], text="要約", points=["Point One"]),
        article("a2", "s2", "second", "2026-09", ["x", "y"]),
        article("a3", "s2", "third", None, ["y"]),
        article("a4", "s1", "fourth", "2026-09-21T16:00:00+00:00"),
        article("a5", "s1", "fifth", "2025"),
    ]
    return spark.createDataFrame(rows, ARTICLE).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search(articles):
    got = lambda **k: sorted(ids(Q.search(articles, Q.Filters(**k))))
    assert got() == ["a1", "a2", "a3", "a4", "a5"]
    assert got(q="abc　POINT") == ["a1"] and got(q="S2") == ["a2", "a3"] and got(q="nothing") == []
    assert got(tag="y") == ["a2", "a3"] and got(tag="x", source="s1") == ["a1"]
    assert got(start="2026-09-10", end="2026-09-21") == ["a2", "a4"] and got(end="2025-12-31") == ["a5"]
    assert Q.undated_excluded(articles, Q.Filters(start="2026-01-01", tag="y")).first()["n"] == 1
    assert Q.undated_excluded(articles, Q.Filters(tag="y")).first()["n"] == 0
    assert ids(Q.newest_first(articles)) == ["a4", "a1", "a2", "a5", "a3"]
    assert ids(Q.page_of(Q.newest_first(articles), 2, 9)) == ["a3"] and ids(Q.page_of(Q.newest_first(articles), 2, 2)) == ["a2", "a5"]
    assert sorted(ids(Q.latest(articles, F.lit("2026-09-22").cast("date"), 2))) == ["a4"]
    assert Q.undated(articles).first()["n"] == 3
    tags = articles.sparkSession.createDataFrame([("x",), ("y",), ("z",), ("w",)], "id string")
    assert sorted(ids(Q.used_tags(articles, tags, "z"))) == ["x", "y", "z"]
    shown = {r["id"]: (r["date"], r["tags"]) for r in Q.list_rows(articles).collect()}
    assert shown["a2"] == ("2026年9月（日不明）", "X、Y") and shown["a4"][1] == "AI未処理"


def test_requests():
    f = Q.Filters.parse("?q=a+b&tag=t&from=2026-01-01&to=bad&page=3")
    assert f == Q.Filters("a b", "t", "", "2026-01-01", "", 3) and Q.Filters.parse(f.query()) == f
    assert Q.Filters.parse("page=0").page == 1 and Q.Filters.parse("page=999999999").page == 100_000 and len(Q.Filters.parse("q=" + "x" * 300).q) == 200
    assert Q.page_bounds(0, 50, 3) == (1, 1, 0, 0) and Q.page_bounds(101, 50, 9) == (3, 3, 100, 101)
    assert Q.page_links(10, 5) == [1, None, 3, 4, 5, 6, 7, None, 10] and Q.page_links(1, 1) == [1]
    assert Q.route("#/wiki/x") == ("tag", "x") and Q.route("#/search?q=a") == ("search", "q=a") and Q.route("?q=a") == ("search", "q=a") and Q.route("") == ("latest", "")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tags(spark):
    three = "article_id string, tag_id string, pos int, reason string"
    ai = frame(spark, [("a", "x", 0, "r1"), ("a", "y", 1, "r2"), ("b", "q", 0, "r")], three)
    fixed = G.fixed_tags(frame(spark, [("a", "s"), ("c", "s")], "article_id string, source_id string"), frame(spark, [("s", "S", ["y", "v"])], "source_id string, name string, fixed_tags array<string>"))
    rule = G.rule_reasons(frame(spark, [("a", "v", "L1", "title", 0), ("a", "v", "L2", "body", 1), ("c", "m", "L3", "body", 2)], "article_id string, tag_id string, label string, `in` string, pos int"))
    added = frame(spark, [("a", "x", 0), ("a", "new", 1), ("a", "gone", 2)], "article_id string, tag_id string, pos int")
    removed = frame(spark, [("a", "gone"), ("a", "y"), ("b", "q")], "article_id string, tag_id string")
    defs = frame(spark, [("x", "Ex", True), ("v", "Vee", False)], "tag_id string, name string, enabled boolean")
    got = {r["article_id"]: [(t["id"], t["name"], t["origin"], t["retired"]) for t in r["tags"]] for r in G.as_arrays(G.named(G.final_tags(ai, fixed, rule, added, removed), defs)).collect()}
    assert got == {"a": [("x", "Ex", "ai", False), ("v", "Vee", "source", True), ("new", "new", "human", True)], "c": [("y", "y", "source", True), ("v", "Vee", "source", True), ("m", "m", "rule", True)]}
    assert sorted(tuple(r) for r in G.removed_tags(ai, fixed, rule, removed).select("article_id", "tag_id").collect()) == [("a", "y"), ("b", "q")]
    assert {r["tag_id"]: r["reason"] for r in rule.where("article_id = 'a'").collect()} == {"v": "ルール（キーワード一致）：「L1」（題名）「L2」（本文）が見つかりました"}
    assert [r["tag_id"] for r in G.selectable(frame(spark, [("x", True, None), ("y", True, True), ("z", False, None)], "tag_id string, enabled boolean, rule_only boolean")).collect()] == ["x"]
    assert [(r["pos"], r["duplicates"]) for r in G.keep_first(ai.where("article_id = 'a'"), ["article_id"], ["pos"]).collect()] == [(0, 1)]


def test_rules(spark):
    rules = R.load_rules([{"id": "v", "enabled": True, "auto_rules": [{"label": "M", "pattern": "母子モ(?!デル)"}, {"label": "C", "pattern": "CMIC\\s?Trust"}]}, {"id": "off", "enabled": False, "auto_rules": [{"label": "x", "pattern": "x"}]}])
    assert len(rules) == 2 and R.rules_version(rules).startswith("sha256:") and R.rule_frame(spark, rules).count() == 2
    docs = frame(spark, [("a", "母子モデル", "cmic trust と 母子モ"), ("b", "CMICTrust", None), ("c", "母子モデル", "")], "article_id string, title string, body string")
    got = sorted((r["article_id"], r["label"], r["matched"], r["in"]) for r in R.matches(docs, rules).collect())
    assert got == [("a", "C", "cmic trust", "body"), ("a", "M", "母子モ", "body"), ("b", "C", "CMICTrust", "title")]
    assert R.matches(docs, []).count() == 0
    latest = frame(spark, [("a", 1, True, "ok"), ("b", 1, False, "ok"), ("c", 1, False, "ok"), ("d", 2, True, "ok"), ("e", 1, True, "ok"), ("f", 1, False, "unsupported")], "article_id string, version int, has_text boolean, extraction_status string")
    old = frame(spark, [("a", 1, "body", "now"), ("b", 1, "body", "before"), ("c", 1, "title", "before"), ("d", 1, "body", "now"), ("e", 1, "title", "now")], "article_id string, article_version int, scope string, rules_version string")
    got = R.freshness(latest, old, "now")
    assert {r["article_id"]: (r["action"], r["scope"]) for r in got.collect()} == {"a": ("unchanged", "body"), "b": ("stale", "body"), "c": ("updated", "title"), "d": ("updated", "body"), "e": ("updated", "body"), "f": ("updated", "title")}
    assert tuple(R.counters(got).first()) == (4, 1, 1, 1)  # f was never read


def test_versions(spark):
    h = frame(spark, [("a", 1, "h1", "ok", "p1"), ("a", 2, "h1", "ok", "p1"), ("a", 3, "h1", "ok", "p2"), ("a", 4, None, "failed", "p2"), ("a", 5, "h1", "ok", "p2"), ("a", 6, "h2", "ok", "p2"), ("a", 7, "h3", "ok", "p2"), ("c", 1, None, "failed", "p1"), ("c", 2, None, "failed", "p1"), ("c", 3, "h", "ok", "p2"), ("b", 1, "h", "ok", "p"), ("b", 3, "h2", "ok", "p")], "article_id string, version int, content_hash string, extraction_status string, extraction_profile string")
    got = V.change_types(h, profile="extraction_profile").where("article_id = 'a'").orderBy("version")
    assert [r["change_type"] for r in got.collect()] == ["new", "unchanged", "unchanged", "unchanged", "unchanged", "extraction_changed", "content_changed"]
    got = V.change_types(h, profile="extraction_profile").where("article_id = 'c'").orderBy("version")
    assert [r["change_type"] for r in got.collect()] == ["new", "unchanged", "content_changed"]
    assert [r["article_id"] for r in V.gaps(h, "article_id", "version").collect()] == ["b"]
    n = V.numbered(frame(spark, [("a", "t2"), ("a", "t1")], "article_id string, fetched_at string"))
    assert sorted(tuple(r) for r in n.collect()) == [("a", "t1", 1, 2), ("a", "t2", 2, 2)]
    records = V.version_records(frame(spark, [("a", 1, "ok", "h", "t", "html", "body", None, "new"), ("b", 1, "failed", "h", "t", None, None, "HTTP 500", "new")], "article_id string, version int, status string, content_hash string, fetched_at string, content_type string, text string, error string, change_type string"))
    assert sorted(tuple(r) for r in records.collect()) == [("a", 1, "h", "t", "html", 4, "ok", None, "new"), ("b", 1, None, "t", "none", None, "failed", "HTTP 500", "new")]


def test_merge_has_every_decision(spark):
    old = frame(spark, [(k, 2, "h", s, "p", None, "2025", "f") for k, s in (("same", "ok"), ("changed", "ok"), ("profile", "ok"), ("method", "ok"), ("recovered", "failed"), ("down", "ok"), ("late", "ok"), ("closed", "ok"), ("image", "ok"), ("parts", "ok"))], "article_id string, latest_version int, content_hash string, extraction_status string, extraction_profile string, published_at string, updated_at string, first_seen_at string")
    new = [("same", True, None, "ok", "h", "p"), ("changed", True, None, "ok", "h2", "p"), ("profile", True, None, "ok", "h", "p2"), ("method", True, None, "ok", "h2", "p2"), ("recovered", True, None, "ok", "h3", "p2"), ("closed", True, True, None, None, "p"), ("image", True, None, "unsupported", None, "p"), ("parts", True, None, "ok", "h2", "p"), ("scan", True, None, "unsupported", None, "p"), ("down", True, None, "failed", None, "p"), ("late", False, None, "ok", "h", "p"), ("fresh", None, None, "ok", "h", "p"), ("broken", True, None, "failed", None, "p"), ("out", False, None, "ok", "h", "p"), ("login", True, True, None, None, "p")]
    c = frame(spark, [(*r, "2026-09-01", "2026", "now", r[0] == "parts") for r in new], "article_id string, judged boolean, login boolean, status string, content_hash string, extraction_profile string, published_at string, updated_at string, fetched_at string, attachments_failed boolean")
    got = {r["article_id"]: (r["decision"], r["latest_version"]) for r in V.merge(old, c).collect()}
    assert got == {"same": ("unchanged", 2), "changed": ("content_changed", 3), "profile": ("unchanged", 2), "method": ("extraction_changed", 3), "closed": ("unchanged", 2), "image": ("unchanged", 2), "parts": ("unchanged_failed", 2), "scan": ("new_unread", 1), "recovered": ("content_changed", 3), "down": ("unchanged_failed", 2), "late": ("unchanged", 2), "fresh": ("new", 1), "broken": ("new_failed", 1), "out": ("out_of_period", None), "login": ("login_only", 1)}
    assert {d for d, _ in got.values()} == set(V.DECISIONS)
    down = next(r for r in V.merge(old, c).collect() if r["article_id"] == "down")
    assert (down["published_at"], down["updated_at"], down["last_seen_at"]) == (None, "2025", "now")
    row = next(r for r in V.merge(old, c).collect() if r["article_id"] == "same")
    assert (row["published_at"], row["updated_at"], row["first_seen_at"], row["last_seen_at"]) == ("2026-09-01", "2026", "f", "now")


def test_attachments(spark):
    a = frame(spark, [("a", 1, "one", "ok", "t1"), ("a", 2, "skip me", "ok", "t2"), ("a", 3, "three", "failed", None), ("a", 4, "four", "ok", "t4")], "article_id string, position int, title string, status string, text string")
    assert {r["position"]: r["state"] for r in V.capped_attachments(a, ["^skip"], 2).collect()} == {1: "read", 2: "excluded", 3: "read", 4: "skipped"}
    got = V.with_attachments(frame(spark, [("a", "body"), ("b", "only")], "article_id string, text string"), a)
    assert {r["article_id"]: r["text"] for r in got.collect()} == {"a": "body\n[添付PDF]one\nt1\n[添付PDF]skip me\nt2\n[添付PDF]four\nt4", "b": "only"}
    t = spark.range(1).select(V.chosen_title(F.lit("pdf"), F.lit(" "), F.lit("page"), F.lit("u")), V.chosen_title(F.lit("html"), F.lit("cand"), F.lit(None).cast("string"), F.lit("u")), V.chosen_title(F.lit("html"), F.lit("c"), F.lit("x" * 400), F.lit("u"))).first()
    assert t[0] == "page" and t[1] == "cand" and len(t[2]) == 300
    profile = lambda kind, pdf, titles: spark.range(1).select(V.extraction_profile(F.lit(kind), F.lit(pdf), F.array(*map(F.lit, titles)).cast("array<string>"))).first()[0]
    assert [profile("html", False, []), profile("pdf", True, []), profile("html", True, ["a", "b"]), profile("html", True, [])] == ["html", "pdf", "html+pdf(3files,30pages,exclude:a|b)", "html+pdf(3files,30pages)"]


def test_state(spark):
    e = frame(spark, [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, True), ("c", 1, False)], "k string, t int, bad boolean")
    assert {r["k"]: r["consecutive_failures"] for r in S.consecutive_failures(e, "k", ["t"], "bad").collect()} == {"a": 2, "b": 1, "c": 0}
    r = frame(spark, [("r1", "s1", "failed", 0), ("r1", "s2", "failed", 0), ("r2", "s1", "success", 1), ("r3", "s1", "success", 0)], "run_id string, source_id string, status string, fetch_failed int")
    runs = frame(spark, [("r1",), ("r2",), ("r3",), ("r4",)], "run_id string")
    assert {x["run_id"]: x["status"] for x in S.run_status(r, runs).collect()} == {"r1": "failed", "r2": "partial", "r3": "success", "r4": "success"}
    h = frame(spark, [("s", 1, 10), ("s", 2, 4), ("s", 3, 1), ("q", 1, 3), ("q", 2, 0)], "s string, t int, n int")
    assert [(x["s"], x["t"]) for x in S.drops(h, "s", "t", "n").orderBy("t").collect()] == [("s", 2), ("s", 3)]
    sources = frame(spark, [("a", True), ("b", True), ("c", False), ("d", True)], "source_id string, enabled boolean")
    state = frame(spark, [("a", "t0", "t0", "success", 0), ("b", "t0", "t1", "failed", 2)], "source_id string, last_success_at string, last_attempt_at string, last_attempt_status string, consecutive_failures int")
    results = frame(spark, [("a", "failed", "t2"), ("b", "success", "t2")], "source_id string, status string, attempted_at string")
    got = {x["source_id"]: tuple(x)[1:] for x in S.merged_state(sources, state, results).collect()}
    assert got == {"a": ("t0", "t2", "failed", 1), "b": ("t2", "t2", "success", 0), "c": (None, None, None, 0), "d": (None, None, None, 0)}
    assert sorted(x["source_id"] for x in S.chosen_sources(sources).collect()) == ["a", "b", "d"] and S.chosen_sources(sources, ["c"]).count() == 1
    with pytest.raises(ValueError):
        S.chosen_sources(sources, ["nope"])


def test_retries_and_candidates(spark):
    old = frame(spark, [("s", "u1", "fetch", "r", "t0", 1), ("s", "u2", "fetch", "r", "t0", 3)], "source_id string, url string, stage string, reason string, first_failed_at string, attempts int")
    done = frame(spark, [("s", "u2")], "source_id string, url string")
    failed = frame(spark, [("s", "u1", "fetch", "again", "t9"), ("s", "u3", "fetch", "new", "t9")], "source_id string, url string, stage string, reason string, failed_at string")
    assert sorted(tuple(r) for r in S.retry_queue(old, done, failed).collect()) == [("s", "u1", "fetch", "again", "t0", 2), ("s", "u3", "fetch", "new", "t9", 1)]
    c = frame(spark, [("s", "u1", False), ("s", "u4", False), ("s", "u5", None), ("s", "u6", True)], "source_id string, url string, judged boolean")
    assert sorted(r["url"] for r in S.worth_fetching(c, old).collect()) == ["u1", "u5", "u6"]
    assert sorted(r["url"] for r in S.with_retries(c, old).collect()) == ["u1", "u2", "u4", "u5", "u6"]


def test_summaries(spark):
    rows = [("a", 1, "success", "t1", "k"), ("a", 2, "failed", "t0", "k"), ("a", 2, "failed", "t2", "k"), ("b", 1, "success", "t1", "old")]
    s = frame(spark, rows, "article_id string, article_version int, analysis_status string, processed_at string, prompt string")
    assert {r["article_id"]: (r["article_version"], r["processed_at"]) for r in SU.latest_summary(s).collect()} == {"a": (2, "t2"), "b": (1, "t1")}
    files = s.groupBy("article_id").agg(F.collect_list(F.struct(*s.columns)).alias("summaries"))
    assert SU.last_for_version(files).count() == 3
    latest = frame(spark, [("a", 2, "ok", "1", "k"), ("b", 1, "ok", "2", "k"), ("c", 1, "ok", "3", "k"), ("d", 1, "failed", "4", "k"), ("e", 1, "ok", "5", "k")], "article_id string, version int, extraction_status string, first_seen_at string, prompt string")
    done = SU.last_for_version(files).unionByName(frame(spark, [("e", 1, "success", "t", "k")], s.schema.simpleString().removeprefix("struct<").removesuffix(">")))
    assert [r["article_id"] for r in SU.needs_processing(latest, done, ["prompt"]).collect()] == ["c", "b", "a"]
    twice = frame(spark, [("x", 1, "failed", 0, "k"), ("x", 1, "success", 1, "k"), ("y", 1, "success", 0, "k"), ("y", 1, "failed", 1, "k"), ("z", 1, "failed", 0, "k"), ("z", 1, "failed", 1, "k")], "article_id string, article_version int, analysis_status string, pos int, prompt string")
    rows = frame(spark, [(k, 1, "ok", k, "k") for k in "xyz"], "article_id string, version int, extraction_status string, first_seen_at string, prompt string")
    assert [r["article_id"] for r in SU.needs_processing(rows, twice, ["prompt"]).collect()] == ["z", "y"]
    items = [("a", True, 50), ("b", False, 1), ("c", True, 60), ("d", True, 40), ("e", True, 1)]
    df = frame(spark, [(n, *i) for n, i in enumerate(items)], "n int, k string, has boolean, tokens int")
    assert [r["k"] for r in SU.within_budget(df, [F.col("n")], 4, "tokens", 100, F.col("has")).orderBy("n").collect()] == SU.exact_budget(items, 4, 100)
    assert SU.within_budget(df.limit(0), [F.col("n")], 4, "tokens", 100).count() == 0
    assert SU.exact_budget([("a", True, 50), ("b", False, 1), ("c", True, 60), ("d", True, 40), ("e", True, 1)], 4, 100) == ["a", "d"]
    assert spark.range(1).select(SU.cost(F.lit(1_000_000), F.lit(500_000), F.lit(3.0), F.lit(15.0))).first()[0] == 10.5
    known = frame(spark, [("n1",)], "name string")
    found = frame(spark, [("n1", "a", "t1"), ("n2", "b", "t3"), ("n2", "c", "t2")], "name string, article_id string, first_seen_at string")
    assert [tuple(r) for r in SU.new_tag_names(found, known).collect()] == [("n2", "c", "t2")]


def answer(**k):
    return json.dumps({"summary": "s", "key_points": [], "targets": [], "dates": [], "ai_tags": [], "new_tag_suggestions": [], "uncertainties": []} | k)


def test_answers_and_retries(spark):
    cases = {
        "ok": (answer(ai_tags=[{"tag_id": "x", "reason": "r"}], dates=[{"label": "l", "value": "2026-09", "evidence": "9月1日"}]), None),
        "json": ("no", "fields are missing"),
        "long": (answer(summary="s" * 301), "summary is too long"),
        "points": (answer(key_points=["p"] * 6), "too many points"),
        "tag": (answer(ai_tags=[{"tag_id": "z", "reason": "r"}]), "tag is not registered"),
        "twice": (answer(ai_tags=[{"tag_id": "x", "reason": "r"}] * 2), None),
        "evidence": (answer(dates=[{"label": "l", "value": "2026", "evidence": "9月2日"}, {"label": "m", "value": "2026-09-01", "evidence": " ９月 1日"}]), None),
        "value": (answer(dates=[{"label": "l", "value": "v", "evidence": "9月1日"}]), "a date is malformed"),
        "blank": (answer(key_points=[" "]), "a text is empty"),
    }
    df = frame(spark, [(k, a, "本日は9月1日です") for k, (a, _) in cases.items()], "article_id string, answer string, text string")
    assert {r["article_id"]: r["problem"] for r in SU.judged_answers(df, ["x"]).collect()} == {k: p for k, (_, p) in cases.items()}
    got = {r["article_id"]: r for r in SU.judged_answers(df, ["x"]).collect()}
    assert [x["tag_id"] for x in got["twice"]["tags"]] == ["x"] and got["long"]["tags"] is None
    assert [d["label"] for d in got["evidence"]["dates"]] == ["m"] and got["evidence"]["notes"] == ["根拠を原文で確認できない日付（l：2026）は採用しませんでした"]
    slept = []
    run = lambda *o: SU.with_retries(SU.MockProvider({"p": list(o)}), "p", lambda t: None if t == "fine" else "bad", 2, slept.append)
    O = SU.Outcome  # noqa: E741
    assert run(O("ok", "fine"))[1] == 0
    assert run(O("retryable_error"), O("ok", "fine")) == (O("ok", "fine"), 1) and slept == [1.0]
    assert run(O("refusal"), O("ok", "fine")) == (O("refusal"), 0) and run(O("api_error"), O("ok", "fine"))[0].kind == "api_error"
    assert run(O("truncated"), O("truncated"), O("ok", "fine"))[1] == 2
    assert run(O("ok", "bad"))[0].kind == "invalid" and SU.backoff(9) == 30
    got = SU.completed(frame(spark, [("a", "prompt")], "article_id string, prompt string"), SU.MockProvider).first()
    assert got["kind"] == "ok" and got["retries"] == 0
