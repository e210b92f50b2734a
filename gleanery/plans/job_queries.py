"""Queries of whole jobs: a summarise run that is stopped and started again, publication of a set of tables, strict answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleanery.operators import layouts as LA
from gleanery.operators import summaries as SU
from gleanery.plans import summarise as SM
from gleanery.plans import validate as VA
from gleanery.plans.queries import PARTIAL_SQL, partial_value
from gleanery.plans.record_queries import PUBLIC_SQL, public_data
from gleanery.plans.registry import query, shared_folder
from gleanery.sources import commits

_GOOD = {"summary": "s", "key_points": ["p"], "targets": [], "dates": [], "ai_tags": [{"tag_id": "x", "reason": "r"}], "new_tag_suggestions": [], "uncertainties": []}
#: Answers by number: which rule each breaks.
_ANSWERS = [
    (json.dumps(_GOOD), None),
    (json.dumps({k: v for k, v in _GOOD.items() if k != "new_tag_suggestions"}), "fields are missing"),
    (json.dumps(_GOOD | {"new_tag_suggestions": [{"name": " ", "reason": "r"}]}), "a text is empty"),
    (json.dumps(_GOOD | {"mood": "calm"}), "the form is wrong"),
    (json.dumps(_GOOD | {"key_points": [1, 2]}), "the form is wrong"),
    ("Here it is: " + json.dumps(_GOOD), "fields are missing"),
    (json.dumps(_GOOD) + " I hope this helps", "fields are missing"),
    (json.dumps(_GOOD | {"ai_tags": [{"tag_id": "z", "reason": "r"}]}), "tag is not registered"),
]


@query(
    "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{p}'" for k, (_, p) in enumerate(_ANSWERS) if p)
    + " WHEN 8 THEN CASE WHEN length(text) > 300 THEN 'summary is too long' END END AS problem FROM documents"
)
def strict_answers(t):
    """Answers that a lenient reader would take: missing and unknown fields, wrong types, prose around the JSON; and summaries
    of any length."""
    k, long = F.col("doc_id") % 9, F.struct(*(F.col("text").alias(n) if n == "summary" else F.from_json(F.lit(json.dumps(v)), _kind(n)).alias(n) for n, v in _GOOD.items()))
    answer = F.to_json(long)
    for n, (a, _) in enumerate(_ANSWERS):
        answer = F.when(k == n, F.lit(a)).otherwise(answer)
    rows = t("documents").select(F.col("doc_id").alias("article_id"), answer.alias("answer"), "text")
    return SU.judged_answers(rows, ["x", "y"]).select(F.col("article_id").alias("doc_id"), "problem")


def _kind(name: str) -> str:
    return {"ai_tags": "array<struct<tag_id:string,reason:string>>", "new_tag_suggestions": "array<struct<name:string,reason:string>>", "dates": "array<struct<label:string,value:string,evidence:string>>"}.get(name, "array<string>")


class _Stopped(Exception):
    pass


class _Kinds:
    """A model that answers by the kind that a prompt begins with, and by the attempt; 50 tokens a call."""

    def __init__(self, attempt: int):
        self.attempt = attempt

    def complete(self, prompt: str) -> SU.Outcome:
        good, bad = SU.Outcome("ok", json.dumps(_GOOD), 50, 5), SU.Outcome("ok", "no", 50, 5)
        kinds = {"k0": good, "k1": bad, "k2": SU.Outcome("refusal", "", 50), "k3": good if self.attempt == 2 else bad, "k4": SU.Outcome("api_error"), "k5": SU.Outcome("retryable_error")}
        return kinds[prompt[:2]]


@query(
    """WITH RECURSIVE f AS (SELECT doc_id, doc_id % 6 AS k, CAST(ceil(least(length('k0 ' || text), 2000) / 4.0) AS BIGINT) AS tokens, row_number() OVER (ORDER BY doc_id DESC) AS n FROM documents),
c AS (SELECT *, CASE k WHEN 0 THEN 50 WHEN 1 THEN 150 WHEN 2 THEN 50 WHEN 3 THEN 150 ELSE 0 END AS cost FROM f), s AS (
  SELECT n, doc_id, k, tokens <= 7000 AS taken, CASE WHEN tokens <= 7000 THEN cost ELSE 0 END AS used FROM c WHERE n = 1
  UNION ALL SELECT c.n, c.doc_id, c.k, s.used + c.tokens <= 7000, s.used + CASE WHEN s.used + c.tokens <= 7000 THEN c.cost ELSE 0 END FROM s JOIN c ON c.n = s.n + 1 AND c.n <= 60)
SELECT f.doc_id, CASE WHEN NOT coalesce(taken, false) THEN 'failed_limit_exceeded' WHEN f.k IN (0, 3) THEN 'success' WHEN f.k = 1 THEN 'failed_invalid_output' WHEN f.k = 2 THEN 'failed_refusal' ELSE 'failed_api_error' END AS status,
  CASE WHEN taken THEN CASE f.k WHEN 0 THEN 50 WHEN 1 THEN 150 WHEN 2 THEN 50 WHEN 3 THEN 150 END END::VARCHAR AS tokens, CAST(CASE WHEN taken AND f.k IN (1, 3, 5) THEN 2 ELSE 0 END AS INTEGER) AS retries
FROM f LEFT JOIN s ON s.doc_id = f.doc_id"""
)
def summarise_run(t):
    """A run over all documents, stopped after its first calls and started again; the 60
    newest within a budget of tokens used, the others recorded as left out. The SQL walks the targets."""
    d = t("documents")
    spark, folder = d.sparkSession, shared_folder(d.sparkSession, "summaries")
    articles = d.select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.lit(1).alias("version"),
        F.md5("text").alias("content_hash"),
        F.lpad(F.col("doc_id").cast("string"), 18, "0").alias("first_seen_at"),
        F.concat(F.lit("k"), F.col("doc_id") % 6, F.lit(" "), "text").alias("text"),
    )
    run = SM.Run(1, "2026-05-01T00:00:00+09:00", "m", "p", "t", ["x", "y"], SM.Limits(articles=60, chars=2000, tokens=7000), {"m": (3.0, 15.0)})

    def stop(step: str) -> None:
        if step == "calls/0.0":
            raise _Stopped(step)

    for after in (stop, lambda step: None):
        try:
            SM.summarise(articles, run, f"{folder}/set", f"{folder}/run", _Kinds, lambda estimate: 50, after, lambda seconds: None)
        except _Stopped:
            continue
    records = commits.snapshot(spark, f"{folder}/set").table("records")
    return records.select(F.col("article_id").cast("long").alias("doc_id"), F.col("analysis_status").alias("status"), F.col("input_tokens").cast("string").alias("tokens"), "retries")


@query(
    f"""WITH p AS ({PUBLIC_SQL}) SELECT 'articles' AS tab, id AS key, CAST(latest_version AS BIGINT) AS n FROM p UNION ALL SELECT 'status', source_id, count(*) FROM p GROUP BY source_id
UNION ALL SELECT 'reports', substr(first_seen_at, 1, 10), count(*) FROM p GROUP BY substr(first_seen_at, 1, 10) UNION ALL SELECT 'meta', n_name, n_nationkey FROM nation"""
)
def published_set(t):
    """K1, Q1, V5: four tables published at one instant. A writer that started from an older version and a set whose tables do
    not agree are refused, and readers still see the four tables of one version."""
    spark = t("nation").sparkSession
    folder, a = shared_folder(spark, "site"), public_data(t)
    day = F.substring("first_seen_at", 1, 10)
    tables = {
        "articles": a.select("id", "title", "source_id", "latest_version"),
        "status": a.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")),
        "reports": a.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")),
        "meta": t("nation").select("n_name", "n_nationkey"),
    }

    def problems(s):
        """Secrets in articles; counts of sources and days that are not those of the articles."""
        counted = s["articles"].agg(F.count(F.lit(1)).alias("n"))
        sums = [s[name].agg(F.sum("n").alias("n")).select(F.lit(name).alias("check"), "n") for name in ("status", "reports")]
        wrong = sums[0].unionByName(sums[1]).join(counted.withColumnRenamed("n", "articles"), F.col("n") != F.col("articles"))
        return wrong.select("check", F.col("n").cast("string").alias("key")).unionByName(VA.public(s["articles"]).selectExpr("'secret' AS check", "'' AS key"))

    start = commits.snapshot(spark, folder)
    commits.publish(spark, folder, tables, problems)
    attempts = ((commits.Conflict, tables, start), (commits.Refused, tables | {"articles": tables["articles"].where("latest_version = 3")}, None))
    for expected, offered, base in attempts:
        try:
            commits.publish(spark, folder, offered, problems, base)
        except expected:
            continue
        raise AssertionError(f"published in spite of {expected}")
    s = commits.snapshot(spark, folder)
    told = [("articles", "id", "latest_version"), ("status", "source_id", "n"), ("reports", "day", "n"), ("meta", "n_name", "n_nationkey")]
    parts = [s.table(name).select(F.lit(name).alias("tab"), F.col(key).alias("key"), F.col(n).cast("long").alias("n")) for name, key, n in told]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---------------------------------------------------------------- stored orders


@query(
    f"""WITH v AS (SELECT o_orderkey, {PARTIAL_SQL} AS v FROM orders), r AS (
  SELECT o_orderkey, CASE length(v) WHEN 4 THEN v || '-01-01' WHEN 7 THEN v || '-01' ELSE substr(v, 1, 10) END AS lo,
    CASE length(v) WHEN 4 THEN v || '-12-31' WHEN 7 THEN CAST(last_day(CAST(v || '-01' AS DATE)) AS VARCHAR) ELSE substr(v, 1, 10) END AS hi FROM v)
SELECT o_orderkey, (SELECT count(*) FROM v WHERE v IS NULL) AS undated FROM r WHERE hi >= '1995-11-28' AND lo <= '1996-01-03'"""
)
def period_layout_search(t):
    """a period over articles stored by first day: blocks that end before it or begin after it are not read."""
    a = t("orders").select("o_orderkey", partial_value(F.col("o_orderkey"), F.to_date("o_orderdate")).alias("published"))
    spark, folder = a.sparkSession, shared_folder(a.sparkSession, "by-day")
    LA.write_by_day(a, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    unknown = LA.undated(spark, folder).select(F.col("n").alias("undated"))
    return LA.in_period(spark, folder, "1995-11-28", "1996-01-03").select("o_orderkey").crossJoin(F.broadcast(unknown))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET (SELECT 50 * CAST(floor((count(*) - 1) / 100) AS BIGINT) FROM events)")
def page_of_stored_order(t):
    """The page in the middle of all events, newest first, from the ranges of a stored order that it lies in."""
    e = t("events").select("ts", "event_id", "user_id", "event_type")
    spark = e.sparkSession
    stored = LA.write_pages(e, [F.col("ts").desc(), F.col("event_id")], shared_folder(spark, "pages"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored.page(50, (stored.total - 1) // 100 + 1).drop("ts")
