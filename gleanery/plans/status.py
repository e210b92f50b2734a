"""Collection status: sources with their state, counts, warnings in a fixed order, and what is still to be retried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import dates, text


def overall(articles: DataFrame) -> DataFrame:
    """Counts over all articles in one pass."""
    return articles.agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(F.col("published").isNull()).alias("date_unknown"),
        F.count_if(F.col("content_status") != "ok").alias("content_missing"),
        F.count_if(F.col("summary.status") != "success").alias("unsummarized"),
        F.count_if(F.col("summary.outdated")).alias("summary_outdated"),
    )


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run, and when the last run without any failure ended."""
    whole = runs.where("status = 'success'")
    last = runs.agg(
        F.max_by("status", "started_at").alias("last_run_status"),
        F.max_by(F.coalesce("finished_at", "started_at"), "started_at").alias("last_run_at"),
    )
    return last.crossJoin(whole.agg(F.max_by("finished_at", "started_at").alias("last_full_success_at")))


def sources(config: DataFrame, state: DataFrame, last_results: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per configured source: its state, its result in the last run, its articles; zeros where there is none."""
    n = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("published").isNull()).alias("date_unknown"))
    results = last_results.select("source_id", F.struct(*[c for c in last_results.columns if c != "source_id"]).alias("last_run"))
    joined = config.join(state, "source_id", "left").join(results, "source_id", "left").join(n, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kept = [c for c in joined.columns if c not in ("articles", "date_unknown", "consecutive_failures")]
    return joined.select(
        *kept,
        zero("articles"),
        zero("date_unknown"),
        zero("consecutive_failures"),
        F.when(F.size("retry_queue") > 0, F.size("retry_queue")).otherwise(0).alias("retry_count"),
    )


def attachment_settings(config: DataFrame) -> DataFrame:
    """Settings for attached PDFs with their defaults; null for sources without."""
    a = F.col("attachments")
    filled = F.struct(
        F.coalesce(a["max_files"], F.lit(3)).alias("max_files"),
        F.coalesce(a["max_bytes"], F.lit(10 << 20)).alias("max_bytes"),
        F.coalesce(a["max_pages"], F.lit(30)).alias("max_pages"),
        F.coalesce(a["exclude_titles"], F.array().cast("array<string>")).alias("exclude_titles"),
    )
    return config.withColumn("attachments", F.when(F.coalesce(a["pdf"], F.lit(False)), filled))


def warnings(rows: DataFrame, now: Column, limit: int) -> DataFrame:
    """``source_id, place, warning`` for enabled sources, in a fixed order within each.

    Never succeeded, failures in a row or a stale success exclude each other; items to retry and warnings of the last
    run follow. Fixed values: the wording."""
    since = dates.days_since(F.col("last_success_at").cast("timestamp"), now)
    first = (
        F.when(F.col("last_success_at").isNull(), F.concat("name", F.lit("：一度も取得に成功していません。")))
        .when(F.col("consecutive_failures") > 0, F.concat("name", F.lit("：直近"), F.col("consecutive_failures"), F.lit("回続けて取得に失敗しています。")))
        .when(since > limit, F.concat("name", F.lit("：最後の取得成功から"), since, F.lit("日経っています。")))
    )
    kinds = F.array_join(F.array_distinct(F.transform("retry_queue", lambda r: text.retry_kind(r["reason"]))), "／")
    again = F.when(F.size("retry_queue") > 0, F.concat("name", F.lit("："), F.size("retry_queue"), F.lit("件の記事で取得が完了していません（"), kinds, F.lit("）。")))
    told = F.transform(F.coalesce("last_warnings", F.array().cast("array<string>")), lambda w: F.concat(F.col("name"), F.lit("："), w))
    return rows.where("enabled").select("source_id", F.posexplode(F.array_compact(F.concat(F.array(first, again), told))).alias("place", "warning"))


def stale_run(last_run_at: Column, now: Column, limit: int) -> Column:
    """The warning about the whole collection, or null."""
    since = dates.days_since(last_run_at, now)
    return F.when(last_run_at.isNull(), "まだ収集を実行していません。").when(since > limit, F.concat(F.lit("データが古くなっています：最後の収集から"), since, F.lit("日経っています。")))


def retries(state: DataFrame, articles: DataFrame) -> DataFrame:
    """Unfinished items of all sources with titles where the article is known."""
    items = state.select("source_id", F.explode("retry_queue").alias("r")).select("source_id", "r.*")
    return items.join(
        articles.select(F.col("id").alias("article_id"), "title"),
        "article_id",
        "left",
    ).withColumn("kind", text.retry_kind(F.col("reason")))


def catalogue(config: DataFrame) -> DataFrame:
    """How many sources are in use and how many are candidates."""
    return config.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("candidates"))


def run_list(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc())
