"""Fictional records for demonstrations, from rules: the same at every call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import article_id

#: How many articles, sources and runs.
ARTICLES, SOURCES, RUNS = 20, 4, 4


def sources(spark: SparkSession) -> DataFrame:
    return spark.range(SOURCES).select(
        F.concat(F.lit("demo-"), "id").alias("source_id"),
        F.concat(F.lit("Fictional office "), "id").alias("name"),
        (F.col("id") < SOURCES - 1).alias("enabled"),
    )


def articles(spark: SparkSession) -> DataFrame:
    """Rows of article files: every precision of dates, one to three versions."""
    n, none = F.col("n"), F.lit(None).cast("string")
    basis = "struct<method:string,evidence:string>"
    two = F.lpad(n.cast("string"), 2, "0")
    published = F.when(n % 4 == 1, "2026").when(n % 4 == 2, "2026-08").when(n % 4 == 3, F.concat(F.lit("2026-09-"), two))
    base = spark.range(1, ARTICLES + 1).select(F.col("id").alias("n")).withColumn(
        "url",
        F.concat(F.lit("https://demo.example.org/"), two),
    ).withColumn("id", article_id(F.col("url")))
    latest = (1 + n % 3).cast("int")
    kinds = F.struct(
        F.when(published.isNotNull(), F.struct(F.lit("html_text").alias("method"), published.alias("evidence"))).alias("published"),
        F.lit(None).cast(basis).alias("updated"),
    )
    exact = F.when(n % 4 == 0, "unknown").when(n % 4 == 1, "year").when(n % 4 == 2, "month").otherwise("day")
    seen = F.concat(F.lit("2026-09-"), two, F.lit("T08:00:00+09:00"))
    version = lambda k: F.struct(
        F.col("id").alias("article_id"),
        k.cast("int").alias("version"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat("url", k), 256)).alias("content_hash"),
        seen.alias("fetched_at"),
        F.lit("html").alias("content_type"),
        F.lit(100).alias("text_length"),
        F.lit("ok").alias("extraction_status"),
        none.alias("extraction_error"),
        F.when(k == 1, "new").otherwise("content_changed").alias("change_type"),
    )
    article = F.struct(
        F.col("id").alias("article_id"),
        F.concat(F.lit("demo-"), n % SOURCES).alias("source_id"),
        F.col("url").alias("canonical_url"),
        F.concat(F.lit("d"), two).alias("title"),
        published.alias("published_at"),
        none.alias("updated_at"),
        kinds.alias("date_basis"),
        F.struct(exact.alias("published"), F.lit("unknown").alias("updated")).alias("date_precision"),
        seen.alias("first_seen_at"),
        seen.alias("last_seen_at"),
        latest.alias("latest_version"),
        F.lit("active").alias("status"),
    )
    return base.select(
        F.lit(1).alias("schema_version"),
        article.alias("article"),
        F.transform(F.sequence(F.lit(1), latest), version).alias("versions"),
    )


def runs(spark: SparkSession) -> DataFrame:
    """Run records, one a week, newest last; the third one failed in part."""
    day = F.concat(F.lit("2026-09-"), F.lpad((F.col("id") * 7 + 1).cast("string"), 2, "0"))
    return spark.range(RUNS).select(
        F.concat(F.lit("run_"), day).alias("run_id"),
        F.concat(day, F.lit("T08:00:00+09:00")).alias("started_at"),
        F.concat(day, F.lit("T08:05:00+09:00")).alias("finished_at"),
        F.when(F.col("id") == 2, "partial").otherwise("success").alias("status"),
        F.lit("collect").alias("kind"),
    )
