"""The external CSV: fifteen fixed columns for the new and changed articles of a week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import dates, text

#: Names and order of the columns.
COLUMNS = [
    "record_id",
    "source_id",
    "publisher",
    "title",
    "url",
    "published_date",
    "updated_date",
    "fetched_at",
    "source_type",
    "content_hash",
    "category",
    "excerpt",
    "source_list_url",
    "hash_status",
    "hash_scope",
]


def padded(n):
    """At least three digits; longer numbers are not cut."""
    digits = n.cast("string")
    return F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)


def record_ids(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, record_id``: source, day (of first sight if no day is known) and a number by id over all articles."""
    joined = articles.join(sources.select("source_id", "csv_id"), "source_id", "left")
    day = F.coalesce(dates.published_day(F.col("published")), dates.jst_day(F.col("first_seen_at")))
    keyed = joined.select("id", text.csv_source_id(F.col("csv_id"), F.col("source_id")).alias("csv_id"), F.date_format(day, "yyyyMMdd").alias("day"))
    n = F.row_number().over(W.partitionBy("csv_id", "day").orderBy("id"))
    return keyed.select("id", F.concat_ws("_", "csv_id", "day", padded(n)).alias("record_id"))


def rows(articles: DataFrame, sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted articles (``id``; repeats and unknown ids are passed over), newest day first, then by id."""
    info = sources.select("source_id", "csv_id", "publisher", "list_url")
    got = articles.join(
        wanted.select("id").distinct(),
        "id",
        "left_semi",
    ).join(info, "source_id", "left").join(record_ids(articles, sources), "id", "left")
    day = dates.day_or_empty(F.col("published"))
    cells = [
        F.coalesce("record_id", "id"),
        text.csv_source_id(F.col("csv_id"), F.col("source_id")),
        F.coalesce("publisher", "source_name"),
        F.col("title"),
        F.col("url"),
        day,
        dates.day_or_empty(F.col("updated")),
        dates.jst_iso(F.col("last_seen_at")),
        F.col("csv.source_type"),
        F.coalesce("csv.hash", F.lit("")),
        text.category(F.col("tags")),
        text.excerpt(F.col("summary.status"), F.col("summary.text"), F.col("summary.key_points")),
        F.coalesce("list_url", F.lit("")),
        F.col("csv.hash_status"),
        F.coalesce("csv.hash_scope", F.lit("")),
    ]
    ordered = got.orderBy(F.when(day == "", "0").otherwise(day).desc(), "id")
    return ordered.select(*(c.alias(n) for c, n in zip(cells, COLUMNS)))


def lines(table: DataFrame) -> DataFrame:
    return table.select(text.csv_line(*(F.col(c) for c in COLUMNS)).alias("line"))


def file_name(generated_at):
    return F.concat(F.lit("external_news_"), dates.jst_stamp(generated_at), F.lit(".csv"))
