"""Topic pages: how many articles each tag has, and a tag's articles by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Every defined tag with its number of articles and the largest published value; tags without any are kept."""
    per = articles.select(
        "published",
        F.explode(F.array_distinct("tags.id")).alias("tag_id"),
    ).groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("latest"))
    return tags.join(per, "tag_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def groups(articles: DataFrame, tag: str) -> DataFrame:
    """Articles of a tag by month (by year if no month is known), newest first; unknown dates last, by first sight.

    ``place`` orders groups, ``pos`` the articles in one."""
    own = articles.where(F.exists("tags", lambda t: t["id"] == tag))
    key = F.when(F.length("published") >= 7, F.substring("published", 1, 7)).otherwise(F.substring("published", 1, 4))
    order = F.struct(
        F.coalesce("published", F.lit("")).alias("p"),
        F.when(F.col("published").isNull(), F.col("first_seen_at")).alias("s"),
        "id",
        "title",
    )
    grouped = own.groupBy(key.alias("month")).agg(F.sort_array(F.collect_list(order), asc=False).alias("rows"))
    return grouped.select(
        F.coalesce("month", F.lit("日付不明")).alias("month"),
        F.transform("rows", lambda r: r["id"]).alias("ids"),
    ).orderBy(F.when(F.col("month") == "日付不明", 1).otherwise(0), F.col("month").desc())
