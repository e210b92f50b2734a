"""Keyword rules over texts, and when their remembered results still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import definition_hash


def load_rules(tags: list[dict]) -> list[dict]:
    """Rules of enabled tags in written order: tag_id, label, pattern."""
    return [{"tag_id": t["id"], "label": r["label"], "pattern": r["pattern"]} for t in tags if t["enabled"] for r in t.get("auto_rules", [])]


def rules_version(rules: list[dict]) -> str:
    return definition_hash(rules)


def matches(articles: DataFrame, rules: list[dict], longest: int = 80) -> DataFrame:
    """``article_id, tag_id, label, matched, in, pos`` of NFKC ``title`` and ``body``; a title match comes first.

    Each rule is one expression in a single pass; texts are neither copied nor joined to rules.
    """

    def found(k: int, rule: dict) -> Column:
        pattern = "(?iu)" + rule["pattern"]
        hit = lambda c: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
        where = F.when(hit("title"), "title").when(hit("body"), "body")
        text = F.when(where == "title", F.col("title")).otherwise(F.col("body"))
        cut = F.substring(F.trim(F.regexp_substr(text, F.lit(pattern))), 1, longest)
        entry = F.struct(
            F.lit(rule["tag_id"]).alias("tag_id"),
            F.lit(rule["label"]).alias("label"),
            F.when(cut != "", cut).otherwise(F.lit(rule["label"])).alias("matched"),
            where.alias("in"),
            F.lit(k).alias("pos"),
        )
        return F.when(where.isNotNull(), entry)

    if not rules:
        return articles.select(
            "article_id",
            F.lit("").alias("tag_id"),
            F.lit("").alias("label"),
            F.lit("").alias("matched"),
            F.lit("").alias("in"),
            F.lit(0).alias("pos"),
        ).limit(0)
    entries = F.array_compact(F.array(*(found(k, r) for k, r in enumerate(rules))))
    return articles.select("article_id", F.inline(entries))


def freshness(latest: DataFrame, previous: DataFrame, version_now: str) -> DataFrame:
    """What to do for each article: ``unchanged``, ``stale`` or ``updated``, with its scope.

    ``latest``: ``article_id, version, has_text`` and maybe ``extraction_status``; ``previous``: ``article_id, article_version, scope, rules_version``.
    Rules that changed cannot be tried again where the body is gone; that result is kept as stale."""
    old = previous.select("article_id", "article_version", F.col("scope").alias("old_scope"), "rules_version")
    same = F.coalesce(F.col("article_version") == F.col("version"), F.lit(False))
    fresh = same & (F.col("rules_version") == version_now) & ((F.col("old_scope") == "body") | ~F.col("has_text"))
    stale = same & ~F.col("has_text") & (F.col("old_scope") == "body")
    action = F.when(fresh, "unchanged").when(stale, "stale").otherwise("updated")
    scope = F.when(action == "updated", F.when(F.col("has_text"), "body").otherwise("title")).otherwise(F.col("old_scope"))
    return latest.join(old, "article_id", "left").select(*latest.columns, action.alias("action"), scope.alias("scope"))


def counters(decided: DataFrame) -> DataFrame:
    """Results of ``freshness`` counted; ``tagged`` if a boolean column of that name is there. ``title_only`` counts
    articles judged by title although their latest version was read (``extraction_status``)."""
    n = lambda x: F.count_if(x)
    tagged = [n(F.col("tagged")).alias("tagged")] if "tagged" in decided.columns else []
    return decided.agg(
        *(n(F.col("action") == a).alias(a) for a in ("updated", "unchanged", "stale")),
        n((F.col("scope") == "title") & (F.col("extraction_status") == "ok")).alias("title_only"),
        *tagged,
    )


def rule_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["tag_id"], r["label"], r["pattern"]) for r in rules], "tag_id string, label string, pattern string")
