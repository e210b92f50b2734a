"""Tags of several origins: union with precedence, removal by people, reasons, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Origins in order of precedence: the first that gives a tag keeps it.
ORIGINS = ["ai", "source", "rule", "human"]


def rule_reasons(matches: DataFrame) -> DataFrame:
    """Matches (``article_id, tag_id, label, in, pos``) as one row per tag with a reason, in order of first match.

    Fixed values: the wording."""
    part = F.concat(F.lit("「"), F.col("label"), F.lit("」（"), F.when(F.col("in") == "title", "題名").otherwise("本文"), F.lit("）"))
    grouped = matches.groupBy("article_id", "tag_id").agg(
        F.min("pos").alias("pos"),
        F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"),
    )
    reason = F.concat(F.lit("ルール（キーワード一致）："), F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit("が見つかりました"))
    return grouped.select("article_id", "tag_id", "pos", reason.alias("reason"))


def fixed_tags(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Tags that a source gives to all of its articles: ``article_id, tag_id, pos, reason``."""
    reason = F.concat(F.lit("情報源の設定："), F.col("name"), F.lit("の記事すべてに付けています"))
    listed = sources.select("source_id", F.posexplode("fixed_tags").alias("pos", "tag_id"), reason.alias("reason"))
    return articles.select("article_id", "source_id").join(listed, "source_id").select("article_id", "tag_id", "pos", "reason")


def _origins(ai: DataFrame, source: DataFrame, rule: DataFrame, human: DataFrame | None = None) -> DataFrame:
    parts = list(zip(ORIGINS, (ai, source, rule, human)))
    all_ = None
    for k, (name, df) in enumerate(p for p in parts if p[1] is not None):
        one = df.select(
            "article_id",
            "tag_id",
            "pos",
            F.col("reason").cast("string").alias("reason") if "reason" in df.columns else F.lit(None).cast("string").alias("reason"),
            F.lit(name).alias("origin"),
            F.lit(k).alias("priority"),
        )
        all_ = one if all_ is None else all_.unionByName(one)
    return all_


def _first_per_tag(rows: DataFrame) -> DataFrame:
    """The entry of highest precedence for each article and tag: a minimum, so it is combined before the shuffle."""
    return rows.groupBy("article_id", "tag_id").agg(
        F.min(F.struct("priority", "pos", "origin", "reason")).alias("e")
    ).select("article_id", "tag_id", "e.*")


def final_tags(ai: DataFrame, source: DataFrame, rule: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(AI ∪ source ∪ rule ∪ added) − removed, each tag once with its first origin; removing beats adding.

    Inputs have ``article_id, tag_id, pos`` and maybe ``reason``; ``removed`` has ``article_id, tag_id``."""
    return _first_per_tag(_origins(ai, source, rule, added)).join(
        removed.select("article_id", "tag_id").distinct(),
        ["article_id", "tag_id"],
        "left_anti",
    )


def removed_tags(ai: DataFrame, source: DataFrame, rule: DataFrame, removed: DataFrame) -> DataFrame:
    """Tags that AI, a source or a rule gives and a person removed, each once."""
    return _first_per_tag(_origins(ai, source, rule)).join(removed.select("article_id", "tag_id").distinct(), ["article_id", "tag_id"], "left_semi")


def named(tags: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds ``name`` and ``retired`` from definitions (``tag_id, name, enabled``); unknown tags are named by id."""
    defs = definitions.select("tag_id", F.col("name").alias("def_name"), F.col("enabled").alias("def_enabled"))
    joined = tags.join(defs, "tag_id", "left")
    return joined.withColumn("name", F.coalesce("def_name", "tag_id")).withColumn(
        "retired",
        ~F.coalesce("def_enabled", F.lit(False)),
    ).drop("def_name", "def_enabled")


def as_arrays(tags: DataFrame) -> DataFrame:
    """One row per article with its tags in order: ``article_id, tags``."""
    entry = F.struct("priority", "pos", F.col("tag_id").alias("id"), "name", "origin", "reason", "retired")
    out = lambda t: F.struct(*(t[c].alias(c) for c in ("id", "name", "origin", "reason", "retired")))
    return tags.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(entry)), out).alias("tags"))


def selectable(definitions: DataFrame) -> DataFrame:
    """Tags that AI may choose: enabled and not left to rules."""
    return definitions.where(F.col("enabled") & ~F.coalesce("rule_only", F.lit(False)))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the columns ``order``, and ``duplicates``, how many more there are. A minimum, so it
    is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__r"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return found.select(*keys, "__r.*", "duplicates")
