"""Articles and their versions: numbering, change detection, the incremental merge, hash backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.dates import merged_dates
from gleanery.functions.text import collapsed_lines, hash_fields, nfkc


def numbered(history: DataFrame, key: str = "article_id", order: str = "fetched_at") -> DataFrame:
    """Version numbers from 1 and the latest one."""
    w = W.partitionBy(key).orderBy(order)
    return history.withColumn("version", F.row_number().over(w)).withColumn("latest_version", F.count(F.lit(1)).over(W.partitionBy(key)))


def change_types(history: DataFrame, key: str = "article_id", order: str = "version", profile: str | None = None) -> DataFrame:
    """What each fetch of a history adds: new, content_changed or extraction_changed for a new version, else unchanged.

    The first fetch is always a version. A later one is if it was read and its hash differs from that of the last
    version; where both were read, under different extraction profiles, only the extraction changed. What was not
    read, and an equal body under another profile, add nothing."""
    w = W.partitionBy(key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    ok = F.coalesce(F.col("extraction_status") == "ok", F.lit(False))
    first = F.row_number().over(w) == 1
    known = F.last(F.when(ok, F.col("content_hash")), ignorenulls=True).over(before)
    marked = history.withColumn("__version", first | (ok & ~F.col("content_hash").eqNullSafe(known)))
    fields = F.struct(F.col("extraction_status").alias("status"), *([F.coalesce(profile, F.lit("html")).alias("profile")] if profile else []))
    last = F.last(F.when(F.col("__version"), fields), ignorenulls=True).over(before)
    other = (last["status"] == "ok") & (F.coalesce(profile, F.lit("html")) != last["profile"]) if profile else F.lit(False)
    kind = F.when(first, "new").when(~F.col("__version"), "unchanged").when(other, "extraction_changed").otherwise("content_changed")
    return marked.withColumn("change_type", kind).drop("__version")


def gaps(history: DataFrame, key: str, order: str, first: int = 1) -> DataFrame:
    """Keys whose versions are not ``first``, ``first`` + 1, ... without gaps or repeats."""
    seen = history.groupBy(key).agg(
        F.min(order).alias("lo"),
        F.max(order).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(order).alias("d"),
    )
    return seen.where((F.col("lo") != first) | (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("n") != F.col("d")))


#: What the merge decides for a candidate, and the counter it adds to.
DECISIONS = [
    "out_of_period",
    "new_failed",
    "login_only",
    "new_unread",
    "new",
    "unchanged_failed",
    "unchanged",
    "content_changed",
    "extraction_changed",
]


def decision(
    judged: Column,
    login: Column,
    known: Column,
    fetched: Column,
    ok: Column,
    same_hash: Column,
    was_ok: Column,
    same_profile: Column,
) -> Column:
    """The state machine for one candidate against the stored article.

    New articles that are out of the period are dropped, known ones are kept. A failed fetch of a new article is kept
    as a failed version, of a known one it changes nothing. A known article gets a version only if it was read and its
    hash differs; another extraction profile than that of a version that was read makes it a change of extraction. A
    page behind a login is never fetched: its title is kept once."""
    return (
        F.when((judged == F.lit(False)) & ~known, "out_of_period")
        .when(~known & ~fetched, "new_failed")
        .when(~known & login, "login_only")
        .when(~known & ~ok, "new_unread")
        .when(~known, "new")
        .when(~fetched, "unchanged_failed")
        .when(~ok | same_hash, "unchanged")
        .when(was_ok & ~same_profile, "extraction_changed")
        .otherwise("content_changed")
    )


def merge(articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per candidate with its decision and the article as it is afterwards.

    ``articles``: ``article_id, latest_version, content_hash, extraction_status, extraction_profile, published_at,
    updated_at, first_seen_at``, the state of the latest version; ``candidates``: ``article_id, judged, login, status,
    content_hash, extraction_profile, published_at, updated_at, fetched_at`` and maybe ``attachments_failed``. Status
    is ok, unsupported (fetched, no text) or failed (not fetched). A known article whose fetch or whose attachments'
    fetch failed keeps its dates. Profiles that are null count as html."""
    old = articles.select(
        F.col("article_id"),
        *(
            F.col(c).alias("old_" + c) for c in (
                "latest_version",
                "content_hash",
                "extraction_status",
                "extraction_profile",
                "published_at",
                "updated_at",
                "first_seen_at",
            )
        ),
    )
    joined = candidates.join(old, "article_id", "left")
    known = F.col("old_latest_version").isNotNull()
    login = F.coalesce("login", F.lit(False))
    fetched = login | F.coalesce(F.col("status") != "failed", F.lit(False))
    if "attachments_failed" in candidates.columns:
        fetched &= ~(known & F.coalesce("attachments_failed", F.lit(False)))
    html = lambda c: F.coalesce(F.col(c), F.lit("html"))
    kind = decision(
        F.col("judged"),
        login,
        known,
        fetched,
        F.coalesce(F.col("status") == "ok", F.lit(False)) & ~login,
        F.col("content_hash").eqNullSafe(F.col("old_content_hash")),
        F.coalesce(F.col("old_extraction_status") == "ok", F.lit(False)),
        html("extraction_profile") == html("old_extraction_profile"),
    )
    published, updated = merged_dates(F.col("old_published_at"), F.col("published_at"), F.col("old_updated_at"), F.col("updated_at"))
    step = F.when(F.col("decision").isin("new", "new_failed", "new_unread", "login_only", "content_changed", "extraction_changed"), 1).otherwise(0)
    kept = F.col("decision") == "unchanged_failed"
    return joined.withColumn("decision", kind).select(
        "article_id",
        "decision",
        F.when(F.col("decision") != "out_of_period", F.coalesce("old_latest_version", F.lit(0)) + step).cast("int").alias("latest_version"),
        F.when(kept, F.col("old_published_at")).otherwise(published).alias("published_at"),
        F.when(kept, F.col("old_updated_at")).otherwise(updated).alias("updated_at"),
        F.coalesce("old_first_seen_at", "fetched_at").alias("first_seen_at"),
        F.col("fetched_at").alias("last_seen_at"),
    )


def with_attachments(bodies: DataFrame, attachments: DataFrame) -> DataFrame:
    """Bodies with the texts of their readable attachments behind them, in order, each under its title, normalised as a
    whole. Fixed value: the heading."""
    part = F.struct("position", F.concat(F.lit("［添付PDF］"), "title", F.lit("\n"), "text").alias("text"))
    read = attachments.where("status = 'ok'").groupBy("article_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = bodies.join(read, "article_id", "left")
    whole = F.array_join(F.concat(F.array("text"), F.transform("parts", lambda p: p["text"])), "\n\n")
    return joined.withColumn("text", F.when(F.size("parts") > 0, collapsed_lines(nfkc(whole))).otherwise(F.col("text"))).drop("parts")


#: Attachments of an article that are recorded at most.
RECORDED = 20


def capped_attachments(attachments: DataFrame, exclude: list[str], most: int) -> DataFrame:
    """Of the first ``RECORDED`` attachments of an article: the first ``most`` whose titles match no pattern, and why
    others are left out."""
    listed = F.row_number().over(W.partitionBy("article_id").orderBy("position"))
    attachments = attachments.withColumn("__k", listed).where(F.col("__k") <= RECORDED).drop("__k")
    out = F.lit(False)
    for p in exclude:
        out |= F.coalesce(F.col("title").rlike(p), F.lit(False))
    marked = attachments.withColumn("excluded", out)
    place = F.row_number().over(W.partitionBy("article_id", "excluded").orderBy("position"))
    return marked.withColumn("place", place).withColumn(
        "state",
        F.when(F.col("excluded"), "excluded").when(F.col("place") > most, "skipped").otherwise("read"),
    ).drop("place")


def backfilled(latest: DataFrame, normalised: bool = False) -> DataFrame:
    """Adds hash fields to latest versions that have none (``hash_status`` null); others are left as they are.

    ``outcome``: added, unavailable or already."""
    fields = hash_fields(F.col("title"), F.col("text"), F.col("content_type"), F.col("extraction_status"), F.col("attachments"), normalised)
    missing = F.col("hash_status").isNull()
    return latest.withColumn("__f", F.when(missing, fields)).select(
        *(c for c in latest.columns if c not in ("hash", "hash_status", "hash_scope")),
        F.when(missing, F.col("__f.hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(missing, F.col("__f.status")).otherwise(F.col("hash_status")).alias("hash_status"),
        F.when(missing, F.col("__f.scope")).otherwise(F.col("hash_scope")).alias("hash_scope"),
        F.when(~missing, "already").when(F.col("__f.status") == "ok", "added").otherwise("unavailable").alias("outcome"),
    )


def version_records(results: DataFrame) -> DataFrame:
    """Version rows of extraction results; a failure has neither hash nor length."""
    ok = F.col("status") == "ok"
    return results.select(
        "article_id",
        "version",
        F.when(ok, F.col("content_hash")).alias("content_hash"),
        "fetched_at",
        F.when(F.col("content_type").isNull(), "none").otherwise(F.col("content_type")).alias("content_type"),
        F.when(ok, F.length("text")).alias("text_length"),
        F.col("status").alias("extraction_status"),
        F.when(~ok, F.col("error")).alias("extraction_error"),
        "change_type",
    )


def chosen_title(content_type: Column, candidate: Column, page: Column, url: Column, most: int = 300) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.substring(
        F.when(content_type == "pdf", F.coalesce(blank(candidate), blank(page), url)).otherwise(F.coalesce(blank(page), blank(candidate), url)),
        1,
        most,
    )


def extraction_profile(
    content_type: Column,
    attachments: Column,
    exclude: Column,
    max_files: Column | None = None,
    max_pages: Column | None = None,
) -> Column:
    """What decides how a body is read, as one string; nulls are defaults. Fixed value: its form."""
    files, pages = (F.coalesce(c if c is not None else F.lit(None).cast("int"), F.lit(d)).cast("string") for c, d in ((max_files, 3), (max_pages, 30)))
    titles = F.when(F.size(exclude) > 0, F.concat(F.lit(",exclude:"), F.array_join(exclude, "|"))).otherwise("")
    read = F.concat(F.lit("html+pdf("), files, F.lit("files,"), pages, F.lit("pages"), titles, F.lit(")"))
    return F.when(content_type == "pdf", "pdf").when(F.coalesce(attachments, F.lit(False)), read).otherwise("html")
