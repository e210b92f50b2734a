"""Integrity checks as rows ``check, key, message``: an empty result means that all is well."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text


def _rows(df: DataFrame, check: str, key: Column, message: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def _each(df: DataFrame, *rules: tuple[Column, str, Column, str]) -> DataFrame:
    """Rows that break rules (what is wrong, check, key, message), all in one pass over ``df``."""
    found = [F.when(wrong, F.struct(F.lit(check).alias("check"), key.cast("string").alias("key"), F.lit(message).alias("message"))) for wrong, check, key, message in rules]
    return df.select(F.inline(F.array_compact(F.array(*found))))


def all_of(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def duplicates(df: DataFrame, key: str, check: str) -> DataFrame:
    """Each repeated key once."""
    return _rows(df.groupBy(key).count().where("count > 1"), check, F.col(key), "the key is not unique")


def missing(df: DataFrame, key: str, other: DataFrame, other_key: str, check: str) -> DataFrame:
    """Keys that do not occur in another table."""
    known = other.select(F.col(other_key).alias("__key")).distinct()
    return _rows(
        df.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__key"), "left_anti").select(key).distinct(),
        check,
        F.col(key),
        "the key is not known",
    )


def articles(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files``: ``file, article, versions``. One pass for all rules of a file, one for unknown sources."""
    a = files.select("file", "article.*", "versions")
    id_, last = F.col("article_id"), F.element_at("versions", -1)
    numbers = F.transform("versions", lambda v: v["version"])
    dates_of = lambda c: (
        F.col(f"{c}_at").isNull() != (F.col(f"date_precision.{c}") == "unknown")
    ) | (F.col(f"{c}_at").isNull() != F.col(f"date_basis.{c}").isNull())
    children = F.exists("versions", lambda v: ~v["article_id"].eqNullSafe(id_))
    halves = F.exists(
        "versions",
        lambda v: (v["extraction_status"] == "ok") & (
            v["content_hash"].isNull() | v["extraction_error"].isNotNull()
        ) | (v["extraction_status"] != "ok") & v["extraction_error"].isNull(),
    )
    rules = [
        (F.col("file") != F.concat("article_id", F.lit(".json")), "file_name", F.col("file"), "the file is not named by its id"),
        (id_ != text.article_id(F.col("canonical_url")), "article_id", id_, "the id is not the hash of the URL"),
        (numbers != F.sequence(F.lit(1), F.size("versions")), "versions", id_, "versions are not 1 to n"),
        (F.col("latest_version") != last["version"], "latest_version", id_, "the latest version is not the last"),
        (children, "version_article", id_, "a version belongs to another article"),
        (F.element_at("versions", 1)["change_type"] != "new", "first_version", id_, "version 1 is not new"),
        (halves, "version_state", id_, "status, hash and error do not go together"),
        (dates_of("published") | dates_of("updated"), "dates", id_, "value, precision and basis do not go together"),
    ]
    broken = [
        _each(files, (F.col("broken").isNotNull(), "readable", F.col("file"), "the file is not valid JSON"))
    ] if "broken" in files.columns else []
    return all_of(*broken, _each(a, *rules), missing(a, "source_id", sources, "source_id", "source"))


def summaries(rows: DataFrame, known: DataFrame, tags: DataFrame) -> DataFrame:
    """``rows``: exploded summaries; null fields of failures are right, empty ones are not."""
    ok = F.col("analysis_status") == "success"
    content = ["summary", "key_points", "targets", "dates", "ai_tags", "uncertainties"]
    some, all_ = reduce(Column.__or__, [F.col(c).isNotNull() for c in content]), reduce(Column.__and__, [F.col(c).isNotNull() for c in content])
    used = rows.select(F.explode("ai_tags.tag_id").alias("tag_id"))
    versions = [
        _rows(
            rows.join(known.select("article_id", "latest_version"), "article_id").where("article_version > latest_version"),
            "summary_version",
            F.col("article_id"),
            "the version does not exist",
        )
    ] if "latest_version" in known.columns else []
    return all_of(
        *versions,
        missing(rows, "article_id", known, "article_id", "summary_article"),
        missing(used, "tag_id", tags, "tag_id", "summary_tag"),
        _each(
            rows,
            (
                ok & (~all_ | (F.length("summary") > 300) | (F.size("key_points") > 5)),
                "summary_success",
                F.col("article_id"),
                "a success lacks fields or exceeds limits",
            ),
            (~ok & some, "summary_failure", F.col("article_id"), "a failure has content"),
            (~ok & F.col("error").isNull(), "summary_reason", F.col("article_id"), "a failure has no reason"),
        ),
    )


def overrides(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Added tags are registered and enabled, removed ones registered; none is in both lists or twice in one."""
    added = rows.select("article_id", F.explode("add").alias("tag_id"))
    removed = rows.select("article_id", F.explode("remove").alias("tag_id"))
    twice = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    return all_of(
        missing(added, "tag_id", tags.where("enabled"), "tag_id", "override_add"),
        missing(removed, "tag_id", tags, "tag_id", "override_remove"),
        _each(
            rows,
            (F.size(F.array_intersect("add", "remove")) > 0, "override_both", F.col("article_id"), "a tag is added and removed"),
            (twice("add") | twice("remove"), "override_twice", F.col("article_id"), "a tag is listed twice"),
        ),
        duplicates(rows, "article_id", "override_article"),
    )


Problem = tuple[str, str, str]
#: What an enabled source needs for the external CSV.
CSV_FIELDS = ("csv_id", "publisher", "source_type")


def _repeated(values: Iterable[str]) -> list[str]:
    """Each value that occurs more than once, once, in order."""
    return [v for v, n in Counter(values).items() if n > 1]


def _patterns(key: str, patterns: Iterable[str]) -> Iterator[Problem]:
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            yield "pattern", key, f"the pattern does not compile: {p}"


def sources(config: list[dict], tag_ids: set[str], disabled: set[str] = frozenset()) -> list[Problem]:
    """Checks of configured sources: unique ids, entry host among the allowed, patterns that compile, fixed tags that
    are registered and not ``disabled``, what enabled sources need for the external CSV, unique CSV ids."""
    out = [("source_id", v, "the key is not unique") for v in _repeated(s["id"] for s in config)]
    out += [("csv_id", v, "the key is not unique") for v in _repeated(s["csv_id"] for s in config if s.get("csv_id"))]
    for s in config:
        host = re.match("https?://([^/:?#]+)", s.get("entry_url") or "")
        if not host or host[1].lower() not in [h.lower() for h in s.get("allowed_hosts", [])]:
            out.append(("entry_host", s["id"], "the entry's host is not allowed"))
        links = s.get("link_rules") or {}
        out += _patterns(s["id"], [*links.get("include", []), *links.get("exclude", []), *(s.get("attachments") or {}).get("exclude_titles", [])])
        out += [
            (
                "fixed_tag",
                s["id"],
                f"the tag is not registered or disabled: {t}",
            ) for t in s.get("fixed_tags", []) if t not in tag_ids or t in disabled
        ]
        if s.get("enabled"):
            out += [("csv_field", s["id"], f"an enabled source needs {f}") for f in CSV_FIELDS if not s.get(f)]
    return out


def tags(config: list[dict]) -> list[Problem]:
    """Checks of configured tags: unique ids and names; rules only where a tag is left to them, with unique labels and
    patterns that compile."""
    out = [("tag_id", v, "the key is not unique") for v in _repeated(t["id"] for t in config)]
    out += [("tag_name", v, "the name is not unique") for v in _repeated(t["name"] for t in config)]
    for t in config:
        rules = t.get("auto_rules", [])
        if rules and not t.get("rule_only"):
            out.append(("rule_only", t["id"], "rules need a tag that is left to them"))
        out += [("rule_label", t["id"], f"the label is not unique: {v}") for v in _repeated(r["label"] for r in rules)]
        out += _patterns(t["id"], [r["pattern"] for r in rules])
    return out


def rule_tags(entries: DataFrame, known: DataFrame, definitions: DataFrame) -> DataFrame:
    """``entries``: ``article_id, article_version, tags`` (array of structs with a tag_id) of remembered rule tags;
    ``known``: ``article_id, latest_version``."""
    newer = entries.join(known.select("article_id", "latest_version"), "article_id").where("article_version > latest_version")
    used = entries.select(F.explode("tags.tag_id").alias("tag_id"))
    return all_of(
        missing(entries, "article_id", known, "article_id", "rule_article"),
        _rows(newer, "rule_version", F.col("article_id"), "the version is newer than the article's"),
        missing(used, "tag_id", definitions, "tag_id", "rule_tag"),
    )


def tag_candidates(rows: DataFrame, known: DataFrame) -> DataFrame:
    return missing(rows, "article_id", known, "article_id", "candidate_article")


def state(rows: DataFrame, config: DataFrame, known: DataFrame) -> DataFrame:
    items = rows.select(F.explode("retry_queue").alias("r")).select("r.*")
    keys = [
        _rows(rows.where(~F.col("key").eqNullSafe(F.col("source_id"))), "state_key", F.col("key"), "the key is not the source's id")
    ] if "key" in rows.columns else []
    return all_of(
        *keys,
        missing(rows, "source_id", config, "source_id", "state_source"),
        missing(items, "article_id", known, "article_id", "retry_article"),
        _rows(rows.where("consecutive_failures < 0"), "state_failures", F.col("source_id"), "a negative count"),
    )


def runs(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Sources are known; totals are the sums over sources; a period does not end before it starts."""
    flat = rows.select("run_id", F.explode("sources").alias("s"), "totals")
    sums = flat.groupBy("run_id", "totals").agg(*(F.sum(f"s.{c}").alias(c) for c in ("new", "changed", "unchanged")))
    wrong = sums.where(reduce(Column.__or__, [F.col(c) != F.col(f"totals.{c}") for c in ("new", "changed", "unchanged")]))
    period = [
        _rows(rows.where("period.start > period.`end`"), "run_period", F.col("run_id"), "the period ends before it starts")
    ] if "period" in rows.columns else []
    return all_of(
        missing(flat.select("s.source_id"), "source_id", config, "source_id", "run_source"),
        _rows(wrong, "run_totals", F.col("run_id"), "totals are not the sums"),
        duplicates(rows, "run_id", "run_id"),
        *period,
    )


def public(articles_: DataFrame, values: list[str] = ()) -> DataFrame:
    """Published rows that hold something secret anywhere."""
    return _rows(articles_.where(text.has_secret(F.to_json(F.struct("*")), values)), "secret", F.col("id"), "a value that looks secret")
