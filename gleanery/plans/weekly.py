"""Weekly reports: windows counted back from the day of collection, what is new and changed in them, and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import dates, text


def windows(as_of: DataFrame, articles: DataFrame, days: int = 7, most: int = 12) -> DataFrame:
    """``k, from, to``, newest first. ``as_of`` has one day; articles count by published day."""
    first = articles.agg(F.min(dates.published_day(F.col("published"))).alias("earliest"))
    both = as_of.select(F.col("day").alias("as_of")).crossJoin(F.broadcast(first))
    return both.select(F.inline(dates.week_windows(F.col("as_of"), F.col("earliest"), days, most)))


def days_of(weeks: DataFrame) -> DataFrame:
    """``k, from, to, day``: a row for each day of each window, so that days meet their windows by an equi-join. At most
    twelve windows of so many days: small enough to be sent to every task."""
    return F.broadcast(weeks.select("k", "from", "to", F.explode(F.sequence("from", "to")).alias("day")))


def members(weeks: DataFrame, articles: DataFrame, days: int) -> DataFrame:
    """``k, id, kind, version``: new articles by published day; changed ones are dated, not new in the week, and have
    a changed body in it (their largest such version). Articles stay where they are (``days_of``)."""
    spans = days_of(weeks)
    day = dates.published_day(F.col("published"))
    dated = articles.withColumn("day", day).where("day is not null")
    new = dated.join(spans, "day").select(
        "k",
        "id",
        F.lit("new").alias("kind"),
        F.lit(None).cast("int").alias("version"),
    )
    changes = dated.select(
        "id",
        F.col("day").alias("published_day"),
        F.explode("versions").alias("v"),
    ).where("v.change_type = 'content_changed'").withColumn("day", dates.jst_day(F.col("v.fetched_at")))
    within = changes.join(spans, "day").where("published_day < `from` or published_day > `to`")
    changed = within.groupBy("k", "id").agg(F.max("v.version").alias("version")).select("k", "id", F.lit("changed").alias("kind"), "version")
    return new.unionByName(changed)


def counts(weeks: DataFrame, articles: DataFrame, runs: DataFrame, days: int) -> DataFrame:
    """new, changed, date_unknown (undated and first seen in the week), unsummarized, untagged and runs of each week."""
    status = articles.select("id", (F.col("summary.status") != "success").alias("open"), (F.size("tags") == 0).alias("bare"))
    per = members(weeks, articles, days).join(status, "id").groupBy("k").agg(
        F.count_if(F.col("kind") == "new").alias("new"),
        F.count_if(F.col("kind") == "changed").alias("changed"),
        F.count_if("open").alias("unsummarized"),
        F.count_if("bare").alias("untagged"),
    )
    spans = days_of(weeks)
    seen = articles.where(dates.published_day(F.col("published")).isNull()).select(dates.jst_day(F.col("first_seen_at")).alias("day"))
    unknown = seen.join(spans, "day").groupBy("k").agg(F.count(F.lit(1)).alias("date_unknown"))
    ran = runs.select(dates.jst_day(F.col("started_at")).alias("day")).join(spans, "day").groupBy("k").agg(F.count(F.lit(1)).alias("runs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    names = ["new", "changed", "date_unknown", "unsummarized", "untagged", "runs"]
    return weeks.join(per, "k", "left").join(unknown, "k", "left").join(ran, "k", "left").select("k", "from", "to", *map(zero, names)).orderBy("k")


def tag_counts(weeks: DataFrame, articles: DataFrame, definitions: DataFrame, days: int) -> DataFrame:
    """Tags of new and changed articles by week: most frequent first, then in the order of the definitions
    (``tag_id, name, ordinal``), unknown tags last."""
    tags = articles.select("id", F.explode("tags.id").alias("tag_id"))
    n = members(weeks, articles, days).join(tags, "id").groupBy("k", "tag_id").agg(F.count(F.lit(1)).alias("n"))
    named = n.join(definitions.select("tag_id", "name", "ordinal"), "tag_id", "left")
    return named.select(
        "k",
        "tag_id",
        F.coalesce("name", "tag_id").alias("name"),
        "n",
        F.coalesce("ordinal", F.lit(99)).alias("ordinal"),
    ).orderBy("k", F.col("n").desc(), "ordinal", "tag_id")


def source_runs(weeks: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Results of each source in the runs of each week; sources without any are kept, with nulls."""
    results = runs.select(
        "run_id",
        "started_at",
        dates.jst_day(F.col("started_at")).alias("day"),
        F.explode("sources").alias("s"),
    ).join(days_of(weeks), "day")
    flat = results.select("k", "run_id", "started_at", "s.source_id", "s.status", "s.new", "s.changed", "s.error")
    return sources.select("source_id", "name").crossJoin(F.broadcast(weeks.select("k"))).join(flat, ["k", "source_id"], "left").orderBy("k", "source_id", "started_at")


def items(weeks: DataFrame, articles: DataFrame, days: int) -> DataFrame:
    """Report items: new ones by published day and first sight, newest first; then changed ones."""
    got = members(weeks, articles, days).join(articles, "id")
    shown = got.select(
        "k",
        "kind",
        "id",
        "title",
        "url",
        "source_name",
        "published",
        "first_seen_at",
        "version",
        F.transform("tags", lambda t: t["name"]).alias("tags"),
        F.col("summary.status").alias("summary_status"),
    )
    return shown.orderBy("k", F.col("kind").desc(), *item_order())


def item_order() -> list:
    """Newest published day first, then what was seen last; ties by id."""
    return [dates.published_day(F.col("published")).desc(), F.col("first_seen_at").desc(), F.col("id")]


def item_line(kind):
    """A report item as a Markdown line. The wording."""
    names = F.array_join(F.transform("tags", text.markdown), "、")
    shown = F.when(names != "", names).otherwise(F.when(F.col("summary_status") == "success", "タグなし").otherwise("AI未処理"))
    version = F.when((kind == "changed") & F.col("version").isNotNull(), F.concat(F.lit("（第"), F.col("version"), F.lit("版）"))).otherwise("")
    return F.concat(
        F.lit("- "),
        dates.label_partial(F.col("published")),
        F.lit("　"),
        text.markdown(F.col("source_name")),
        F.lit("　["),
        text.markdown(F.col("title")),
        F.lit("]("),
        text.markdown_url(F.col("url")),
        F.lit(")"),
        version,
        F.lit("　タグ："),
        shown,
    )


def markdown(week: dict, lines: dict[str, list[str]], tags: list[tuple[str, int]], site: str) -> str:
    """One week's report from its counts (a row of ``counts``), item lines by kind and tag counts."""
    day = lambda d: f"{d.year}年{d.month}月{d.day}日"
    head = [f"# 週次レポート {day(week['from'])}〜{day(week['to'])}", "", f"- サイト：{site}", "", "## 概要", "", "| 項目 | 件数 |", "|---|---:|"]
    head += [f"| {label} | {week[k]} |" for label, k in (("新規", "new"), ("変更", "changed"), ("公開日不明のため数えていない記事（この期間に見つけたもの）", "date_unknown"), ("うち未要約", "unsummarized"), ("期間内の収集実行", "runs"))]
    body = []
    for label, kind in (("新規", "new"), ("変更", "changed")):
        body += ["", f"## {label}（{week[kind]}件）", "", *(lines.get(kind) or ["なし"])]
    body += ["", "## タグ別件数（新規＋変更）", ""]
    body += ["| タグ | 件数 |", "|---|---:|", *(f"| {n} | {c} |" for n, c in tags)] if tags else ["なし"]
    return "\n".join(head + body) + "\n"


def selected_week(reports: DataFrame, week_id: str | None) -> DataFrame:
    """The chosen week, or the newest if there is none of that name."""
    named = reports.withColumn("id", F.concat_ws("_", F.date_format("from", "yyyy-MM-dd"), F.date_format("to", "yyyy-MM-dd")))
    return named.orderBy(F.when(F.col("id") == (week_id or ""), 0).otherwise(1), "k").limit(1)
