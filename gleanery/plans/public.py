"""The public dataset: an allow-list projection of articles with summaries, tags and settings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import summaries as S
from gleanery.operators import tags as G
from gleanery.operators.search import newest_first


def date_info(value: Column, precision: Column, basis: Column) -> Column:
    evidence = F.struct(basis["method"].alias("method"), T.plain_text(basis["evidence"]).alias("evidence"))
    return F.struct(value.alias("value"), precision.alias("precision"), F.when(basis.isNotNull(), evidence).alias("basis"))


def public_summary(s: Column, latest_version: Column) -> Column:
    """Fields of a summary that may be shown; content only of a success, ``not_processed`` without one."""
    ok = s["analysis_status"] == "success"
    shown = lambda c: F.when(ok, s[c])
    return F.struct(
        F.coalesce(s["analysis_status"], F.lit("not_processed")).alias("status"),
        s["error"].alias("error"),
        s["article_version"].alias("version"),
        F.coalesce(s["article_version"] < latest_version, F.lit(False)).alias("outdated"),
        shown("summary").alias("text"),
        *(shown(c).alias(c) for c in ("key_points", "targets", "dates", "uncertainties")),
        s["model"].alias("model"),
        s["processed_at"].alias("processed_at"),
    )


def public_articles(
    articles: DataFrame,
    summaries: DataFrame,
    sources: DataFrame,
    definitions: DataFrame,
    overrides: DataFrame,
    matches: DataFrame,
) -> DataFrame:
    """Articles as they are published, newest first.

    ``articles``: rows of article files (``article, versions``); ``summaries``: exploded summaries; ``sources``:
    ``source_id, name, source_type, fixed_tags``; ``definitions``: ``tag_id, name, enabled``; ``overrides``:
    ``article_id, add, remove, reason``; ``matches``: rows of ``rules.matches``. The last four are configuration or
    small; Spark broadcasts them by their size."""
    base = articles.select("article.*", "versions").withColumn("last", F.element_at("versions", -1))
    latest = S.latest_summary(summaries)
    ai = latest.where("analysis_status = 'success'").select(
        "article_id",
        F.posexplode("ai_tags").alias("pos", "t"),
    ).select("article_id", "pos", "t.tag_id", "t.reason")
    fixed = G.fixed_tags(base, sources)
    rule = G.rule_reasons(matches)
    added = overrides.select("article_id", F.posexplode("add").alias("pos", "tag_id"))
    removed = overrides.select("article_id", F.explode("remove").alias("tag_id"))
    tags = G.as_arrays(G.named(G.final_tags(ai, fixed, rule, added, removed), definitions))
    gone = G.named(G.removed_tags(ai, fixed, rule, removed), definitions).groupBy("article_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("priority", "pos", F.col("tag_id").alias("id"), "name"))),
            lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name")),
        ).alias("removed_tags")
    )
    info = sources.select("source_id", F.col("name").alias("source_label"), "source_type")
    s = F.struct(*latest.columns).alias("s")
    joined = base.join(latest.select("article_id", s), "article_id", "left").join(info, "source_id", "left").join(tags, "article_id", "left").join(gone, "article_id", "left").join(
        overrides.select("article_id", F.col("reason").alias("tag_override_reason")),
        "article_id",
        "left",
    )
    version = lambda v: F.struct(*(v[c].alias(c) for c in ("version", "fetched_at", "change_type", "extraction_status")))
    attachment = lambda a: F.struct(
        a["title"].alias("title"),
        a["url"].alias("url"),
        a["status"].alias("status"),
        a["error"].alias("note"),
        a["pages"].alias("pages"),
    )
    empty = lambda c: F.coalesce(c, F.array())
    return newest_first(
        joined.select(
            F.col("article_id").alias("id"),
            "source_id",
            F.coalesce("source_label", "source_id").alias("source_name"),
            "title",
            F.col("canonical_url").alias("url"),
            F.col("published_at").alias("published"),
            F.col("updated_at").alias("updated"),
            date_info(F.col("published_at"), F.col("date_precision.published"), F.col("date_basis.published")).alias("published_info"),
            date_info(F.col("updated_at"), F.col("date_precision.updated"), F.col("date_basis.updated")).alias("updated_info"),
            "first_seen_at",
            "last_seen_at",
            "status",
            F.col("last.extraction_status").alias("content_status"),
            F.col("last.extraction_error").alias("content_error"),
            "latest_version",
            F.transform("versions", version).alias("versions"),
            empty(F.transform("last.attachments", attachment)).alias("attachments"),
            public_summary(F.col("s"), F.col("latest_version")).alias("summary"),
            F.struct(
                T.csv_source_type(F.col("canonical_url"), F.col("source_type")).alias("source_type"),
                F.col("last.export_hash").alias("hash"),
                F.coalesce("last.export_hash_status", F.lit("unavailable")).alias("hash_status"),
                F.col("last.export_hash_scope").alias("hash_scope"),
            ).alias("csv"),
            F.coalesce("tags", F.array().cast(tags.schema["tags"].dataType)).alias("tags"),
            F.coalesce("removed_tags", F.array().cast(gone.schema["removed_tags"].dataType)).alias("removed_tags"),
            "tag_override_reason",
        )
    )


#: Columns of the article list in order.
LIST_COLUMNS = [
    "記事ID",
    "公開日",
    "公開日の精度",
    "更新日",
    "取得日時",
    "機関",
    "タイトル",
    "出典URL",
    "概要",
    "AI処理状態",
    "AIタグ",
    "設定で付けたタグ",
    "ルールで付けたタグ",
    "人が追加したタグ",
    "人が除外したタグ",
    "本文の状態",
    "最新版",
]


def list_csv(articles: DataFrame) -> DataFrame:
    """One column ``line``: the article list as CSV lines, without the header (``csv_file`` adds it)."""
    of = lambda o: F.array_join(F.transform(F.filter("tags", lambda t: t["origin"] == o), lambda t: t["name"]), ";")
    cells = [
        F.col("id"),
        F.col("published"),
        F.col("published_info.precision"),
        F.col("updated"),
        F.col("first_seen_at"),
        F.col("source_name"),
        F.col("title"),
        F.col("url"),
        F.col("summary.text"),
        F.col("summary.status"),
        *map(of, G.ORIGINS),
        F.array_join(F.transform("removed_tags", lambda t: t["name"]), ";"),
        F.col("content_status"),
        F.col("latest_version"),
    ]
    return articles.select(T.csv_line(*cells).alias("line"))


def csv_text(header: list[str], lines: list[str]) -> str:
    """A CSV file's text: byte order mark, CRLF line ends."""
    return "﻿" + "\r\n".join([",".join(header), *lines]) + "\r\n"


def meta(sources: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the site knows of sources and tags; what is not enabled is retired."""
    return sources.select(
        "source_id",
        "name",
        (~F.col("enabled")).alias("retired"),
    ), definitions.select("tag_id", "name", (~F.col("enabled")).alias("retired"))


def data_as_of(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """When data were collected last: the newest collecting run, else the newest article."""
    run = runs.agg(F.max(F.when(F.col("kind").isin("collect", "collect_and_summarize"), F.col("started_at"))).alias("run"))
    return run.crossJoin(articles.agg(F.max("first_seen_at").alias("seen"))).select(F.coalesce("run", "seen").alias("data_as_of"))


def detail(articles: DataFrame, id_: str) -> DataFrame:
    """One article with its tags split by origin."""
    of = lambda o: F.filter("tags", lambda t: t["origin"] == o).alias(f"tags_{o}")
    return articles.where(F.col("id") == id_).select("*", *map(of, G.ORIGINS))


def filtered_json(articles: DataFrame, release_mode: str) -> DataFrame:
    """Each article as one JSON line with the release mode."""
    return articles.select(F.to_json(F.struct(F.lit(release_mode).alias("release_mode"), *articles.columns)).alias("value"))


def publish(df: DataFrame, folder: str, problems: DataFrame | None = None) -> str:
    """Staged sink: write a new version below ``folder``, check, then point to it; a problem leaves what was there.

    Readers go through ``published``: the file ``current`` names the version that counts. It is written beside and
    renamed over the one before in one step, so at every moment a whole version is there. Versions that were replaced
    before the last one are removed."""
    spark = df.sparkSession
    found = problems.limit(5).collect() if problems is not None else []
    if found:
        raise ValueError(f"not published: {[tuple(r) for r in found]}")
    before = _current(spark, folder)
    version = f"v{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{folder}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).getFileSystem(conf).getUri(), conf)
    fs = path(folder).getFileSystem(conf)
    out = fs.create(path(f"{folder}/.current.{version}"), True)
    out.write(version.encode())
    out.close()
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{folder}/.current.{version}"), path(f"{folder}/current"), renames)  # raises if it fails
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("v") and name not in (version, before):
            fs.delete(status.getPath(), True)
    return version


def _current(spark: SparkSession, folder: str) -> str | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.text(f"{folder}/current", wholetext=True).first()[0] if fs.exists(path) else None


def published(spark: SparkSession, folder: str) -> DataFrame:
    """What ``publish`` made current."""
    return spark.read.parquet(f"{folder}/{_current(spark, folder)}")


#: The four files of a published data set.
PUBLIC_FILES = ("meta", "articles", "status", "reports")
#: Fixed value: the element that holds a data set within a page.
EMBEDDED_ID = "embedded-site-data"


def load_public(spark: SparkSession, folder: str, schemas: dict[str, str], page: str | None = None) -> dict[str, DataFrame]:
    """The published JSON files (``schemas``: the DDL of each), each a lazy scan (they are read side by side when used), or the data that a ``page``
    carries in a script element."""
    if page is not None:
        from gleanery.sources.markup import tree

        holder = tree(page).first(f"script#{EMBEDDED_ID}")
        if holder is not None and holder.get("type") == "application/json":
            whole = spark.createDataFrame([("".join(holder.texts()),)], "value string")
            parsed = whole.select(F.from_json("value", ", ".join(f"{n} struct<{schemas[n]}>" for n in PUBLIC_FILES)).alias("d"))
            return {n: parsed.select(f"d.{n}.*") for n in PUBLIC_FILES}
    return {n: spark.read.schema(schemas[n]).option("multiLine", True).json(f"{folder}/{n}.json") for n in PUBLIC_FILES}


def pretty_json(value: object) -> str:
    """JSON as it is kept: two spaces, no escapes of letters, a final line feed."""
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"
