"""Sinks: append-only histories, bodies written once, comparisons, single text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.summaries import new_tag_names


def _read(df: DataFrame, folder: str) -> DataFrame | None:
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return df.sparkSession.read.schema(df.schema).parquet(folder) if there else None


def append_new(df: DataFrame, folder: str, keys: list[str]) -> int:
    """Append the rows whose keys are not there yet; how many were. Running it again appends nothing."""
    there = _read(df, folder)
    fresh = df.dropDuplicates(keys)
    if there is not None:
        fresh = fresh.join(there.select(*keys), keys, "left_anti")
    fresh = fresh.select(*df.columns).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(folder)
    fresh.unpersist()
    return n


def cache_texts(bodies: DataFrame, folder: str) -> int:
    """Bodies (``article_id, version, text``), each version written once."""
    return append_new(bodies.select("article_id", "version", "text"), folder, ["article_id", "version"])


def commit_summaries(records: DataFrame, proposed: DataFrame, folder: str) -> tuple[int, int]:
    """Append summary records (a history: nothing is replaced) and tag names that are not known yet; how many of each.
    Records of one article, version and time are one record, so a commit that is tried again appends none of them twice;
    records that do not have these columns cannot be told apart and are appended each time. For writers side by side, or
    stopped between both tables, see ``plans.summarise``."""
    keys = ["article_id", "article_version", "processed_at"]
    if set(keys) <= set(records.columns):
        added = append_new(records, f"{folder}/summaries", keys)
    else:
        added = records.count()
        records.write.mode("append").parquet(f"{folder}/summaries")
    known = _read(proposed, f"{folder}/tag_candidates")
    fresh = new_tag_names(proposed, known if known is not None else proposed.limit(0))
    return added, append_new(fresh.select(*proposed.columns), f"{folder}/tag_candidates", ["name"])


def comparison(results: DataFrame, articles: DataFrame, folder: str) -> None:
    """Results of a comparison with titles, as JSON beside the data, which stay as they are."""
    results.join(articles.select("article_id", "title"), "article_id", "left").orderBy("article_id").write.mode("overwrite").json(folder)


def text_file(lines: DataFrame, header: str, path: str, end: str = "\r\n", mark: bool = True) -> None:
    """One text file from ordered lines (a column ``line``), streamed through the driver a partition at a time."""
    spark = lines.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write((("﻿" if mark else "") + header + end).encode())
        for r in lines.select(F.col("line")).toLocalIterator():
            out.write((r["line"] + end).encode())
    finally:
        out.close()
