"""Scans of stored records, configuration and bodies. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.schemas import SCHEMAS


def json_documents(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """One row per JSON file of a folder, with its ``file``; broken files have only ``broken`` (their content)."""
    schema = SCHEMAS[kind] + ", broken STRING"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    return read.json(folder).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0))


def newest_run(runs: DataFrame) -> DataFrame:
    """The run record with the largest id."""
    return runs.agg(F.max_by("run", "run.run_id").alias("run")).select("run.*")


class DuplicateKey(ValueError):
    pass


def _unique(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise DuplicateKey(f"duplicate key: {next(k for k in keys if keys.count(k) > 1)}")
    return dict(pairs)


def config_file(path: str | Path) -> object:
    """A JSON or YAML file. A key that occurs twice is an error; dates stay strings."""
    return config_text(str(path), Path(path).read_text(encoding="utf-8"))


def overlaid(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files (``name, text``), those of the overlay in place of files of the same name."""
    return overlay.select("name", "text").unionByName(base.select("name", "text").join(overlay.select("name"), "name", "left_anti"))


def parsed_files(files: DataFrame) -> DataFrame:
    """``name, value, error`` of settings files (``name, text``): the value as JSON, or why it cannot be read."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch["name"], batch["text"]):
                try:
                    rows.append((name, json.dumps(config_text(name, text), ensure_ascii=False), None))
                except ValueError as e:
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "value", "error"], dtype=object)

    return files.select("name", "text").mapInPandas(run, "name string, value string, error string")


def config_text(name: str, text: str) -> object:
    """The value of a settings file by its name and text."""
    if name.endswith(".json"):
        return json.loads(text, object_pairs_hook=_unique)
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    Strict.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Strict.add_constructor(
        "tag:yaml.org,2002:map",
        lambda loader,
        node: _unique([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]),
    )
    return yaml.load(text, Loader=Strict)


def config_path(name: str, base: str | Path, overlay: str | Path | None = None) -> Path:
    """A file of the overlay folder stands in for the base folder's file of the same name."""
    over = Path(overlay) / name if overlay else None
    return over if over and over.exists() else Path(base) / name


def dataset_folder(mode: str, root: str) -> tuple[str, str | None]:
    """Data folder and configuration overlay of the demo or the real data set."""
    known = {"demo": (f"{root}/demo/data", f"{root}/demo/config"), "real": (f"{root}/data", None)}
    if mode not in known:
        raise ValueError(f"unknown mode: {mode}")
    return known[mode]


def cached_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``article_id, version, text`` of body files named ``<id>_v<version>.txt``."""
    read = spark.read.text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_v(\d+)\.txt$", 1)
    version = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_v(\d+)\.txt$", 2)
    return read.select(name.alias("article_id"), version.cast("int").alias("version"), F.col("value").alias("text"))


def fixture_responses(spark: SparkSession, routes: list[dict], folder: str, urls: DataFrame, hops: int = 5) -> DataFrame:
    """Answers of a fake web: each of ``urls`` (``url``) with ``final_url, status, content_type, body, error``.

    A route has a url and either file (and type), status, redirect or timeout. Redirects are followed ``hops`` times.
    """
    fields = ["url", "file", "type", "status", "redirect", "timeout"]
    rows = [tuple(r.get(f) for f in fields) for r in routes]
    table = F.broadcast(spark.createDataFrame(rows, "url STRING, file STRING, type STRING, status INT, redirect STRING, timeout BOOLEAN"))
    at = urls.select("url", F.col("url").alias("final_url"))
    for _ in range(hops):
        to = table.where("redirect is not null").select(F.col("url").alias("from_url"), "redirect")
        at = at.join(to, at.final_url == to.from_url, "left").select("url", F.coalesce("redirect", "final_url").alias("final_url"))
    found = at.join(table.withColumnRenamed("url", "route_url"), F.col("final_url") == F.col("route_url"), "left")
    bodies = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")
    error = F.when(F.col("timeout"), "timeout").when(F.col("redirect").isNotNull(), "too many redirects").when(F.col("route_url").isNull(), "HTTP 404").when(
        F.col("status") >= 400,
        F.concat(F.lit("HTTP "), F.col("status")),
    )
    return found.join(bodies, F.col("file") == F.col("name"), "left").select(
        "url",
        "final_url",
        F.coalesce("status", F.lit(200)).alias("status"),
        F.col("type").alias("content_type"),
        F.col("content").alias("body"),
        error.alias("error"),
    )
