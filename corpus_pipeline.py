"""A corpus pipeline of five stages over ``documents``, each by one operator of ``gleanery.llm``.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Rows are told apart by file and row number, so null and
repeated ids are handled; empty tables pass through.

Near duplicates are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: the SimHash
index gives candidates, and each link is confirmed on the words of both texts (``simhash.near_groups``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.bpe_table import encode_decode
from gleanery.llm.common import from_files, without, work_dir, written
from gleanery.llm.decontamination import contamination
from gleanery.llm.exact_dedup import exact_dedup
from gleanery.llm.quality import fit, scored
from gleanery.llm.simhash import near_groups


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good, learned from the labels of ``sf_dir``."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return scored(docs, model, names=("__score", "__predicted")).where("__predicted = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    work = work_dir(spark, "exact-stage")
    docs = from_files(docs, f"{work}/docs")
    return without(docs, exact_dedup(docs, locate=True).where("not kept"), f"{work}/gone")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last, then by file and row."""
    work = work_dir(spark, "near-stage")
    docs = from_files(docs, f"{work}/docs")
    found = near_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row", "n")
    stays = found.groupBy("root").agg(F.min(order).alias("first")).select("first.n")
    return without(docs, found.join(stays, "n", "left_anti"), f"{work}/gone")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word of a benchmark window."""
    work = work_dir(spark, "decontamination-stage")
    docs = from_files(docs, f"{work}/docs")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated"), f"{work}/gone")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of what is left. Executors have run four stages by now, so
    the shared part of the word table is small; more words go through the bucket files."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), shared_bytes=4 << 20)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL expresses neither the classifier nor SimHash; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{work}/{k}")
    return docs
