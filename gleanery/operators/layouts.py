"""Stored orders that queries read in part: articles by the days they may mean, and pages of a large order."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import dates
from gleanery.operators.search import page_bounds


def _ordered(rows: DataFrame, parts: int, keys: list[Column], first: tuple[str, ...] = ()) -> DataFrame:
    """Rows in ``parts`` ranges of the order, each range sorted and told its number in ``part``."""
    dealt = rows.repartitionByRange(parts, *first, *keys).withColumn("part", F.spark_partition_id())
    return dealt.sortWithinPartitions(*first, "part", *keys)


# ---------------------------------------------------------------- periods


def write_by_day(articles: DataFrame, folder: str, parts: int, block_bytes: int = 8 << 20) -> None:
    """Store articles (``published`` is a partial date) clustered by the first day that each may mean.

    A period wants rows whose first day is not after its end and whose last day is not before its start. Sorted by first
    day, the smallest first and the largest last day of each block of a file (its statistics) rule blocks out on both sides.
    Years and months are kept apart from days, or a few long intervals would stretch the last day of every block; unknown
    dates have a folder of their own."""
    span = F.when(F.col("published").isNull(), "unknown").when(F.length("published") == 4, "year").when(F.length("published") == 7, "month").otherwise("day")
    lo, hi = dates.range_lo(F.col("published"), literal=True), dates.range_hi(F.col("published"), literal=True)
    rows = articles.withColumns({"span": span, "first_day": lo, "last_day": hi})
    dealt = _ordered(rows, parts, [F.col("first_day"), F.col("last_day")], ("span",)).drop("part")
    dealt.write.option("parquet.block.size", block_bytes).partitionBy("span").parquet(folder)


def in_period(spark: SparkSession, folder: str, start: str | None, end: str | None) -> DataFrame:
    """The stored articles whose date overlaps a period of days (inclusive, either end may be missing), as ``dates.overlaps``
    has it; without a period all of them, unknown dates included."""
    rows = spark.read.parquet(folder)
    if start or end:
        rows = rows.where("span <> 'unknown'")
    if start:
        rows = rows.where(F.col("last_day") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("first_day") <= F.lit(end).cast("date"))
    return rows.drop("span", "first_day", "last_day")


def undated(spark: SparkSession, folder: str) -> DataFrame:
    """How many stored articles have no date: one row, ``n``; only their own folder is read."""
    return spark.read.parquet(folder).where("span = 'unknown'").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- pages


@dataclass(frozen=True)
class Directory:
    """A stored order: where its ranges are and how many rows lie before the end of each."""

    spark: SparkSession
    folder: str
    ends: list[int]

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def page(self, size: int, page: int) -> DataFrame:
        """The rows of a page, the page clamped to what there is; opens the ranges that it lies in, as a rule one."""
        _, _, start, end = page_bounds(self.total, size, page)
        first = bisect_right(self.ends, start)
        wanted = [k for k in range(first, len(self.ends)) if (self.ends[k - 1] if k else 0) < end]
        wanted = [k for k in wanted if self.ends[k] > (self.ends[k - 1] if k else 0)]
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*(f"{self.folder}/rows/part={k}" for k in wanted or self._some()))
        base = F.lit(0).cast("long")
        for k in wanted:
            base = F.when(F.col("part") == k, F.lit(self.ends[k - 1] if k else 0).cast("long")).otherwise(base)
        place = base + F.col("_metadata.row_index")
        return rows.withColumn("place", place).where((F.col("place") >= start) & (F.col("place") < end)).orderBy("place").drop("place", "part")

    def _some(self) -> list[int]:
        """A range to take the columns from where a page has no rows."""
        return [next((k for k, n in enumerate(self.ends) if n), 0)]


def write_pages(rows: DataFrame, keys: list[Column], folder: str, parts: int) -> Directory:
    """Store rows in the order of ``keys`` (which tell all rows apart), in ``parts`` ranges with one file each, and a directory of
    their sizes: as many numbers as ranges, counted from the files' footers."""
    _ordered(rows, parts, keys).write.option("maxRecordsPerFile", 0).partitionBy("part").parquet(f"{folder}/rows")
    counted = rows.sparkSession.read.parquet(f"{folder}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counted.coalesce(1).write.parquet(f"{folder}/sizes")
    return directory(rows.sparkSession, folder)


def directory(spark: SparkSession, folder: str) -> Directory:
    """The directory of a stored order; the sizes of its ranges come to the driver."""
    sizes = {r["part"]: r["n"] for r in spark.read.schema("part int, n long").parquet(f"{folder}/sizes").collect()}
    return Directory(spark, folder, list(accumulate(sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1))))
