"""Answers to chunks: tables that a later pass over the texts looks up as it reads, without a shuffle of the texts.

A chunk is a run of rows of one file. Answers are written in parts, one folder for each value of a hash of the chunk,
sorted by chunk, so there are as many folders as shuffle partitions, whatever the number of chunks, and parts are even
however rows are spread over files; a task opens the part of a chunk and reads the row groups that it needs. A part
without answers has no folder; a table that was never finished is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_filesystem

#: Rows of a chunk, and bytes of a row group of answers.
CHUNK_ROWS, GROUP_BYTES = 1024, 1 << 20
#: Columns that name a chunk.
KEY = ["fh", "fh2", "no"]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part(n: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")


def chunked(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id, text, fh, fh2, no, part, row`` of rows with locators: which chunk each belongs to, and the part of its
    answers."""
    named = rows.select(
        "id",
        "text",
        F.xxhash64("file").alias("fh"),
        F.hash("file").alias("fh2"),
        F.floor(F.col("row") / chunk_rows).alias("no"),
        "row",
    )
    return named.select("id", "text", "fh", "fh2", "no", part(parts(rows.sparkSession)).alias("part"), "row")


def buckets_for(rows: DataFrame, least: int = 1024, most: int = 1 << 16, each: int = 4096) -> int:
    """A power of two: how many buckets hashes go to, growing with the rows of a table (counted from file footers)."""
    wanted = rows.count() // each
    return min(most, max(least, 1 << max(0, wanted - 1).bit_length()))


@dataclass(frozen=True)
class Table:
    """Where answers are."""

    folder: str


def write(df: DataFrame, folder: str) -> Table:
    """Write answers: ``fh, fh2, no`` and what is told."""
    spark = df.sparkSession
    n = parts(spark)
    placed = df.withColumn("part", part(n)).repartition(n, "part").sortWithinPartitions("part", *KEY)
    placed.write.option("parquet.block.size", GROUP_BYTES).partitionBy("part").parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    qualified = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return Table(qualified)


class Reader:
    """Looks up one chunk after another; keeps the part and the answer that were asked for last."""

    def __init__(self, table: Table):
        self.where, self.root = arrow_filesystem(table.folder)
        if self.where.get_file_info(f"{self.root}/_SUCCESS").type != fs.FileType.File:
            raise FileNotFoundError(f"{table.folder} is not a finished table of answers")
        self.part, self.files, self.key, self.rows = None, [], None, []

    def _open(self, number: int) -> None:
        for f in self.files:
            f.close()
        self.part, self.files = number, []
        found = self.where.get_file_info(fs.FileSelector(f"{self.root}/part={number}", allow_not_found=True))
        for info in sorted(found, key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                self.files.append(pq.ParquetFile(self.where.open_input_file(info.path)))

    def table(self, number: int, *key: int) -> list[pa.Table]:
        """Row groups' rows that answer the chunk ``key`` (``fh, fh2, no``) of part ``number``."""
        if number != self.part:
            self._open(number)
        out = []
        for f in self.files:
            columns = [f.schema_arrow.get_field_index(c) for c in KEY]
            for g in range(f.metadata.num_row_groups):
                bounds = [f.metadata.row_group(g).column(c).statistics for c in columns]
                if all(b is None or not b.has_min_max or b.min <= k <= b.max for b, k in zip(bounds, key)):
                    got = f.read_row_group(g)
                    hit = pc.and_(pc.and_(pc.equal(got["fh"], key[0]), pc.equal(got["fh2"], key[1])), pc.equal(got["no"], key[2]))
                    out.append(got.filter(hit))
        return out

    def of(self, number: int, *key: int) -> list[dict]:
        if (number, key) != self.key:
            self.key = (number, key)
            self.rows = [r for t in self.table(number, *key) for r in t.to_pylist()]
        return self.rows


def chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int, int], int, int]]:
    """(part, fh, fh2, no) of each chunk of a batch of ``chunked`` rows, with its first row and its end."""
    keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", *KEY))))
    a = 0
    for b in range(1, len(keys) + 1):
        if b == len(keys) or keys[b] != keys[a]:
            yield keys[a], a, b
            a = b


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after another, of batches in the order of ``bucket``: a task holds one bucket at a time."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["bucket"] != rows[0]["bucket"]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def dealt(sent: DataFrame) -> DataFrame:
    """Rows with a ``bucket``, each bucket in one task, in the order of buckets."""
    n = parts(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket")
