"""Shared plumbing of the training-data operators: work folders, written tables, Hadoop file access, row identity."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors share. Results are computed
    lazily from what operators keep there, so it goes when the driver ends.

    Only where driver and executors are one process (unit tests) may the setting be absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/gleanery-work"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def arrow_filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it. Names of Hadoop's connectors are translated; one that
    Arrow does not know is an error."""
    for hadoop in ("s3a://", "s3n://"):
        uri = "s3://" + uri.removeprefix(hadoop) if uri.startswith(hadoop) else uri
    return pa.fs.FileSystem.from_uri(uri)


#: Rows of an Arrow batch: texts are long, and each running task holds a batch or two on both sides.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at ``BATCH_ROWS`` rows or fewer. Spark reads the setting when a result is
    computed, which is after an operator returns, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Hadoop's file system layer, wherever ``path`` points."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the duration of a block; names are given with ``__`` for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def has_locator(docs: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, so that file and row number name each of them."""
    if "_metadata" in docs.columns:
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def located(docs: DataFrame, id_col: str, text_col: str, work: str) -> DataFrame:
    """Columns ``id``, ``text``, ``file``, ``row``: every row with a locator that re-reading it gives again.

    Rows that do not come straight from files are written to ``work`` first; other columns are left behind.
    """
    if not has_locator(docs):
        docs = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), work)
        id_col, text_col = "id", "text"
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``max_rows`` rows at most, else as it is (Spark then shuffles it).

    ``df`` must be a written table, so that counting it reads only footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def from_files(docs: DataFrame, work: str) -> DataFrame:
    """``docs`` itself if its rows have locators, else a copy written to ``work`` whose rows have."""
    return docs if has_locator(docs) else written(docs, work)


#: Bytes of a block of a list of rows, and the share of the memory of executors and driver that a broadcast list may
#: take. Beyond it, Spark joins list and rows by file and block.
BLOCK_BYTES, BROADCAST_SHARE = 4096, 64


def broadcast_blocks(spark: SparkSession) -> int:
    """Blocks that a broadcast list may have: of 16 GB executors and driver 65,536, for 2.1 billion rows."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    conf = spark.sparkContext.getConf()
    least = min(size(conf.get(k, "1g")) for k in ("spark.executor.memory", "spark.driver.memory"))
    return least // BROADCAST_SHARE // BLOCK_BYTES


def row_bits(listed_rows: DataFrame, row: str = "row") -> DataFrame:
    """``file, block, bits``: the rows named by ``file`` and ``row``, a bit for each of the 32,768 rows of a block."""
    at = F.col(row)
    return listed_rows.groupBy("file", F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def listed(rows: DataFrame, bits: DataFrame, row: str = "row", within: bool = True, file: str = "file") -> DataFrame:
    """The rows of ``rows`` that the written table ``bits`` of ``row_bits`` names (or, not ``within``, the others).

    A list costs one bit for each row of the blocks that it touches, however many rows it names. Up to
    ``broadcast_blocks`` of 32,768 rows each no text of other rows is shuffled.
    """
    bits = bits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    bits = F.broadcast(bits) if bits.count() <= broadcast_blocks(bits.sparkSession) else bits
    at = f"cast(bitmap_bit_position(`{row}`) as int)"
    hit = F.expr(f"coalesce((cast(conv(hex(substring(__bits, shiftright({at}, 3) + 1, 1)), 16, 10) as int) & shiftleft(1, {at} & 7)) <> 0, false)")
    near = rows.join(bits, (F.col(file) == F.col("__file")) & (F.bitmap_bucket_number(F.col(row)) == F.col("__block")), "inner" if within else "left")
    return near.where(hit if within else ~hit).drop("__file", "__block", "__bits")


def without(docs: DataFrame, gone: DataFrame, work: str) -> DataFrame:
    """The rows of ``docs``, which come straight from files, that ``gone`` (``file, row``) does not name."""
    bits = written(row_bits(gone), work)
    rows = docs.select("*", F.col("_metadata.file_path").alias("__at"), F.col("_metadata.row_index").alias("__row"))
    return listed(rows, bits, "__row", within=False, file="__at").select(*(F.col(f"`{c}`") for c in docs.columns))


#: How to empty what each operator keeps in a Python worker between tasks.
_KEPT: dict[str, list[Callable[[], object]]] = {}


def kept_by(operator: str, *empty: Callable[[], object]) -> None:
    """Register what empties an operator's caches."""
    _KEPT.setdefault(operator, []).extend(empty)


@lru_cache(1)
def _libc():
    """The C library, told once in each worker to map blocks of 128 kB and more on their own, so that arrays go back
    to the system when they are freed; Arrow allocates through it too. Null where there is no glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 128 << 10)  # M_MMAP_THRESHOLD: fixed, else it grows with what is freed
        libc.mallopt(-8, 1)  # M_ARENA_MAX
    except OSError:
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return libc


def trim() -> None:
    """Give freed memory back to the system; the allocator would keep it for this worker."""
    gc.collect()
    if libc := _libc():
        libc.malloc_trim(0)


def _only(operator: str) -> None:
    for name, empty in _KEPT.items():
        if name != operator:
            for e in empty:
                e()
    trim()


def lean(operator: str, run):
    """``run`` for mapInArrow or mapInPandas in a worker that is reused: what other operators keep in it goes first,
    and freed memory goes back to the system when a task ends."""

    def wrapped(batches):
        _only(operator)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
