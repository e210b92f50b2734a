"""Exact dedup: stateful streaming over an arrival log, with a disk-backed state that never expires.

The state store (RocksDB) holds, for each content digest, the smallest stable identifier seen, the locator (file and
row) of that row's content and the number of arrivals. Later arrivals of a known digest are hits; their full
normalised bytes are read through both locators and compared, and rows that differ in spite of equal digests are
grouped again by their bytes. Lists of locators are bits by file and block of rows, so only the texts of hits move,
however many there are. Only DataFrame, SQL and Structured Streaming operators are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import listed, located, row_bits, settings, work_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty. Single spaces are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def retained(arrivals: DataFrame) -> DataFrame:
    """Per digest the row to keep and the number of rows; batch or streaming (update mode), state kept for ever."""
    return arrivals.groupBy("digest").agg(F.min("arrival").alias("keep"), F.count(F.lit(1)).alias("n"))


def state_of(spark: SparkSession, log: str, schema, work: str, bytes_per_batch: int) -> DataFrame:
    """Run the stream over the log until it has caught up, then read its state: digest, keep, n."""
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="64",
        spark__sql__streaming__stateStore__rocksdb__writeBufferSizeMB="2",
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
        spark__sql__streaming__stateStore__maintenanceInterval="10s",
        spark__sql__streaming__noDataMicroBatches__enabled="false",
    ):
        arrivals = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(log)
        query = (
            retained(arrivals)
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", work)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(work)
        keep, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
        return written(state.select("key.digest", F.expr(keep).alias("keep"), F.expr(n).alias("n")), f"{work}-table")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    bytes_per_batch: int = 1 << 34,
    locate: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` (with ``locate``: ``file, row``).

    Texts are equal if identical after ``normalised``; null texts count as empty. Of equal texts the row with the
    smallest id stays; a null id is larger than any other, and rows that repeat an id are told apart by file and row
    number, so exactly one row of a group is kept. An empty table gives no rows. Extra columns are left behind.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "exact")
    rows = located(docs, id_col, text_col, f"{work}/docs")
    id_type = rows.schema["id"].dataType
    norm = normalised(F.col("text"))
    log = written(
        rows.select(
            F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row").alias("arrival"),
            digest(norm).alias("digest"),
            F.sha2(norm.cast("binary"), 256).alias("sha"),
        ).select("arrival", "digest", F.when(F.lower(F.hex("digest")) != F.col("sha"), F.col("sha")).alias("sha")),
        f"{work}/log",
    )
    state = state_of(spark, f"{work}/log", log.schema, f"{work}/state", bytes_per_batch)
    # A fresh row number for the join of log and state: digest is the only shared name.
    joined = log.join(state, "digest").select("arrival", "digest", "sha", "keep", "n")

    members = written(joined.where("n > 1").select("digest", "arrival", (F.col("arrival") == F.col("keep")).alias("is_keep")), f"{work}/members")
    differ = _differing(rows, members, norm, digest, work)
    if differ is not None:
        # Equal digests, different bytes: such rows form groups of their own, by digest and full text.
        regrouped = differ.groupBy("digest", "text").agg(F.min("arrival").alias("keep2"), F.count(F.lit(1)).alias("n2"))
        own = differ.join(regrouped, ["digest", "text"]).select("digest", "arrival", "keep2", "n2")
        lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        joined = (
            joined.join(own, ["digest", "arrival"], "left")
            .join(lost, "digest", "left")
            .withColumn("keep", F.coalesce("keep2", "keep"))
            .withColumn("n", F.coalesce("n2", F.col("n") - F.coalesce("lost", F.lit(0))))
        )
    return joined.select(
        F.col("arrival.id").cast(id_type).alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("arrival") == F.col("keep")).alias("kept"),
        F.coalesce("sha", F.lower(F.hex("digest"))).alias("text_sha256"),
        *([F.col("arrival.file").alias("file"), F.col("arrival.row").alias("row")] if locate else []),
    )


def _differing(rows: DataFrame, members: DataFrame, norm: Column, digest, work: str) -> DataFrame | None:
    """Hits whose full bytes differ from those of the row that their digest retains; None if there is none.

    Both sides are read through their locators and meet by digest; a digest's kept row is one, and Spark splits the
    hits of a digest with very many of them."""

    def read(kept: bool) -> DataFrame:
        named = members.where(F.col("is_keep") == kept).select("arrival.file", "arrival.row")
        bits = written(row_bits(named), f"{work}/{'kept' if kept else 'hits'}")
        arrival = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row").alias("arrival")
        # Never null, so that no test for null is pushed down to rows that are not listed.
        known = F.coalesce(digest(norm), F.lit(b""))
        return listed(rows, bits).select(known.alias("digest"), arrival, norm.alias("text"))

    kept = read(True).select("digest", F.col("text").alias("kept_text"))
    differ = written(read(False).join(kept, "digest").where("text <> kept_text").drop("kept_text"), f"{work}/differ")
    return differ if differ.count() else None


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""
