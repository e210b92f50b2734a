"""Sharding by jump consistent hashing, in SQL expressions only.

Jump consistent hashing (Lamping and Veach, 2014) walks a 64-bit linear congruential generator seeded with the key;
each step says at which shard count the key would move next. Adding a shard moves rows only into the new one. The
generator's product modulo 2^64 is computed in 32-bit halves, since 64-bit products overflow under ANSI arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
MASK32 = 0xFFFFFFFF


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def key_halves(key: Column) -> tuple[Column, Column]:
    """The upper and lower 32 bits of a stable 64-bit key: the first 16 hex digits of md5 of the id as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _advanced(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, each product below 2^49."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & MASK32
    low16, mask = 0xFFFF, _lit(MASK32)

    def mod32(x: Column, c: int) -> Column:  # x * c modulo 2^32 for 32-bit x and c
        upper = F.shiftleft((x * _lit(c >> 16)).bitwiseAND(_lit(low16)), 16)
        return (x * _lit(c & low16) + upper).bitwiseAND(mask)

    t0, t1 = lo * _lit(c_lo & low16), lo * _lit(c_lo >> 16)
    low = t0 + F.shiftleft(t1.bitwiseAND(_lit(low16)), 16) + _lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(t1, 16)
    return (carry + mod32(hi, c_lo) + mod32(lo, c_hi)).bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hash(hi: Column, lo: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a key given as two 32-bit halves.

    A key takes about ln(shards) + 1 steps, never more than ``shards``. The fold has room for far more than the
    expected number; the rare key that is not done by then takes the fold of full length.
    """

    def walk(steps: int) -> Column:
        start = F.struct(_lit(-1).alias("b"), _lit(0).alias("j"), hi.alias("hi"), lo.alias("lo"))

        def step(s: Column, _: Column) -> Column:
            n_hi, n_lo = _advanced(s["hi"], s["lo"])
            divisor = (F.shiftright(n_hi, 1) + _lit(1)).cast("double")
            jump = F.floor((s["j"] + _lit(1)).cast("double") * (F.lit(float(1 << 31)) / divisor)).cast("long")
            moved = F.struct(s["j"].alias("b"), jump.alias("j"), n_hi.alias("hi"), n_lo.alias("lo"))
            return F.when(s["j"] < _lit(shards), moved).otherwise(s)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    room = 16 + 8 * math.ceil(math.log(shards + 1))
    short = walk(min(room, shards))
    if room >= shards:
        return short["b"].cast("int")
    return F.when(short["j"] >= _lit(shards), short["b"]).otherwise(walk(shards)["b"]).cast("int")


#: Slices of a shard at least, and rows that a slice has on average at most.
SLICES, SLICE_ROWS = 64, 1 << 20
#: Numbers of rows alike in id and text that are written out together.
RUN = 1 << 16


def slices_for(rows: int, shards: int) -> int:
    """A power of two that grows with the table: each slice is numbered by one task."""
    return max(SLICES, 1 << math.ceil(math.log2(max(1.0, rows / (shards * SLICE_ROWS)))))


def shard(docs: DataFrame, shards: int = 16, slices: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The id and the shard count alone decide (law ``key``); a null id is a key of its own. ``size`` is the text's UTF-8
    bytes plus 1, a null text has none. ``slot`` numbers the rows of a shard from 0 without gaps: each shard is cut
    into ``slices`` by a hash (``slices_for`` the table, counted from file footers, unless given), slices are numbered
    in parallel, and a sum over at most ``shards * slices`` counts gives each its base. Rows that repeat an id and a
    text are counted before the shuffle and written out again as so many numbers, so no copy of them is sorted; the
    numbers come in runs of ``RUN``, which are dealt to tasks of their own. Texts never leave the scan. An empty table gives no rows; extra columns are left behind.
    """
    from pyspark.sql import Window as W

    slices = slices or slices_for(docs.count(), shards)
    hi, lo = key_halves(F.col(f"`{id_col}`"))
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = (
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.length(body).cast("long") + _lit(1)).alias("size"),
            F.crc32(body).alias("text_crc32"),
            hi.alias("hi"),
            lo.alias("lo"),
        )
        .select(
            "doc_id",
            "size",
            "text_crc32",
            jump_hash(F.col("hi"), F.col("lo"), shards).alias("shard"),
            jump_hash(F.col("hi"), F.col("lo"), shards + 1).alias("grown_shard"),
            F.pmod(F.col("lo") + F.col("text_crc32"), _lit(slices)).alias("slice"),
        )
    )
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    alike = rows.groupBy("shard", "slice", "doc_id", "text_crc32", "size", "grown_shard").agg(F.count(F.lit(1)).alias("copies"))
    within = W.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    numbered = alike.withColumn("place", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    placed = numbered.join(F.broadcast(bases), ["shard", "slice"]).withColumn("first", F.col("base") + F.col("place"))
    runs = placed.withColumn("run", F.explode(F.sequence(_lit(0), F.floor((F.col("copies") - 1) / RUN))))
    runs = runs.repartition("doc_id", "text_crc32", "run")
    begin = F.col("first") + F.col("run") * RUN
    return runs.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(begin, F.least(begin + RUN, F.col("first") + F.col("copies")) - 1)).alias("slot"),
        "grown_shard",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_sql(shards: int = 16) -> str:
    """DuckDB has no crc32: it is folded over the bytes, eight bit steps for each. The walk is a recursive query."""
    return f"""
WITH RECURSIVE s AS (
  SELECT greatest({SLICES}, CAST(pow(2, ceil(log2(greatest(1.0, count(*) / {float(shards * SLICE_ROWS)})))) AS BIGINT)) AS slices FROM documents
), k AS (
  SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents
), bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([CAST(b AS BIGINT)], CAST(range(8) AS BIGINT[])),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), c AS (
  SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size,
    CAST(('0x' || substr(m, 1, 8)) AS BIGINT) AS hi, CAST(('0x' || substr(m, 9, 8)) AS BIGINT) AS lo,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, CAST(strlen(t) AS BIGINT) + 1), lambda i: CAST(('0x' || substr(hex(encode(t)), 2 * i - 1, 2)) AS BIGINT))),
      lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) AS text_crc32
  FROM k, bits
), walk AS (
  SELECT n.n, doc_id, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, CAST(hi AS HUGEINT) * 4294967296 + lo AS key
  FROM c, (VALUES ({shards}), ({shards + 1})) n(n)
  UNION ALL
  SELECT n, doc_id, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((key2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT), key2
  FROM (SELECT *, (key * {MULTIPLIER} + 1) % 18446744073709551616 AS key2 FROM walk WHERE j < n)
), placed AS (
  SELECT doc_id, CAST(max(b) FILTER (n = {shards}) AS INTEGER) AS shard, CAST(max(b) FILTER (n = {shards + 1}) AS INTEGER) AS grown_shard
  FROM walk GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (lo + text_crc32) % (SELECT slices FROM s), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM c JOIN placed USING (doc_id)
"""
