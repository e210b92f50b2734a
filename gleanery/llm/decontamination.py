"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``window`` words. A document word is hit if any occurrence of a window covers
it. A window is a set of word shingles; a document that holds the window holds all of them, so with containment 1 the
necessary prefix is a single shingle, and the rarest serves best:

1. Probe: one pass over the documents keeps the occurrences of shingles that any window has, with their positions.
2. Order: occurrences give each shingle's frequency; each window's rarest shingle is its prefix.
3. Join: occurrences of prefixes name the one place where the window can lie; the window must begin at or after the
   document's first word and end at or before its last (positional and length bound).
4. Verify: the document's words there must equal the window's, word by word.

Documents are named by file and row number, so repeated and null ids are told apart. Placements carry numbers of
windows; words and items come to them where they are needed. The list of documents to read again is bits by file and
block of rows, so no other texts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import listed, located, row_bits, small, work_dir, written

#: A word is a run of digits, ASCII letters and all characters beyond ASCII. Listing these, instead of
#: negating the rest, is many times faster in Java.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WORD_ANY_CASE = r"[0-9a-zA-Z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5
#: Rows of a broadcast table of windows (under 300 bytes each); beyond, Spark shuffles. A benchmark does not grow with
#: the documents.
BROADCAST_WINDOWS = 60_000


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; ``lower`` does that for pure ASCII and is many times faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once for each row; the optimizer would copy it into inner lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingles(ws: Column, sizes: list[int]) -> Column:
    """Array of (pos, h, n) over the runs of each of ``sizes`` words; n is the number of words. ``ws`` is bound."""
    none = F.array().cast("array<struct<pos:int,h:bigint,n:int>>")

    def of(size: int) -> Column:
        hashed = lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get(ws, i + k) for k in range(size)]).alias("h"),
            F.size(ws).alias("n"),
        )
        return F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), hashed)).otherwise(none)

    return F.concat(*map(of, sizes)) if sizes else none


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: ``wid, ws, size, items``, to be written before use, which fixes the numbers; an item of fewer words, but not none, is one window."""
    items = benchmark.select(
        F.col(f"`{id_col}`").cast("string").alias("item"),
        words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("all"),
    ).withColumn("n", F.size("all")).where("n > 0")
    starts = items.select(
        "item",
        "all",
        F.least("n", F.lit(window)).alias("size"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))).alias("at"),
    )
    cut = starts.select("item", F.slice("all", F.col("at"), F.col("size")).alias("ws"))
    return cut.groupBy("ws").agg(F.collect_set("item").alias("items")).select(
        F.monotonically_increasing_id().alias("wid"),
        "ws",
        F.size("ws").alias("size"),
        "items",
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated``, and the
    row's ``file`` and ``row``.

    Null texts have no words; items without words have no windows; equal items all count; an empty benchmark leaves
    every document clean; an empty table gives no rows. ``items`` are the ids, as strings, in string order; windows of
    items without an id hit words, but count for no item.
    """
    spark = docs.sparkSession
    work = work_dir(spark, "decontam")
    rows = located(docs, id_col, text_col, f"{work}/docs").withColumns({"k": F.xxhash64("file", "row"), "k2": F.hash("file", "row")})
    text = F.coalesce(F.col("text"), F.lit(""))

    windows = written(benchmark_windows(benchmark, window, item_id_col, item_text_col), f"{work}/windows")
    sizes = sorted(r["s"] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("s")).distinct().collect())
    tokens = windows.select("wid", "ws", "size").withColumn("s", F.least("size", F.lit(SHINGLE)))
    per_size = [tokens.where(F.col("s") == s).select("wid", F.inline(shingles(F.col("ws"), [s]))) for s in sizes]
    tokens = written(_union(per_size, spark.createDataFrame([], "wid long, pos int, h long, n int")).drop("n"), f"{work}/tokens")

    probes = rows.select("k", "k2", "file", "row", F.inline(bound(words(text), lambda ws: shingles(ws, sizes))))
    wanted = written(tokens.select("h").distinct(), f"{work}/wanted")
    found = written(probes.join(small(wanted, 10 * BROADCAST_WINDOWS), "h"), f"{work}/found")

    seen = found.groupBy("h").agg(F.count(F.lit(1)).alias("seen"))
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "pos"))
    prefix = tokens.join(seen, "h", "left").groupBy("wid").agg(rarest.alias("p")).where("p.seen > 0")
    prefix = prefix.select("wid", F.col("p.h").alias("h"), F.col("p.pos").alias("offset"))
    prefix = written(prefix.join(windows, "wid").select("h", "offset", "wid", "size"), f"{work}/prefix")

    start = F.col("pos") - F.col("offset")
    placed = found.join(small(prefix, BROADCAST_WINDOWS), "h").where((start >= 0) & (start + F.col("size") <= F.col("n")))
    grouped = written(
        placed.groupBy("k", "k2").agg(
            F.collect_set(F.struct(start.alias("start"), "size", "wid")).alias("at"),
            F.first("file").alias("file"),
            F.first("row").alias("row"),
        ),
        f"{work}/candidates",
    )
    bits = written(row_bits(grouped), f"{work}/listed")
    read = listed(rows, bits).select("k", "k2", "text").join(grouped.select("k", "k2", "at"), ["k", "k2"])
    cut = lambda r: F.transform(
        r["at"],
        lambda c: F.struct(c["start"].alias("start"), c["wid"].alias("wid"), F.slice(r["all"], c["start"] + 1, c["size"]).alias("part")),
    )
    parts = read.select("k", "k2", F.inline(bound(F.struct(words(text).alias("all"), "at"), cut)))
    sure = parts.join(
        small(windows.select("wid", "ws", "size"), BROADCAST_WINDOWS),
        "wid",
    ).where("part = ws").select("k", "k2", "start", "size", "wid")
    sure = written(sure, f"{work}/sure")
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))
    n_hit = sure.groupBy("k", "k2").agg(F.size(covered).cast("long").alias("n_hit"))
    item = windows.select("wid", F.explode("items").alias("item"))
    named = sure.select("k", "k2", "wid").distinct().join(item, "wid").groupBy("k", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = n_hit.join(named, ["k", "k2"], "left")

    counted = rows.select("id", "file", "row", "k", "k2", F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(hits, ["k", "k2"], "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "file",
        "row",
    )


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    for p in parts:
        empty = empty.unionByName(p)
    return empty


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contamination(read("documents"), read("benchmark")).drop("items", "file", "row")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), i AS (
  SELECT item_id, ws, least(10, len(ws)) AS size FROM b WHERE len(ws) > 0
), w AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[s : s + size - 1], ' ') AS w FROM (SELECT *, unnest(range(1, CAST(len(ws) - size + 2 AS BIGINT))) AS s FROM i)
), dw AS (
  SELECT doc_id, s, size, array_to_string(ws[s : s + size - 1], ' ') AS w
  FROM (SELECT doc_id, ws, size, unnest(range(1, CAST(len(ws) - size + 2 AS BIGINT))) AS s FROM d, (SELECT DISTINCT size FROM w))
), hit AS (
  SELECT doc_id, s, size, item_id FROM dw JOIN w USING (size, w)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
