"""Substring search by an index: posting lists of character trigrams, the rarest intersected, what is left verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import search as Q

#: Rows of a segment, the unit that posting lists are split by and texts are opened by.
SEGMENT_BITS = 12
#: Characters that a task turns into postings at a time.
CHARS = 4 << 20
#: Segments that may stand in a filter; with more, texts meet their segments by a join.
LISTED = 20_000

POSTINGS = "gram long, segment long, rows array<smallint>"


def gram_codes(text: str) -> set[int]:
    """Trigrams of a text, three characters of 21 bits each in a number."""
    points = [ord(c) for c in text]
    return {a << 42 | b << 21 | c for a, b, c in zip(points, points[1:], points[2:], strict=False)}


def _slices(text: str) -> Iterator[np.ndarray]:
    """Code points of a text in stretches that share two, so that no trigram is lost between them."""
    step = CHARS // 4
    for start in range(0, max(len(text) - 2, 0), step):
        yield np.frombuffer(text[start : start + step + 2].encode("utf-32-le"), "<u4").astype(np.int64)


def _postings(segment: int, rows: list[int], stretches: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Lists of ascending rows for each trigram of stretches of one segment's texts; ``rows`` tells whose each stretch is.

    Characters are numbered first: three numbers and the place of the row fit into one integer to sort. Where an alphabet
    is too large for that, stretches go one by one."""
    alphabet, digits = np.unique(np.concatenate(stretches), return_inverse=True)
    places, numbers = np.unique(np.array(rows, np.int16), return_inverse=True)
    bits, row_bits = max(int(len(alphabet) - 1).bit_length(), 1), int(len(places) - 1).bit_length()
    if 3 * bits + row_bits > 63:
        for row, stretch in zip(rows, stretches, strict=True):
            yield from _postings(segment, [row], [stretch])
        return
    lengths = np.array([len(s) for s in stretches])
    ends = np.cumsum(lengths)
    inside = np.ones(len(digits), bool)
    inside[np.concatenate([ends - 1, ends - 2])] = False
    at = np.flatnonzero(inside)
    owner = np.repeat(numbers, lengths)[at]
    keys = np.unique((((digits[at] << bits | digits[at + 1]) << bits | digits[at + 2]) << row_bits) | owner)
    grams, owner, mask = keys >> row_bits, keys & ((1 << row_bits) - 1), (1 << bits) - 1
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    first = grams[starts]
    code = alphabet[first >> 2 * bits] << 42 | alphabet[first >> bits & mask] << 21 | alphabet[first & mask]
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(places[owner]))
    for k in range(0, len(code), 50_000):
        n = min(50_000, len(code) - k)
        yield pa.RecordBatch.from_arrays([pa.array(code[k : k + n]), pa.array(np.full(n, segment)), lists.slice(k, n)], ["gram", "segment", "rows"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, stretches, held, segment = [], [], 0, None
    for batch in batches:
        for place, text in zip(batch["place"].to_pylist(), batch["text"], strict=True):
            if place >> SEGMENT_BITS != segment:
                if rows:
                    yield from _postings(segment, rows, stretches)
                rows, stretches, held, segment = [], [], 0, place >> SEGMENT_BITS
            for stretch in _slices(text.as_py() or ""):
                rows.append(place & ((1 << SEGMENT_BITS) - 1))
                stretches.append(stretch)
                held += len(stretch)
                if held >= CHARS:
                    yield from _postings(segment, rows, stretches)
                    rows, stretches, held = [], [], 0
    if rows:
        yield from _postings(segment, rows, stretches)


def write(rows: DataFrame, text: Column, folder: str, block_bytes: int = 16 << 20) -> None:
    """Index ``rows`` by a folded text (``search_text`` of articles, ``searchable`` of a column); all columns are stored.

    Texts are written where they are, with running numbers and no shuffle; 4,096 numbers are a segment. Postings are read off the
    written table, collected for each segment before they are shuffled, and clustered by trigram, so that a query opens the row
    groups of its own trigrams. A trigram that every text has is one list for each segment, spread over ranges by segment. Rows
    of a list ascend and are stored by their differences (Parquet's delta encoding). Null and empty texts, and those shorter
    than three characters, have no postings but are stored. ``place``, ``segment`` and ``indexed`` are the index's own names:
    columns of ``rows`` of these names are an error."""
    spark = rows.sparkSession
    if clash := {"place", "segment", "indexed"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns with names of the index: {sorted(clash)}")
    place = F.monotonically_increasing_id()
    numbered = rows.withColumn("indexed", text).withColumn("place", place).withColumn("segment", F.shiftright("place", SEGMENT_BITS))
    numbered.write.option("parquet.block.size", block_bytes).parquet(f"{folder}/texts")
    postings = _texts(spark, folder).select("place", F.col("indexed").alias("text")).mapInArrow(_each, POSTINGS)
    clustered = postings.repartitionByRange("gram", "segment").sortWithinPartitions("gram", "segment")
    options = {"parquet.block.size": block_bytes, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#rows.list.element": "false"}
    clustered.write.options(**options).parquet(f"{folder}/postings")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/texts")


def _lists(spark: SparkSession, folder: str, grams: list[int]) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("gram").isin(grams))


def find(spark: SparkSession, folder: str, q: str, most: int = 4) -> DataFrame:
    """Rows of the index whose text has all white-space separated terms of ``q``, as ``search.has_terms`` tells it.

    The lists' sizes come first (a number for each trigram of the request); up to ``most`` of the rarest lists, none of which
    is over 64 times the rarest one, are intersected row by row, and texts are opened where rows are left: segments in a filter
    that reaches the files up to 20,000 of them, a join beyond. All terms are looked for in the opened texts, so the index only
    ever saves reading. Terms of one or two characters have no trigram; a request of such terms alone reads every text."""
    terms = Q.folded_terms(q)
    texts = _texts(spark, folder)
    verified = texts.where(Q.has_terms(F.col("indexed"), q)).drop("place", "segment", "indexed")
    grams = sorted(set().union(*map(gram_codes, terms)))
    if not grams:
        return verified
    sizes = {r["gram"]: r["n"] for r in _lists(spark, folder, grams).groupBy("gram").agg(F.sum(F.size("rows")).alias("n")).collect()}
    if len(sizes) < len(grams):
        return verified.where(F.lit(False))
    rarest = sorted(grams, key=lambda g: (sizes[g], g))[:most]
    rarest = [g for g in rarest if sizes[g] <= 64 * sizes[rarest[0]]]
    held = _lists(spark, folder, rarest)
    if len(rarest) > 1:
        mark = reduce(lambda c, k: F.when(F.col("gram") == rarest[k], 1 << k).otherwise(c), range(len(rarest)), F.lit(0))
        each = held.select("segment", mark.alias("mark"), F.explode("rows").alias("row"))
        held = each.groupBy("segment", "row").agg(F.bit_or("mark").alias("marks")).where(F.col("marks") == (1 << len(rarest)) - 1)
    segments = held.select("segment").distinct()
    few = [r["segment"] for r in segments.limit(LISTED + 1).collect()]
    opened = texts.where(F.col("segment").isin(few)) if len(few) <= LISTED else texts.join(segments, "segment", "left_semi")
    return opened.where(Q.has_terms(F.col("indexed"), q)).drop("place", "segment", "indexed")


def search(spark: SparkSession, folder: str, f: Q.Filters) -> DataFrame:
    """``search.search`` over articles that were written with their ``search_text``."""
    return Q.search(find(spark, folder, f.q), replace(f, q=""))
