"""Hard-negative mining by distributed radix selection over scores.

An anchor is compared with all rows: the inner products of integer vectors are its scores. Its positives are the first
rows of its label; each positive opens a window of scores, and the first rows of other labels within it are wanted.

1. Anchors are written as a table that every task reads in blocks beside its own slice of rows; rows are never shuffled
   and no pairs are stored. Each slice tells its first rows of the anchor's label; the best of these are the positives.
2. For each window, slices count how far below the window's upper end the scores of other labels lie, by one digit at
   a time: first the highest, then, within the bucket that holds the wanted place, the next one. A slice tells buckets
   only up to the one in which its own count reaches the wanted place, since that bucket cannot lie behind it.
3. After the last digit the score of the wanted place is known. Slices gather the rows that reach it: fewer than the
   wanted number above it, and of ties as many of the smallest ids as could be needed.

Per window a round tells at most the wanted number of buckets for each slice, so memory and shuffle do not depend on how
rows are distributed; a third of all rows with one vector is one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_filesystem, lean, small_batches, work_dir, written

#: Rows of a slice, rows and anchors of a block of scores, bits of a digit.
SLICE, ROWS, ANCHORS, DIGIT = 1 << 16, 2048, 128, 8
#: Null ids come behind all others.
LAST = np.iinfo("i8").max


def vectors(table: DataFrame, label, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``n, vec_id, label, q``: rows that take part, numbered, with components ``floor(scale * x)`` as long.

    Rows with a null label, a null vector or any null or non-finite component take no part, nor do rows whose squared
    length does not fit into a long, since their scores would not either. ``label`` is a column.
    """
    x = F.col("x")
    scaled = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").alias("x"))
    # Components beyond 2^62 would saturate; the squares below are summed as doubles, far from any limit.
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(2.0**62 / scale)))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"), 2))
    rows = rows.where(square < F.lit(2.0**62))
    return rows.select(F.monotonically_increasing_id().alias("n"), "vec_id", "label", scaled.alias("q"))


class Block:
    """Rows or anchors of a block as arrays: number, id, label, and the vectors as a matrix, short ones padded by 0."""

    def __init__(self, n: pa.Array, ids: pa.Array, labels: pa.Array, q: pa.ListArray):
        self.n, self.labels = n.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        self.unknown = ids.is_null().to_numpy(zero_copy_only=False)
        values, sizes = q.flatten().to_numpy(zero_copy_only=False), q.value_lengths().to_numpy(zero_copy_only=False)
        width = int(sizes.max(initial=0))
        if (sizes == width).all():
            self.q = values.reshape(len(sizes), width)
        else:
            self.q = np.zeros((len(sizes), width), "i8")
            self.q[np.arange(width) < sizes[:, None]] = values
        self.norm = float(np.sqrt((self.q.astype("f8") ** 2).sum(axis=1).max(initial=0)))

    def cut(self, a: int, b: int) -> "Block":
        part = object.__new__(Block)
        part.__dict__ = {k: v[a:b] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return part

    def scores(self, rows: "Block") -> np.ndarray:
        """Inner products of each anchor with each row. No sum can exceed the product of the lengths; where that is
        below 2^53, doubles are exact, else integers are multiplied."""
        d = min(self.q.shape[1], rows.q.shape[1])
        a, b = self.q[:, :d], rows.q[:, :d]
        if self.norm * rows.norm < 2.0**52:
            return (a.astype("f8") @ b.astype("f8").T).astype("i8")
        return a @ b.T


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SLICE:
            yield _block(held)
            held, size = [], 0
    if size:
        yield _block(held)


def _block(batches: list) -> Block:
    table = pa.Table.from_batches(batches).combine_chunks()
    return Block(*(table[c].combine_chunks() for c in ("n", "vec_id", "label", "q")))


def anchor_blocks(folder: str) -> Iterator[tuple[Block, pa.Table]]:
    """The anchors of a written table, block by block, with all their columns."""
    where, root = arrow_filesystem(folder)
    if where.get_file_info(f"{root}/_SUCCESS").type != fs.FileType.File:
        raise FileNotFoundError(f"{folder} is not a finished table of anchors")
    for info in sorted(where.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as source:
                for batch in pq.ParquetFile(source).iter_batches(ANCHORS):
                    yield _block([batch]), pa.Table.from_batches([batch])


def first_places(score: np.ndarray, rows: Block, k: int) -> np.ndarray:
    """Places of the first ``k`` of some rows: higher scores, then smaller ids (null ids last), then numbers."""
    if len(score) > 4 * k:  # nothing below the k-th score can count
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
        if len(among) > 4 * k:  # of ties the smallest ids
            tied = among[score[among] == least]
            most = np.partition(rows.ids[tied], k - 1)[k - 1]
            among = np.concatenate([among[score[among] > least], tied[rows.ids[tied] <= most]])
    else:
        among = np.arange(len(score))
    order = np.lexsort((rows.n[among], rows.ids[among], rows.unknown[among], -score[among]))
    return among[order[:k]]


def _told(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    arrays = [np.concatenate(c) if c else np.zeros(0, "i8") for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names)


_FOUND = ["anchor", "window", "n", "vec_id", "score", "unknown"]


def _found(anchor: int, window: int, part: Block, at: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    same = np.ones(len(at), "i8")
    return [same * anchor, same * window, part.n[at], np.where(part.unknown[at], 0, part.ids[at]), score, part.unknown[at].astype("i8")]


def _merged_first(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    """The first ``k`` of what the blocks of a slice found for one window."""
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.lexsort((columns[2], columns[3], columns[5], -columns[4]))[:k]
    return [c[order] for c in columns]


def _best(folder: str, k: int):
    """For each anchor the first ``k`` other rows of its label in each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            for anchors, _ in anchor_blocks(folder):
                found: list[list] = [[] for _ in anchors.n]
                for a in range(0, len(rows.n), ROWS):
                    part = rows.cut(a, a + ROWS)
                    score = anchors.scores(part)
                    for i in range(len(anchors.n)):
                        at = np.flatnonzero((part.labels == anchors.labels[i]) & (part.n != anchors.n[i]))
                        at = at[first_places(score[i, at], _at(part, at), k)]
                        found[i].append(_found(anchors.n[i], 0, part, at, score[i, at]))
                yield _told(list(map(list, zip(*(_merged_first(f, k) for f in found)))), _FOUND)

    return run


def _at(rows: Block, at: np.ndarray) -> Block:
    part = object.__new__(Block)
    part.n, part.ids, part.unknown = rows.n[at], rows.ids[at], rows.unknown[at]
    return part


def _windows(table: pa.Table, i: int) -> list[dict]:
    return table["windows"][i].as_py()


def _counts(folder: str, shift: int):
    """For each window the counts of a digit of how far scores lie below its upper end, within the prefix found so far,
    up to the bucket in which the slice alone reaches the wanted place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            for anchors, table in anchor_blocks(folder):
                windows = [_windows(table, i) for i in range(len(anchors.n))]
                counts = {(i, w["window"]): np.zeros(1 << DIGIT, "i8") for i, ws in enumerate(windows) for w in ws}
                for a in range(0, len(rows.n), ROWS):
                    part = rows.cut(a, a + ROWS)
                    score = anchors.scores(part)
                    for i, ws in enumerate(windows):
                        other = score[i, part.labels != anchors.labels[i]]
                        for w in ws:
                            below = w["high"] - other[(other >= w["low"]) & (other <= w["high"])]
                            below = below[(below >> (shift + DIGIT)) == w["prefix"]]
                            counts[i, w["window"]] += np.bincount((below >> shift) & ((1 << DIGIT) - 1), minlength=1 << DIGIT)
                out: list[list] = [[], [], [], []]
                for i, ws in enumerate(windows):
                    for w in ws:
                        c = counts[i, w["window"]]
                        before = np.cumsum(c) - c
                        told = np.flatnonzero((c > 0) & (before < w["left"]))
                        for column, x in zip(out, (anchors.n[i] * np.ones(len(told), "i8"), w["window"] * np.ones(len(told), "i8"), told, c[told])):
                            column.append(x)
                yield _told(out, ["anchor", "window", "bucket", "rows"])

    return run


def _gathered(folder: str, k: int):
    """For each window the first ``k`` rows of other labels in each slice that reach the score of the wanted place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            for anchors, table in anchor_blocks(folder):
                windows = [_windows(table, i) for i in range(len(anchors.n))]
                found: dict = {(i, w["window"]): [] for i, ws in enumerate(windows) for w in ws}
                for a in range(0, len(rows.n), ROWS):
                    part = rows.cut(a, a + ROWS)
                    score = anchors.scores(part)
                    for i, ws in enumerate(windows):
                        other = part.labels != anchors.labels[i]
                        for w in ws:
                            at = np.flatnonzero(other & (score[i] >= w["high"] - w["prefix"]) & (score[i] <= w["high"]))
                            at = at[first_places(score[i, at], _at(part, at), k)]
                            if len(at):
                                found[i, w["window"]].append(_found(anchors.n[i], w["window"], part, at, score[i, at]))
                told = [_merged_first(f, k) for f in found.values() if f]
                yield _told(list(map(list, zip(*told))) or [[] for _ in _FOUND], _FOUND)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window, with their rank. Spark cuts each task's rows to ``k`` before the shuffle."""
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "unknown", "vec_id", "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_windows(anchors: DataFrame, windows: DataFrame, path: str) -> DataFrame:
    """Anchors that have windows, with the list of them: at most as many as an anchor has positives."""
    lists = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high", "prefix", "left"))).alias("windows"))
    return written(anchors.join(lists, anchors["n"] == lists["anchor"]).select("n", "vec_id", "label", "q", "windows"), path)


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    work: str,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: as ``vectors`` gives them; ``is_anchor``: a condition on them. An anchor's positives are its first
    ``positives`` other rows of its label; for each of them the first ``negatives`` rows of other labels whose score is
    between ``least`` and ``most`` percent of the positive's. Higher scores come first, ties by smaller id, null ids
    last, then by place in the table. Rows that repeat an id are rows of their own: another row with the anchor's id may
    be its positive, and anchors that repeat an id each have their own results. Vectors of different lengths are
    compared over the shorter one, which is as if zeros were added. Without anchors, positives or negatives: no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = written(rows, f"{work}/rows")
    anchors = written(rows.where(is_anchor), f"{work}/anchors")
    own = ", ".join(f"{c} long" for c in _FOUND)
    found = rows.mapInArrow(lean("hard_negatives", _best(f"{work}/anchors", positives)), own)
    chosen = _ranked(found, positives).select("anchor", F.col("rank").cast("long").alias("window"), F.when(F.col("unknown") == 0, F.col("vec_id")).alias("positive_id"), F.col("score").alias("positive_score"))
    # Percentages of hundreds and of what is left of them, since 100 times a score may not fit into a long.
    hundreds, left = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    low = hundreds * least + F.ceil(left * least / 100).cast("long")
    high = hundreds * most + F.floor(left * most / 100).cast("long")
    chosen = written(chosen.withColumns({"low": low, "high": high}), f"{work}/positives")
    windows = chosen.where("low <= high").select("anchor", "window", "low", "high", F.lit(0).cast("long").alias("prefix"), F.lit(negatives).cast("long").alias("left"))
    widest = windows.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    digits = max(1, -(-int(widest).bit_length() // DIGIT))
    for digit in reversed(range(digits)):
        folder = f"{work}/windows{digit}"
        _with_windows(anchors, windows, folder)
        counted = rows.mapInArrow(lean("hard_negatives", _counts(folder, DIGIT * digit)), "anchor long, window long, bucket long, rows long")
        counts = counted.groupBy("anchor", "window", "bucket").agg(F.sum("rows").alias("rows"))
        before = W.partitionBy("anchor", "window").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        # The bucket that holds the wanted place; the last one that has rows if there are fewer.
        placed = counts.join(windows, ["anchor", "window"]).where(F.col("before") < F.col("left"))
        last = placed.groupBy("anchor", "window").agg(F.max_by(F.struct("low", "high", "prefix", "left", "bucket", "before"), "bucket").alias("w"))
        windows = written(
            last.select(
                "anchor",
                "window",
                "w.low",
                "w.high",
                (F.col("w.prefix") * (1 << DIGIT) + F.col("w.bucket")).alias("prefix"),
                (F.col("w.left") - F.col("w.before")).alias("left"),
            ),
            f"{work}/placed{digit}",
        )
    _with_windows(anchors, windows, f"{work}/reached")
    gathered = rows.mapInArrow(lean("hard_negatives", _gathered(f"{work}/reached", negatives)), own)
    best = _ranked(gathered, negatives)
    named = anchors.select(F.col("n").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return best.join(chosen, ["anchor", "window"]).join(named, "anchor").select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.when(F.col("unknown") == 0, F.col("vec_id")).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op12_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(table, label), F.col("vec_id") % 100 == 0, work_dir(spark, "hard-negatives"))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS n
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.n AS anchor, r.vec_id, r.n, r.label = a.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a, r WHERE a.vec_id % 100 = 0 AND a.n <> r.n
), p AS (
  SELECT anchor, anchor_id, n AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
