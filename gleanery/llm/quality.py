"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms are word shapes (runs of lower case, upper case, digits and each punctuation mark, run lengths dropped), pairs
of neighbouring shapes, and repetition: words that repeat the word before, words and lines seen before in the text.
They are hashed into a fixed number of term places. On a bounded sample of labelled documents, inverse document
frequencies and a truncated singular value decomposition give the latent space; the labelled documents' unit vectors
in it and their labels are the model, whose size depends on parameters only. Every document of the table is then
projected, multiplied in blocks with all labelled vectors, which gives exact cosines, and its nearest neighbours vote
with weights that grow with similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import kept_by, lean, small_batches, work_dir, write_bytes
from gleanery.llm.substring_dedup import _mixed, _segment_hashes, _SPACE

#: Bounds of the model: labelled documents, hashed terms, dimensions of the latent space; neighbours that vote.
LABELLED, TERMS, DIMENSIONS, NEIGHBOURS = 4096, 2048, 64, 15
#: Documents of a block of cosines; with 4,096 labelled vectors its arrays take about 30 MB.
BLOCK = 256
#: Bytes of text whose terms are counted at once; a longer text is a group of its own.
GROUP_BYTES = 1 << 18
_CLASS = np.arange(256, dtype="u1")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _document_words(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word of a buffer in which documents end at ``ends``."""
    gap = np.r_[True, _SPACE[buf]]
    firsts = np.flatnonzero(gap[:-1] & ~gap[1:])
    return _segment_hashes(buf), np.searchsorted(ends, firsts, "right")


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries repeat an earlier one of the same document."""
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out = np.zeros(len(h), "?")
    out[order[1:][same]] = True
    return out


def _group_terms(texts: list[bytes], terms: int) -> np.ndarray:
    """Relative term counts of each text, one row for each; the last places are for repetition."""
    n, hashed = len(texts), terms - 16
    out = np.zeros((n, terms), "f4")
    buf = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
    ends = np.cumsum([len(t) + 1 for t in texts])
    shape = _CLASS[buf]
    fresh = np.r_[True, shape[1:] != shape[:-1]] | (buf == 10)
    kept = np.cumsum(fresh)
    h, doc = _document_words(shape[fresh], kept[ends - 1])
    words = np.bincount(doc, minlength=n)
    size = np.maximum(words, 1).astype("f4")
    place = [doc * terms + (h % np.uint64(hashed // 2)).astype("i8")]
    pair = doc[1:] == doc[:-1]
    both = _mixed(h[1:] * np.uint64(3) + h[:-1])[pair]
    place.append(doc[1:][pair] * terms + hashed // 2 + (both % np.uint64(hashed // 2)).astype("i8"))
    counts = np.bincount(np.concatenate(place), minlength=n * terms).reshape(n, terms)
    out[:] = np.sqrt(counts / size[:, None])
    raw, raw_doc = _document_words(buf, ends)
    follow = np.r_[False, (raw[1:] == raw[:-1]) & (raw_doc[1:] == raw_doc[:-1])]
    for k, mark in enumerate((follow, _again(raw_doc, raw))):
        out[:, hashed + k] = np.sqrt(np.bincount(raw_doc, mark, n) / np.maximum(np.bincount(raw_doc, minlength=n), 1))
    lines = np.flatnonzero(buf == 10)
    starts = np.r_[0, lines[:-1] + 1]
    full = lines > starts
    line_doc = np.searchsorted(ends, starts, "right")
    total = np.zeros(len(raw) + 1, "u8")
    np.cumsum(raw * (np.arange(len(raw), dtype="u8") * np.uint64(2) + np.uint64(1)), out=total[1:])
    gap = np.r_[True, _SPACE[buf]]
    firsts = np.flatnonzero(gap[:-1] & ~gap[1:])
    a, b = np.searchsorted(firsts, starts), np.searchsorted(firsts, lines)
    plain = np.zeros(len(raw) + 1, "u8")
    np.cumsum(raw, out=plain[1:])
    line = (total[b] - total[a]) - (plain[b] - plain[a]) * (a.astype("u8") * np.uint64(2))
    mark = _again(line_doc[full], line[full])
    out[:, hashed + 2] = np.sqrt(np.bincount(line_doc[full], mark, n) / np.maximum(np.bincount(line_doc[full], minlength=n), 1))
    out[:, hashed + 3] = words == 0
    return out


def term_rows(texts: list[str | None], terms: int = TERMS) -> np.ndarray:
    """Term vectors of texts; null counts as empty. Long texts are handled one by one."""
    encoded = [(t or "").encode("utf-8") for t in texts]
    parts, group, size = [], [], 0
    for t in encoded:
        if group and size + len(t) > GROUP_BYTES:
            parts.append(_group_terms(group, terms))
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        parts.append(_group_terms(group, terms))
    return np.concatenate(parts) if parts else np.zeros((0, terms), "f4")


@dataclass
class Model:
    """Term weights, the map into the latent space, and the labelled vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS
    prior: float = 0.5

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> "Model":
        """``rows``: term vectors of labelled documents. A randomised decomposition with a fixed seed."""
        if not len(rows):
            return cls(np.zeros(rows.shape[1], "f4"), np.zeros((rows.shape[1], 1), "f4"), np.zeros((0, 1), "f4"), np.zeros(0, "f4"))
        weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype("f4") + 1
        x = rows * weights
        d = min(dimensions, *x.shape)
        rng = np.random.default_rng(0)
        q = x @ rng.standard_normal((x.shape[1], min(d + 16, x.shape[1]))).astype("f4")
        for _ in range(4):
            q, _ = np.linalg.qr(q)
            q = x @ (x.T @ q)
        q, _ = np.linalg.qr(q)
        axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:d].T.astype("f4")
        return cls(weights, axes, unit(x @ axes), labels.astype("f4"), min(neighbours, len(rows)), float(labels.mean()))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity; the prior where none is similar."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        v = unit((rows * self.weights) @ self.axes)
        out = np.empty(len(v))
        for a in range(0, len(v), BLOCK):
            # Cosines to four places, ties by the order of the labelled vectors: the same whatever the block holds.
            cosine = np.rint(v[a : a + BLOCK] @ self.vectors.T * 1e4).astype("i4")
            rank = cosine * np.int64(len(self.labels)) - np.arange(len(self.labels))
            k = self.neighbours
            near = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < rank.shape[1] else np.tile(np.arange(k), (len(rank), 1))
            sim = (np.maximum(np.take_along_axis(cosine, near, 1), 0) / 1e4) ** 8
            total = sim.sum(axis=1)
            vote = (sim * self.labels[near]).sum(axis=1)
            out[a : a + BLOCK] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    labelled: int = LABELLED,
    terms: int = TERMS,
    dimensions: int = DIMENSIONS,
) -> Model:
    """Learn from ``labelled`` rows at most: of all labelled rows that may be learned from, those with the smallest
    hashes of their ids. Rows without an id, a text or a label of 0 or 1 teach nothing."""
    taught = labels.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").cast("int").alias("label"),
    ).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    chosen = taught.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # At most ``labelled`` rows of two integers: the size of this broadcast is a parameter.
    rows = texts.join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                body = [r.astype("f2").tobytes() for r in term_rows(part.column(1).to_pylist(), terms)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(body, pa.binary())], ["id", "label", "row"])

    got = rows.mapInArrow(lean("quality", run), f"id {rows.schema['id'].dataType.simpleString()}, label int, row binary")
    # Ids may repeat: the bound holds for rows before any of them reaches the driver.
    got = got.orderBy("id", "label", "row").limit(labelled).toPandas()
    matrix = np.frombuffer(b"".join(map(bytes, got["row"])), "f2").reshape(-1, terms).astype("f4")
    return Model.fit(matrix, got["label"].to_numpy("f4"), dimensions)


_MODELS: dict[str, Model] = {}
kept_by("quality", _MODELS.clear)


def _model(name: str) -> Model:
    if name not in _MODELS:
        _MODELS.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _MODELS[name] = pickle.load(f)
    return _MODELS[name]


def scored(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    threshold: float = 0.7,
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """All columns of ``docs`` with a score (0 to 1, higher: label 1 likelier) and a prediction (1 from ``threshold``
    on), which take the place of columns of the same ``names``. Null texts count as empty. Nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    work = work_dir(spark, "quality")
    name = work.rsplit("/", 1)[1] + ".bin"
    write_bytes(spark, f"{work}/{name}", pickle.dumps(model))
    spark.sparkContext.addFile(f"{work}/{name}")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in names))
    at = docs.columns.index(text_col)
    columns = [f"c{k}" for k in range(len(docs.columns))]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema)) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                score = np.clip(model.scores(term_rows(part.column(at).to_pylist(), len(model.weights))), 0, 1)
                extra = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype("i4"), pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*columns, "score", "predicted"])

    return docs.toDF(*columns).mapInArrow(lean("quality", run), schema).toDF(*docs.columns, *names)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, "quality")
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
