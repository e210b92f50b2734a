"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines ends a chunk wherever it meets a fixed pattern, so boundaries
depend on nearby lines only: lines put in before a passage do not move the boundaries inside it. Chunks of several
lines that occur again anywhere in the corpus are removed; the first occurrence, by document id, stays.

1. Each part (a run of rows of one file) sends the digests of its chunks to buckets of digests, each once; a bucket
   tells each part which of them occur more than once in the corpus.
2. For those only, a part sends the chunks' bytes, each once, with the place of its own first occurrence. A bucket
   compares the bytes, since equal digests prove nothing, and answers with the first place in the corpus.
3. Each part leaves out the chunks whose first place is elsewhere.

Digests and bytes travel once for each part, however many copies it holds, so no hot chunk fills a task. Buckets grow
in number with the table, and a task holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import answers
from gleanery.llm.common import lean, located, small_batches, work_dir
from gleanery.llm.substring_dedup import _cut, _sent, _told, _u8, rolling

#: Lines the rolling hash sees, one boundary in so many places, and lines of a chunk at least and at most.
WINDOW, ONE_IN, LEAST, MOST = 2, 2, 2, 64
BASE = 0xC2B2AE3D27D4EB4F


def chunk_ends(hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of a document, from its lines' hashes; the last one is the number of lines."""
    n = len(hashes)
    marks = (np.flatnonzero(rolling(hashes, WINDOW, BASE) % np.uint64(ONE_IN) == 0) + WINDOW).tolist()
    ends, start = [], 0
    for end in [*marks, n]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST or end == n > start:
            ends.append(end)
            start = end
    return ends


class Document:
    """A text's lines and chunks. ``chunks``: (number, first line, end, bytes) of those that may be removed: several
    lines, not all of them blank."""

    def __init__(self, text: str | None):
        body = (text or "").encode("utf-8")
        self.lines = body.split(b"\n") if body else []
        self.ends = chunk_ends(np.fromiter(map(xxhash.xxh64_intdigest, self.lines), "u8", len(self.lines)))
        pairs = zip([0, *self.ends], self.ends)
        self.chunks = [(k, a, b, c) for k, (a, b) in enumerate(pairs) if b - a > 1 and (c := b"\n".join(self.lines[a:b])).strip()]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, int, int, Document]]]]:
    """Key of each part and its documents as (id, file key, row, document)."""
    last = np.iinfo("i8").max
    for batch in batches:
        ids, row = batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("row")).to_pylist()
        for key, a, b in answers.chunks_of(batch):
            texts = batch.column(1).slice(a, b - a).to_pylist()
            yield key, [(last if i is None else i, key[1], r, Document(t)) for i, r, t in zip(ids[a:b], row[a:b], texts)]


def _send_digests(digest, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, docs in _parts(batches):
            values, counts = np.unique(np.array([digest(c) for *_, d in docs for *_, c in d.chunks], "u8"), return_counts=True)
            cuts = _cut(values >> np.uint64(65 - buckets.bit_length()))
            if cuts:
                yield _sent(
                    name,
                    [k for k, *_ in cuts],
                    ["all", "twice"],
                    [[values[a:b].tobytes() for _, a, b in cuts], [values[a:b][counts[a:b] > 1].tobytes() for _, a, b in cuts]],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in answers.by_bucket(batches):
        values, counts = np.unique(_u8([r["all"] for r in rows]), return_counts=True)
        again = np.union1d(values[counts > 1], _u8([r["twice"] for r in rows]))
        hits = [(r, h.tobytes()) for r in rows if len(h := np.intersect1d(_u8([r["all"]]), again, assume_unique=True))]
        yield _told([r for r, _ in hits], ["hits"], [[h for _, h in hits]], [pa.binary()])


def _send_bytes(digest, buckets: int, table: answers.Table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = answers.Reader(table)
        for name, docs in _parts(batches):
            known = set(_u8([r["hits"] for r in reader.of(*name)]).tolist())
            first: dict[bytes, tuple] = {}
            for id_, f, r, d in docs:
                for k, _, _, c in d.chunks:
                    if digest(c) in known:
                        first[c] = min(first.get(c, (id_, f, r, k)), (id_, f, r, k))
            if first:
                batch = _sent(name, [digest(c) >> 65 - buckets.bit_length() for c in first], ["body"], [list(first)])
                for j, column in enumerate(PLACE):
                    batch = batch.append_column(column, pa.array([v[j] for v in first.values()], pa.int64()))
                yield batch

    return run


#: Columns of the place of a chunk of lines: document, file, row, number.
PLACE = ["id", "at_fh", "at_row", "k"]


def _first_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in answers.by_bucket(batches):
        first: dict[bytes, tuple] = {}
        for r in rows:  # the dictionary compares whole bytes
            place = tuple(r[c] for c in PLACE)
            first[r["body"]] = min(first.get(r["body"], place), place)
        places = [first[r["body"]] for r in rows]
        keys = [hashlib.blake2b(r["body"], digest_size=20).digest() for r in rows]
        yield _told(rows, ["key", *PLACE], [keys, *([p[j] for p in places] for j in range(4))], [pa.binary(), *[pa.int64()] * 4])


def _kept(table: answers.Table, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = answers.Reader(table)
        for batch in batches:
            n_lines, n_chunks, n_removed, digests, texts = [], [], [], [], []
            for name, docs in _parts(iter([batch])):
                first = {r["key"]: tuple(r[c] for c in PLACE) for r in reader.of(*name)}
                for id_, f, r, d in docs:
                    gone = [(a, b) for k, a, b, c in d.chunks if first and first.get(hashlib.blake2b(c, digest_size=20).digest(), (id_, f, r, k)) != (id_, f, r, k)]
                    lines, at = [], 0
                    for a, b in gone:
                        lines += d.lines[at:a]
                        at = b
                    body = b"\n".join(lines + d.lines[at:])
                    n_lines.append(len(d.lines))
                    n_chunks.append(len(d.ends))
                    n_removed.append(sum(b - a for a, b in gone))
                    digests.append(hashlib.sha256(body).hexdigest())
                    if keep:
                        texts.append(body.decode("utf-8"))
            columns = [
                batch.column(0),
                pa.array(n_lines, pa.int64()),
                pa.array(n_chunks, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(digests, pa.string()),
            ]
            names = ["doc_id", "n_lines", "n_chunks", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * keep, names + ["text"] * keep)

    return run


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
    digest=xxhash.xxh64_intdigest,
    buckets: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_chunks, n_removed`` (lines) and ``kept_sha256`` of the kept
    lines joined by line feeds (with ``keep``: the kept ``text``).

    Null and empty texts have no lines. Of equal chunks of several lines the one in the document with the smallest id
    stays, in it the first; null ids are larger than any other, and rows with equal ids are ordered by file and row.
    Chunks of one line or of blank lines only always stay. An empty table gives no rows; extra columns are left
    behind. Ids are integers."""
    spark = docs.sparkSession
    small_batches(spark)
    work = work_dir(spark, "lines")
    rows = located(docs, id_col, text_col, f"{work}/docs")
    buckets = buckets or answers.buckets_for(rows)
    rows = answers.chunked(rows.withColumn("id", rows["id"].cast("long")))
    step = lambda df, f, schema: df.mapInArrow(lean("line_dedup", f), schema)
    key, place = "fh long, fh2 int, no long", ", ".join(f"{c} long" for c in PLACE)
    sent = step(rows, _send_digests(digest, buckets), f"{key}, bucket int, all binary, twice binary")
    hits = answers.write(step(answers.dealt(sent), _repeated, f"{key}, hits binary"), f"{work}/hits")
    sent = step(rows, _send_bytes(digest, buckets, hits), f"{key}, bucket int, body binary, {place}")
    first = answers.write(step(answers.dealt(sent), _first_places, f"{key}, key binary, {place}"), f"{work}/first")
    return step(rows, _kept(first, keep), "doc_id long, n_lines long, n_chunks long, n_removed long, kept_sha256 string" + ", text string" * keep)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
