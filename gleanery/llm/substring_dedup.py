"""Substring dedup through fixed-block anchors.

A window of ``window`` words that occurs twice holds, wherever its first occurrence lies, a whole block of
``window // 2`` words that starts at a multiple of that length. So non-overlapping blocks of every document form the
reference index, every rolling window of block length probes it, and only around hits can long repeats lie:

1. Each chunk (a run of rows of one file) sends the hashes of its blocks and of all its rolling windows to buckets of
   hashes. A bucket knows which blocks occur more than once and tells each chunk which of its hashes these are.
2. Around these anchors a chunk extends to whole windows and sends digests of their words with document ids to buckets.
   A bucket knows the smallest document of each digest and answers where a smaller one exists.
3. Each chunk marks the windows that were answered; a run of marked windows is a maximal exact repeat. Its words go.

Rolling hashes only choose which windows are looked at: what they take for equal is compared by a 128-bit BLAKE2b
digest of the words themselves, so no text goes that does not repeat. Texts never leave their scan. Hashes travel as
packed arrays, once for each chunk, so a passage that very many documents share costs a bucket one entry for each
chunk. Buckets grow in number with the table, and a task holds one at a time. Answers come back as ``answers.Table``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import answers
from gleanery.llm.common import kept_by, lean, located, small_batches, work_dir

#: Bytes of text hashed at once, and bytes of a digest of words.
SEGMENT, DIGEST = 1 << 20, 16
#: Fixed odd multipliers of the rolling hashes: bytes, words (anchors), words (windows).
BYTES, ANCHOR, WINDOW = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SPACE = np.zeros(256, "?")
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
kept_by("hashes", _POWERS.clear)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) and their inverses modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, "u8"), np.full(size, pow(base, -1, 1 << 64), "u8")
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _segment_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a byte buffer, in order."""
    gap = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].view("i1")))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(BYTES, len(buf) + 1)
    total = np.zeros(len(buf) + 1, "u8")
    np.cumsum((buf.astype("u8") + np.uint64(1)) * up[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return _mixed(h ^ ((ends - starts).astype("u8") * np.uint64(0xA24BAED4963EE407)))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space; long texts are cut at white space."""
    if len(text) <= 2 * SEGMENT:
        return _segment_hashes(np.frombuffer(text, "u1"))
    buf, parts, at = np.frombuffer(text, "u1"), [], 0
    while at < len(buf):
        end = min(len(buf), at + SEGMENT)
        while end < len(buf) and not _SPACE[buf[end]]:
            end += 1
        parts.append(_segment_hashes(buf[at:end]))
        at = end
    return np.concatenate(parts)


def rolling(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words: len(words) - size + 1 of them, none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    up, down = _powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, "u8")
    np.cumsum(words * up[: len(words)], out=total[1:])
    return _mixed((total[size:] - total[:n]) * down[:n])


class Chunk:
    """Consecutive documents of one chunk, as one sequence of words with the places where documents start."""

    def __init__(self, ids: list, texts: list, window: int):
        self.window, self.block = window, window // 2
        self.ids = np.array([np.iinfo("i8").max if i is None else i for i in ids], "i8")
        self.texts = encoded = [b"" if t is None else t.encode("utf-8") for t in texts]
        parts, group, size = [], [], 0
        counts: list[int] = []
        for t in encoded:
            group.append(t)
            size += len(t)
            if size >= SEGMENT:
                parts.append(self._hashes(group, counts))
                group, size = [], 0
        parts.append(self._hashes(group, counts))
        self.words = np.concatenate(parts)
        self.bounds = np.cumsum([0, *counts])
        self.doc = np.repeat(np.arange(len(ids)), counts)

    @staticmethod
    def _hashes(group: list[bytes], counts: list[int]) -> np.ndarray:
        if len(group) == 1 or any(len(t) > SEGMENT for t in group):
            parts = [word_hashes(t) for t in group]
            counts += map(len, parts)
            return np.concatenate(parts) if parts else np.zeros(0, "u8")
        if not group:
            return np.zeros(0, "u8")
        # One pass over all; a line feed between documents keeps words apart.
        buf = np.frombuffer(b"\n".join(group), "u1")
        gap = np.r_[True, _SPACE[buf]]
        firsts = np.flatnonzero(gap[:-1] & ~gap[1:])
        ends = np.cumsum([len(t) + 1 for t in group])
        counts += np.diff(np.searchsorted(firsts, np.r_[0, ends])).tolist()
        return _segment_hashes(buf)

    def runs(self, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes and their starts, of the runs that lie within one document."""
        h = rolling(self.words, size, base)
        inside = np.flatnonzero(self.doc[: len(h)] == self.doc[size - 1 : size - 1 + len(h)])
        return h[inside], inside

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of whole windows, and their starts."""
        return self.runs(self.window, WINDOW)

    def digests(self, start: np.ndarray, digest) -> np.ndarray:
        """Digests of the words, one space between them, of the windows that begin at ``start`` (ascending): two 64-bit
        halves each."""
        out = []
        for k, a, b in _cut(self.doc[start]):
            words = self.texts[k].split()
            ends = np.cumsum([len(w) + 1 for w in words])
            body, first = b" ".join(words), start[a:b] - self.bounds[k]
            begins, stops = np.r_[0, ends][first].tolist(), (ends[first + self.window - 1] - 1).tolist()
            out += [digest(body[x:y]) for x, y in zip(begins, stops)]
        return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)

    def near(self, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the window starts ``at`` have an anchor inside; ``anchors`` are starts of anchored blocks."""
        mark = np.zeros(len(self.words) + 1, "i4")
        mark[anchors + 1] = 1
        seen = np.cumsum(mark)
        return seen[at + self.window - self.block + 1] > seen[at]


def strong(words: bytes) -> bytes:
    """The digest by which windows are compared."""
    return hashlib.blake2b(words, digest_size=DIGEST).digest()


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and a 32-bit rest of each hash, as one number."""
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _cut(group: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal values of a sorted array: value, first place, end."""
    edges = np.flatnonzero(np.diff(group)) + 1
    return [(int(group[a]), int(a), int(b)) for a, b in zip(np.r_[0, edges], np.r_[edges, len(group)])] if len(group) else []


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[tuple, Chunk]]:
    """Key and documents of each chunk, as far as a batch holds it."""
    for batch in batches:
        for key, a, b in answers.chunks_of(batch):
            yield key, Chunk(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), window)


def _sent(key: tuple, bucket: list[int], names: list[str], columns: list[list[bytes]]) -> pa.RecordBatch:
    """Rows for buckets, with the chunk that they come from."""
    place = [pa.array([v] * len(bucket), t) for v, t in zip(key[1:], (pa.int64(), pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays(
        [*place, pa.array(bucket, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)],
        [*answers.KEY, "bucket", *names],
    )


def _rest(key: np.ndarray) -> bytes:
    return (key & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _u4(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u4")


def _u8(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<u8")


def _send_anchors(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk in _chunks(batches, window):
            h, at = chunk.runs(chunk.block, ANCHOR)
            aligned = (at - chunk.bounds[chunk.doc[at]]) % chunk.block == 0 if len(at) else np.zeros(0, "?")
            keys = _keys(h, buckets)
            key, count = np.unique(keys, return_counts=True)
            out = {k: [_rest(key[a:b]), b"", b""] for k, a, b in _cut(key >> np.uint64(32))}
            for part, slot in ((key[count > 1], 1), (np.unique(keys[aligned]), 2)):
                for k, a, b in _cut(part >> np.uint64(32)):
                    out[k][slot] = _rest(part[a:b])
            if out:
                yield _sent(name, list(out), ["all", "twice", "blocks"], [[v[i] for v in out.values()] for i in range(3)])

    return run


def _told(rows: list[dict], names: list[str], columns: list[list], kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Answers to the chunks that ``rows`` came from."""
    place = [pa.array([r[c] for r in rows], t) for c, t in zip(answers.KEY, (pa.int64(), pa.int32(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*place, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*answers.KEY, *names])


def _repeated_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in answers.by_bucket(batches):
        value, count = np.unique(_u4([r["all"] for r in rows]), return_counts=True)
        twice = np.union1d(value[count > 1], _u4([r["twice"] for r in rows]))
        known = np.intersect1d(twice, _u4([r["blocks"] for r in rows]))
        hits = [np.intersect1d(_u4([r["all"]]), known, assume_unique=True) for r in rows]
        to = [(r, h) for r, h in zip(rows, hits) if len(h)]
        yield _told([r for r, _ in to], ["bucket", "hits"], [[r["bucket"] for r, _ in to], [h.tobytes() for _, h in to]], [pa.int32(), pa.binary()])


def _send_windows(window: int, buckets: int, table: answers.Table, digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = answers.Reader(table)
        for name, chunk in _chunks(batches, window):
            told = reader.of(*name)
            if not told:
                continue
            known = np.unique(np.concatenate([np.uint64(r["bucket"] << 32) | _u4([r["hits"]]).astype("u8") for r in told]))
            h, at = chunk.runs(chunk.block, ANCHOR)
            anchors = at[np.isin(_keys(h, buckets), known)]
            h, start = chunk.windows()
            near = chunk.near(anchors, start)
            key, start = _keys(h[near], buckets), start[near]
            two, ids = chunk.digests(start, digest), chunk.ids[chunk.doc[start]]
            order = np.lexsort((ids, two[:, 1], two[:, 0], key))
            key, two, ids = key[order], two[order], ids[order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (two[1:] != two[:-1]).any(axis=1) | (ids[1:] != ids[:-1])] if len(key) else np.zeros(0, "?")
            key, two, ids = key[fresh], two[fresh], ids[fresh]
            cuts = _cut(key >> np.uint64(32))
            if cuts:
                columns = [[_rest(key[a:b]) for _, a, b in cuts], [two[a:b].tobytes() for _, a, b in cuts], [_narrow(ids[a:b]) for _, a, b in cuts]]
                yield _sent(name, [k for k, *_ in cuts], ["rest", "two", "ids"], columns)

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as a base and differences of 32 bits where these suffice, else whole."""
    base = ids.min()
    if int(ids.max()) - int(base) < 1 << 32:
        return base.astype("<i8").tobytes() + (ids - base).astype("<u4").tobytes()
    return base.astype("<i8").tobytes() + ids.astype("<i8").tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(packed, "<i8", 1)
    if len(packed) == 8 + 4 * n:
        return np.frombuffer(packed, "<u4", n, 8).astype("i8") + base
    return np.frombuffer(packed, "<i8", n, 8)


def _smallest_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in answers.by_bucket(batches):
        sizes = [len(r["rest"]) // 4 for r in rows]
        two = _u8([r["two"] for r in rows]).reshape(-1, 2)
        ids = np.concatenate([_wide(r["ids"], n) for r, n in zip(rows, sizes)])
        order = np.lexsort((ids, two[:, 1], two[:, 0]))
        sorted_, i = two[order], ids[order]
        first = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(axis=1)]
        least = np.empty(len(order), "i8")
        least[order] = i[np.flatnonzero(first)[np.cumsum(first) - 1]]
        to, at = [], 0
        for r, n in zip(rows, sizes):
            own = np.flatnonzero(least[at : at + n] < ids[at : at + n])
            if len(own):
                rest, x, y = _u4([r["rest"]])[own], two[at + own], least[at + own]
                fresh = np.r_[True, (x[1:] != x[:-1]).any(axis=1)]
                to.append((r, rest[fresh].tobytes(), x[fresh].tobytes(), y[fresh].astype("<i8").tobytes()))
            at += n
        yield _told(
            [t[0] for t in to],
            ["bucket", "rest", "two", "least"],
            [[t[0]["bucket"] for t in to], *([t[k] for t in to] for k in (1, 2, 3))],
            [pa.int32(), *[pa.binary()] * 3],
        )


def _marked(chunk: Chunk, told: list[dict], buckets: int, digest) -> np.ndarray:
    """Starts of the windows that also start in a smaller document."""
    key = np.concatenate([np.uint64(r["bucket"] << 32) | _u4([r["rest"]]).astype("u8") for r in told])
    two, least = _u8([r["two"] for r in told]).reshape(-1, 2), np.frombuffer(b"".join(r["least"] for r in told), "<i8")
    h, start = chunk.windows()
    start = start[np.isin(_keys(h, buckets), key)]
    own, ids = chunk.digests(start, digest), chunk.ids[chunk.doc[start]]
    both = np.concatenate([two, own])
    _, group = np.unique(both.view("V16").ravel(), return_inverse=True)
    smallest = np.full(group.max() + 1, np.iinfo("i8").max)
    np.minimum.at(smallest, group[: len(two)], least)
    return start[smallest[group[len(two) :]] < ids]


def _removed(window: int, buckets: int, table: answers.Table, digest, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = answers.Reader(table)
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for name, chunk in _chunks(iter([batch]), window):
                told = reader.of(*name)
                gone = np.zeros(len(chunk.words) + 1, "i4")
                if told:
                    start = _marked(chunk, told, buckets, digest)
                    np.add.at(gone, start, 1)
                    np.subtract.at(gone, start + window, 1)
                kept = np.cumsum(gone[:-1]) == 0
                for k, text in enumerate(chunk.texts):
                    flags = kept[chunk.bounds[k] : chunk.bounds[k + 1]]
                    ws = text.split()
                    rest = ws if flags.all() else [w for w, f in zip(ws, flags.tolist()) if f]
                    body = b" ".join(rest)
                    n_words.append(len(ws))
                    n_removed.append(len(ws) - len(rest))
                    digests.append(hashlib.sha256(body).hexdigest())
                    if keep:
                        texts.append(body.decode("utf-8"))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * keep, names + ["text"] * keep)

    return run


def substring_dedup(
    docs: DataFrame,
    window: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
    digest=strong,
    buckets: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` (with ``keep``: the kept ``text``).

    A word goes if it is covered by a window whose words also start in a document with a smaller id. Null texts have
    no words. A null id counts as larger than any other; rows with equal ids, repeats among them, do not remove each
    other's words. An empty table gives no rows; extra columns are left behind. Ids are integers. ``digest`` maps the
    bytes of a window's words to 16 bytes; windows are equal where these are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = work_dir(spark, "substring")
    rows = located(docs, id_col, text_col, f"{work}/docs")
    buckets = buckets or answers.buckets_for(rows)
    rows = answers.chunked(rows.withColumn("id", rows["id"].cast("long")))
    key = "fh long, fh2 int, no long, bucket int"
    step = lambda df, f, schema: df.mapInArrow(lean("substring_dedup", f), schema)

    sent = step(rows, _send_anchors(window, buckets), f"{key}, all binary, twice binary, blocks binary")
    anchors = answers.write(step(answers.dealt(sent), _repeated_blocks, f"{key}, hits binary"), f"{work}/anchors")
    sent = step(rows, _send_windows(window, buckets, anchors, digest), f"{key}, rest binary, two binary, ids binary")
    repeats = answers.write(step(answers.dealt(sent), _smallest_documents, f"{key}, rest binary, two binary, least binary"), f"{work}/repeats")
    return step(
        rows,
        _removed(window, buckets, repeats, digest, keep),
        "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep,
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, CAST(greatest(len(ws) - 48, 1) AS BIGINT))) AS s FROM d)
), m AS (
  SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM w JOIN m USING (h) WHERE first < doc_id
), g AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), x AS (
  SELECT doc_id, ws, list_filter(range(1, CAST(len(ws) + 1 AS BIGINT)), lambda i: NOT coalesce(list_contains(ps, i), false)) AS kept FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_select(ws, kept), ' '), '')) AS kept_sha256
FROM x
"""
