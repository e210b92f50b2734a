"""Token ids as binary files: fixed-size id blocks, transposed into bit or byte planes, each compressed on its own.

A file holds consecutive documents in ascending id order:

    magic | planes of block 0 | planes of block 1 | ... | document table | footer | footer length | magic

A block has ``block_ids`` ids (the last one fewer). Its planes are the ids' bytes (``byte``: all lowest bytes, then
all second bytes ...) or bits (``bit``), most of them nearly constant for the upper planes, compressed with zstandard.
The footer is JSON: width, planes and, for each block, its offset, number of ids and the length of each plane, so a
reader can seek to any id. Files are written under a name of the attempt and renamed at the end, so a task that is
repeated after a lost executor leaves exactly one whole file.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_filesystem, kept_by, lean, small_batches, work_dir, written
from gleanery.llm.pieces import SPACES, plain, slices, tokenizer

MAGIC = b"IDPLANE1"
#: Characters given to the library at once, and documents of a batch that is read back.
BATCH_CHARS, ROWS_OUT = 1 << 20, 8192
#: Files that a task reads back, on average.
FILES_A_TASK = 8
#: Fixed value: white space in a row that tiktoken may be given; it fails beyond about a million.
MAX_SPACES = 100_000
_SPACES = re.compile(f"[{SPACES}]+")


@cache
def ranked(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file, once in each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


kept_by("token_output", ranked.cache_clear)


def short_spaces(text: str) -> bool:
    """Whether no run of white space is longer than ``MAX_SPACES``."""
    return len(text) <= MAX_SPACES or all(m.end() - m.start() <= MAX_SPACES for m in _SPACES.finditer(text))


def encoded(path: str, texts: list[str], ranks: str | None = None) -> list[bytes]:
    """The ids of each text as the tokenizers library gives them, as little-endian 32-bit bytes.

    ``ranks`` may name the same vocabulary as a rank file. Texts made of plain characters only, where both libraries
    split alike and no special token can occur, without very long white space, are then encoded from it, which gives the same ids in a third of the
    time; all others go to the tokenizers library.
    """
    out: list = [None] * len(texts)
    if ranks:
        fast = ranked(ranks).encode_ordinary
        for i, t in enumerate(texts):
            if plain(t) and short_spaces(t):
                out[i] = np.array(fast(t), "<u4").tobytes()
    rest = [i for i, x in enumerate(out) if x is None]
    for a, b in slices([len(texts[i]) for i in rest], BATCH_CHARS):
        for i, e in zip(rest[a:b], tokenizer(path).encode_batch([texts[i] for i in rest[a:b]], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first: ``width`` byte planes, or ``8 * width`` bit planes."""
    octets = ids.astype("<u4").view("u1").reshape(-1, 4)[:, :width]
    if not bits:
        return [octets[:, k].tobytes() for k in range(width)]
    return [p.tobytes() for p in np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), "u1")
    if bits:
        rows = np.unpackbits(np.frombuffer(b"".join(planes), "u1").reshape(8 * width, -1), axis=1, count=n)
        out[:, :width] = np.packbits(rows.T, axis=1, bitorder="little")
    else:
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, "u1")
    return out.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; memory is one block and the document table."""

    def __init__(self, sink, width: int, bits: bool, block_ids: int, level: int = 3):
        self.sink, self.width, self.bits, self.block_ids = sink, width, bits, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.blocks, self.pending, self.held = len(MAGIC), [], [], 0
        self.ids: list = []
        self.counts: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block_ids:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) // self.block_ids * self.block_ids if whole else len(ids)
        for a in range(0, end, self.block_ids):
            block = ids[a : a + self.block_ids]
            if block.size and int(block.max()) >> 8 * self.width:
                raise ValueError(f"an id does not fit into {self.width} bytes")
            planes = [self.pack(p) for p in to_planes(block, self.width, self.bits)]
            self.blocks.append([self.at, len(block), [len(p) for p in planes]])
            for p in planes:
                self.at += self.sink.write(p) or len(p)
        self.pending, self.held = [ids[end:].tobytes()], 4 * (len(ids) - end)

    def close(self) -> None:
        self._flush(whole=False)
        known = np.array([x is not None for x in self.ids], "?")
        table = self.pack(np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + known.tobytes())
        self.sink.write(table)
        footer = json.dumps(
            {
                "width": self.width,
                "planes": "bit" if self.bits else "byte",
                "blocks": self.blocks,
                "table": [self.at, len(table)],
                "docs": len(self.ids),
            }
        ).encode()
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class PlaneReader:
    """Reads a file written by ``PlaneWriter``; ``source`` can seek."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        tail = self._bytes(size - 16, 16)
        if tail[8:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("not a whole plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.footer = json.loads(self._bytes(size - 16 - n, n))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, lengths = self.footer["blocks"][k]
        data, ends = self._bytes(at, sum(lengths)), np.cumsum([0, *lengths]).tolist()
        planes = [self.unpack(data[a:b]) for a, b in zip(ends, ends[1:])]
        return from_planes(planes, n, self.footer["width"], self.footer["planes"] == "bit")

    def table(self) -> tuple[list, list[int]]:
        n = self.footer["docs"]
        data = self.unpack(self._bytes(*self.footer["table"]))
        ids, known = np.frombuffer(data, "<i8", n).tolist(), np.frombuffer(data, "?", n, 16 * n).tolist()
        return [i if k else None for i, k in zip(ids, known)], np.frombuffer(data, "<u8", n, 8 * n).tolist()

    def documents(self) -> Iterator[tuple[object, np.ndarray]]:
        """(id, ids) of each document in order; holds one document and one block."""
        held, k = np.zeros(0, "<u4"), 0
        for doc_id, n in zip(*self.table()):
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            ids = np.concatenate(parts) if len(parts) > 1 else held
            held = ids[n:]
            yield doc_id, ids[:n]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    planes: str = "byte",
    width: int = 2,
    block_ids: int = 1 << 16,
    ranks: str | None = None,
) -> DataFrame:
    """Encode and write all texts in ascending id order; returns the manifest, one row per file.

    ``file, first_id, first_tie, n_docs, n_ids``. Texts are spread by ranges of ids, and of places in the table where
    ids repeat or are null, over as many files as the session has shuffle partitions, so no id fills a file of its own.
    Null texts are empty, null ids come first, rows of one id in the order of the table. An empty table gives no file.
    """
    small_batches(docs.sparkSession)
    filesystem, root = arrow_filesystem(folder)
    filesystem.create_dir(root)
    bits = planes == "bit"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = arrow_filesystem(folder)
        name = uuid.uuid4().hex
        sink = writer = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first = first if writer else batch.column(2)[0].as_py()
            for a in range(0, batch.num_rows, 256):
                part = [t or "" for t in texts.slice(a, 256).to_pylist()]
                for doc_id, body in zip(ids.slice(a, 256).to_pylist(), encoded(tokenizer_path, part, ranks)):
                    if writer is None:
                        sink = where.open_output_stream(f"{path}/.{name}")
                        writer = PlaneWriter(sink, width, bits, block_ids)
                    writer.add(doc_id, body if end_id is None else body + end_id.to_bytes(4, "little"))
        if writer is not None:
            writer.close()
            sink.close()
            where.move(f"{path}/.{name}", f"{path}/{name}.ids")
            row = {
                "file": [f"{name}.ids"],
                "first_id": [writer.ids[0]],
                "first_tie": [first],
                "n_docs": [len(writer.ids)],
                "n_ids": [sum(writer.counts)],
            }
            yield pa.RecordBatch.from_pydict(row, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in list(row)[1:])]))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    spread = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie")
    return spread.mapInArrow(lean("token_output", write), "file string, first_id long, first_tie long, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: ``doc_id, start, n_tokens, ids_crc32``, from the files alone; ``manifest`` names and orders them."""

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    told = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = arrow_filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["base"], []
                with where.open_input_file(f"{path}/{row['file']}") as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(out) == ROWS_OUT:
                            yield told(out)
                            out = []
                if out:
                    yield told(out)

    # One row for each file: as many as shuffle partitions.
    before = W.orderBy(F.col("first_id").asc_nulls_first(), "first_tie", "file").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(max(1, n // FILES_A_TASK)).mapInArrow(lean("token_output", read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    work = work_dir(spark, "planes")
    folder = f"{work}/files"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(
        docs,
        folder,
        public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2,
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    manifest = written(files, f"{work}/manifest")
    return read_token_files(manifest, folder)
