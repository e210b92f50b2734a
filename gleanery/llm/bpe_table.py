"""BPE through a table of distinct words: each distinct word is encoded once, ids are joined back by position.

1. A pass over all texts splits them and writes the distinct words of each bucket, a run of rows of one file. A grouping
   in Spark leaves every word of the corpus once, with the number of buckets that have it.
2. The words are encoded, each once, into the word table.
3. A second pass joins ids to the words of each text by position. Word frequencies are very uneven, so a shuffle by
   word would send a large part of all positions to one task. Instead the words of most buckets, up to a fixed number
   of table bytes, go to every worker; they cover nearly all positions. The others are joined with the buckets that
   have them, one row for each bucket and word, and written in one folder for each bucket; a task that reads texts in
   file order opens the buckets it comes to. Texts themselves are never shuffled.
4. Decoding joins each id to its piece; the vocabulary, of fixed size, is at hand in every worker.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import answers
from gleanery.llm.common import kept_by, lean, located, small_batches, trim, work_dir, write_bytes, written
from gleanery.llm.pieces import WORDS, plain, slices, tokenizer

#: Bytes of the shared part of the word table.
SHARED_BYTES = 24 << 20
#: Distinct words that a task holds before it passes them on, and rows of a bucket.
TASK_WORDS, BUCKET_ROWS = 400_000, 2048
#: Words that the splitting rule finds again when they are strung together with spaces.
_JOINABLE = re.compile("[a-zß-öø-ÿ]+")


def words_of(text: str, path: str) -> list[str]:
    """The pieces of a text under the word vocabulary's splitting rule, special tokens included as pieces.

    A plain text is lower-cased and split here. Any other goes through the library's own normaliser and splitter,
    part by part around special tokens, which are matched before normalising.
    """
    if plain(text):
        return WORDS.findall(text.lower())
    specials, normalizer, splitter = parts_of(path)
    parts = specials.split(text) if specials else [text]
    out: list[str] = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(part)
        elif part:
            norm = normalizer.normalize_str(part)
            out += [norm[a:b] for _, (a, b) in splitter.pre_tokenize_str(norm)]
    return out


@cache
def parts_of(path: str):
    """What splitting needs of a tokenizer: a pattern of its special tokens (longest first) or null, its normaliser and
    its splitter. The vocabulary, by far the larger part, is let go."""
    t = Tokenizer.from_file(path)
    found = sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)
    out = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None, t.normalizer, t.pre_tokenizer
    del t
    trim()
    return out


def word_ids(path: str, words: list[str]) -> list[bytes]:
    """The ids of each word. Plain words are encoded as one text and told apart by word number."""
    t = tokenizer(path)
    out: dict[str, bytes] = {}
    joined = [w for w in words if _JOINABLE.fullmatch(w)]
    for a, b in slices(map(len, joined), 1 << 16):
        part = joined[a:b]
        e = t.encode(" ".join(part), add_special_tokens=False)
        owner, ids = np.array(e.word_ids, "i8"), np.array(e.ids, "<u4")
        ends = np.searchsorted(owner, np.arange(len(part)), "right") * 4
        if owner.size and owner[-1] == len(part) - 1 and ends[-1] == ids.nbytes:
            body = ids.tobytes()
            out.update(zip(part, (body[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist()))))
    rest = [w for w in words if w not in out]
    for a, b in slices(map(len, rest), 1 << 16):
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest[a:b], t.encode_batch(rest[a:b], add_special_tokens=False)))
    return [out[w] for w in words]


def words_seen(rows: DataFrame, path: str) -> DataFrame:
    """``fh, fh2, no, word``: the distinct words of each bucket of ``answers.chunked`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = None, set()

        def passed() -> pa.RecordBatch:
            n = len(seen)
            at = [pa.array(np.full(n, v, t)) for v, t in zip(place, ("i8", "i4", "i8"))]
            out = pa.RecordBatch.from_arrays([*at, pa.array(list(seen), pa.string())], [*answers.KEY, "word"])
            seen.clear()
            return out

        for batch in batches:
            for text, *now in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if seen and (now != place or len(seen) >= TASK_WORDS):
                    yield passed()
                place = now
                seen.update(words_of(text.as_py() or "", path))
        if seen:
            yield passed()

    return rows.select("text", *answers.KEY).mapInArrow(lean("bpe_table", run), "fh long, fh2 int, no long, word string")


def word_table(seen: DataFrame, path: str) -> DataFrame:
    """Columns ``word, n, ids``: every word once, how many buckets have it, its ids as little-endian 32-bit bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = word_ids(path, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])
        tokenizer.cache_clear()  # what follows in this worker hardly needs it

    counted = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(lean("bpe_table", encode), "word string, n long, ids binary")


def shared_words(table: DataFrame, limit: int) -> tuple[list, bool]:
    """The words of most buckets with their ids, up to ``limit`` bytes of both, and whether these are all.

    The cut is a count: words at or above it fit. It comes from sums over 256 classes of counts (of powers of two,
    a quarter apart), so only these sums and the chosen words reach the driver.
    """
    size = F.octet_length("word") + F.octet_length("ids") + F.lit(16)
    grade = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    sums = {r["g"]: r["s"] for r in table.groupBy(grade.alias("g")).agg(F.sum(size).alias("s")).collect()}
    total, cut = 0, None
    for g in sorted(sums, reverse=True):
        if total + sums[g] > limit:
            break
        total, cut = total + sums[g], g
    if cut is None:
        return [], not sums
    rows = table.where(grade >= cut).select("word", "ids")
    return [(r["word"], bytes(r["ids"])) for r in rows.toLocalIterator()], cut == min(sums)


class Known(dict):
    """Word to ids; a word beyond the shared part is looked up in ``rare``. ``pieces``: id to piece, for decoding."""

    rare: dict[str, bytes] = {}
    pieces: list[str] = []

    def __missing__(self, word: str) -> bytes:
        return self.rare[word]


def _packed(rows: list, path: str) -> bytes:
    known = Known(rows)
    known.pieces = pieces_of(path)
    return pickle.dumps(known, protocol=pickle.HIGHEST_PROTOCOL)


_TABLES: dict[str, Known] = {}
kept_by("bpe_table", _TABLES.clear, tokenizer.cache_clear, parts_of.cache_clear)


def _table(name: str) -> Known:
    """The shared words, loaded once in each Python worker; those of an earlier run are let go."""
    if name not in _TABLES:
        _TABLES.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _TABLES[name] = pickle.load(f)
    return _TABLES[name]


def pieces_of(path: str) -> list[str]:
    """The vocabulary as a list: id to piece."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


def encode_decode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shared_bytes: int = SHARED_BYTES,
    keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (with ``keep``: ``ids, decoded``).

    Null texts count as empty and give no ids. Texts, ids and digests are those of the tokenizers library without
    special tokens added. Rows are told apart by where they come from, so repeated and null ids each give a row. An
    empty table gives no rows; extra columns are left behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = work_dir(spark, "words")
    id_type = docs.schema[id_col].dataType
    rows = answers.chunked(located(docs, id_col, text_col, f"{work}/docs"), BUCKET_ROWS)
    seen = written(words_seen(rows, path), f"{work}/seen")
    table = written(word_table(seen, path), f"{work}/table")
    shared, whole = shared_words(table, shared_bytes)
    name = f"{work.rsplit('/', 1)[1]}.bin"
    write_bytes(spark, f"{work}/{name}", _packed(shared, path))
    spark.sparkContext.addFile(f"{work}/{name}")
    del shared

    finish = _finish(keep)
    fields = f"doc_id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    rare_words = None if whole else _rare(seen, table, name, f"{work}/rare")

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(name)
        reader = answers.Reader(rare_words) if rare_words else None

        def bodies(batch: pa.RecordBatch) -> Iterator[bytes]:
            for key, a, b in answers.chunks_of(batch):
                found = reader.table(*key) if reader else []
                known.rare = {w: i for t in found for w, i in zip(t["word"].to_pylist(), t["ids"].to_pylist())}
                for text in batch.column(1).slice(a, b - a):
                    yield b"".join(map(known.__getitem__, words_of(text.as_py() or "", path)))

        for batch in batches:
            yield finish(batch.column(0), bodies(batch), known.pieces)

    return rows.mapInArrow(lean("bpe_table", join_back), fields)


def _rare(seen: DataFrame, table: DataFrame, name: str, folder: str) -> answers.Table:
    """For each bucket its words beyond the shared part, with ids."""

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(name)
        for batch in batches:
            yield batch.filter(pa.array([w not in known for w in batch.column(3).to_pylist()], pa.bool_()))

    rare = seen.mapInArrow(lean("bpe_table", beyond), "fh long, fh2 int, no long, word string")
    # One row for each bucket and word, and no shared words: no key of this join is frequent.
    return answers.write(rare.join(table.select("word", "ids"), "word").select(*answers.KEY, "word", "ids"), folder)


def _finish(keep: bool):
    """Ids to result columns; decoding looks each id up in the vocabulary and joins pieces as the library does."""

    def run(doc_ids: pa.Array, bodies, piece: list[str]) -> pa.RecordBatch:
        n, sha, plain_sha, ids, texts = [], [], [], [], []
        for body in bodies:
            decoded = " ".join(map(piece.__getitem__, np.frombuffer(body, "<u4").tolist()))
            n.append(len(body) // 4)
            sha.append(hashlib.sha256(body).hexdigest())
            plain_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            if keep:
                ids.append(body)
                texts.append(decoded)
        arrays = [doc_ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(plain_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            arrays, names = [*arrays, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
        return pa.RecordBatch.from_arrays(arrays, names)

    return run


def op4_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
