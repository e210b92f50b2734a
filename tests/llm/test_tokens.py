"""The token operators against the tokenizers library itself, on texts of every kind of character."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer


from gleanery.llm.bpe_table import encode_decode, words_of
from gleanery.llm.pieces import plain
from gleanery.llm.token_output import PlaneReader, PlaneWriter, encoded, read_token_files, write_token_files

BYTE, WORD, RANKS = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def texts():
    rng = random.Random(7)
    odd = ["", " ", "\n\n \t x", "it's we'll I'd 's''s !'s", "a<|endoftext|>b <|startoftext|> C", "Ünïcode ÉÀ ß ſ İ ΑΣ ας", "½ ² 12 ٣", "x y z\u0085w", "é ẛ̣", "日本語 テスト", "😀👍🏽 ok", "\x00\x01\x1c\x7f", "‘q’ “w” — … €", "don’t", "a" * 5000, " ".join(["word"] * 4000)]
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC, 0x3B1, 0x3C2, 0x4E00, 0x301, 0x1F600]] + [" ", " ", "'", "s", "t", "\n"] * 20
    return odd + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]


def test_byte_pieces_equal_the_library():
    t = Tokenizer.from_file(BYTE)
    for text, got in zip(texts(), encoded(BYTE, texts(), RANKS)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_every_plain_character_between_all_kinds():
    t, w = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    lines = [f"a{c}b {c}{c} 1{c}'{c}s {c}\n{c} ." for c in map(chr, range(0x2100)) if plain(c)]
    for text, got in zip(lines, encoded(BYTE, lines, RANKS)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    for text in lines:
        ids = [i for x in words_of(text, WORD) for i in w.encode(x, add_special_tokens=False).ids]
        assert ids == w.encode(text, add_special_tokens=False).ids, text


def test_words_equal_the_library():
    w = Tokenizer.from_file(WORD)
    for text in texts():
        ids = [i for x in words_of(text, WORD) for i in w.encode(x, add_special_tokens=False).ids]
        assert ids == w.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("shared", [1 << 20, 3000, 0])
def test_encode_decode(spark, shared):
    w = Tokenizer.from_file(WORD)
    rows = [(i, t, "x") for i, t in enumerate(texts()[:300])] + [(5, "again", "y"), (5, "again", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(map(tuple, encode_decode(df, WORD, shared_bytes=shared).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = w.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(w.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_decode(df.limit(0), WORD).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("width", [2, 4])
def test_plane_round_trip(bits, width):
    rng = np.random.default_rng(3)
    docs = [(i if i % 7 else None, rng.integers(0, 50_000, n, "u4").astype("<u4")) for i, n in enumerate([0, 1, 5, 0, 700, 64, 63, 65, 3000, 0])]
    sink = io.BytesIO()
    writer = PlaneWriter(sink, width, bits, block_ids=64)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    got = list(PlaneReader(sink).documents())
    assert [i for i, _ in got] == [i for i, _ in docs]
    assert all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    with pytest.raises(ValueError):
        PlaneReader(io.BytesIO(sink.getvalue()[:-3]))


def test_plane_width_is_checked():
    writer = PlaneWriter(io.BytesIO(), 2, False, 4)
    with pytest.raises(ValueError):
        writer.add(1, np.array([1, 2, 3, 1 << 16], "<u4").tobytes())


def test_files(spark, tmp_path):
    t = Tokenizer.from_file(BYTE)
    rows = [(i, x, i) for i, x in enumerate(texts()[:200])] + [(3, "again", 0), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    folder = f"file://{tmp_path}/ids"
    manifest = write_token_files(df, folder, BYTE, 2, planes="bit", ranks=RANKS).cache()
    got = read_token_files(manifest, folder).collect()
    got.sort(key=lambda r: r["start"])
    ids = {}
    for i, x, _ in rows:
        ids.setdefault(i, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4"))
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i, _, _ in rows if i is not None)]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in ids[r["doc_id"]]]
    assert read_token_files(write_token_files(df.limit(0), folder, BYTE, 2), folder).count() == 0


def test_a_repeated_id_fills_several_files(spark, tmp_path):
    rows = [(None if k % 3 == 0 else 7, f"text {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = write_token_files(df, f"file://{tmp_path}/ids", BYTE, 2).cache()
    assert manifest.count() == 4 and max(r["n_docs"] for r in manifest.collect()) < 200
    got = sorted(read_token_files(manifest, f"file://{tmp_path}/ids").collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(BYTE)
    ids = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for _, x in sorted(rows, key=lambda r: r[0] or 0)]
    assert [r["doc_id"] for r in got] == [None] * 134 + [7] * 266
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(x.tobytes()) for x in ids]


@pytest.mark.parametrize("space", [" ", "\n"])
def test_long_white_space_equals_the_library(space):
    t = Tokenizer.from_file(BYTE)
    for text in ("a" + space * 1_200_000 + "b", space * 99_999 + "x", space * 100_001 + "x"):
        assert np.frombuffer(encoded(BYTE, [text], RANKS)[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
