import hashlib
import random
import re

import numpy as np
import pytest

from gleanery.llm import substring_dedup as S
from gleanery.llm.substring_dedup import substring_dedup


def plain(rows, size):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        ws = split(t)
        for a in range(len(ws) - size + 1):
            w = tuple(ws[a : a + size])
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        ws = split(t)
        gone = set()
        for a in range(len(ws) - size + 1):
            if first[tuple(ws[a : a + size])] < key(i):
                gone |= set(range(a, a + size))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(4, 60))] for k in range(5)]
    rows = []
    for i in range(90):
        ws = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            ws += p[a : a + rng.randint(1, 60)] if rng.random() < 0.6 else [f"o{rng.randint(0, 30)}" for _ in range(rng.randint(1, 15))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(ws)))
    rng.shuffle(rows)
    return rows + [(None, " ".join(passages[0])), (None, " ".join(passages[0])), (7, " ".join(passages[1])), (7, " ".join(passages[1])), (300, None), (301, ""), (302, " \x0b"), (303, "a b " * 800), (304, "b a " * 700), (305, "É日本 " * 30 + "\x1c x")]


@pytest.mark.parametrize("size", [2, 7, 10, 50])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, size, seed):
    rows = data(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, bucket int").repartition(3)
    got = sorted(map(tuple, substring_dedup(df, size).collect()), key=str)
    assert got == plain(rows, size)


def test_small_chunks_and_segments(spark, monkeypatch):
    """Chunk and segment borders in odd places change nothing (in this process: the hashing is called directly)."""
    monkeypatch.setattr(S, "SEGMENT", 16)
    texts = [t for _, t in data(3)] + ["long " * 50, "x" * 100 + " y"]
    chunk = S.Chunk(list(range(len(texts))), texts, 10)
    monkeypatch.setattr(S, "SEGMENT", 1 << 20)
    whole = S.Chunk(list(range(len(texts))), texts, 10)
    assert (chunk.words == whole.words).all() and (chunk.bounds == whole.bounds).all()
    assert [len((t or "").encode().split()) for t in texts] == np.diff(whole.bounds).tolist()
    flat = [w for t in texts for w in (t or "").encode().split()]
    assert len(set(whole.words.tolist())) == len(set(flat))


def thue_morse(n, a, b):
    """Strings that polynomial hashes modulo powers of two cannot tell apart when a and b are exchanged."""
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_hash_alike_are_told_apart(spark, n):
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    hashes = S.word_hashes(f"{one} {two}".encode())
    assert one != two and hashes[0] == hashes[1]  # else this test shows nothing
    rest = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*rest[:30], one, *rest[30:]])), (2, " ".join([*rest[:30], two, *rest[30:]])), (3, " ".join([*rest[:30], one, *rest[30:]]))]
    got = sorted(map(tuple, substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == plain(rows, 50) and [r[2] for r in got] == [0, 0, 61]


def test_many_buckets_and_files(spark, tmp_path):
    rows = data(5)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for buckets in (256, 4096):
        assert sorted(map(tuple, substring_dedup(docs, 10, buckets=buckets).collect()), key=str) == plain(rows, 10)


def test_answers_must_be_finished(spark, tmp_path):
    from gleanery.llm import answers

    table = answers.write(spark.createDataFrame([(k % 3, 0, k, f"v{k}") for k in range(300)], "fh long, fh2 int, no long, v string"), f"file://{tmp_path}/a")
    keys = spark.createDataFrame([(k % 3, 0, k) for k in range(310)], "fh long, fh2 int, no long").withColumn("part", answers.part(answers.parts(spark))).collect()
    reader = answers.Reader(table)
    assert [[r["v"] for r in reader.of(k["part"], k["fh"], k["fh2"], k["no"])] for k in keys] == [[f"v{k['no']}"] if k["no"] < 300 else [] for k in keys]
    (tmp_path / "a/_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        answers.Reader(table)
    with pytest.raises(Exception):
        answers.Reader(answers.Table("unknown://x/y"))


def test_empty_and_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d y")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substring_dedup(df, 4, keep=True).collect()} == {1: "a b c d e f", 2: "x y"}
    assert substring_dedup(df.limit(0)).count() == 0
