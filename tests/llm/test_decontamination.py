import hashlib
import random
import re

import pytest

from gleanery.llm import common, decontamination
from gleanery.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def plain(docs, items, size=10):
    windows = {}
    for i, t in items:
        ws = words(t)
        n = min(size, len(ws))
        for a in range(len(ws) - n + 1) if ws else ():
            windows.setdefault(tuple(ws[a : a + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {len(w) for w in windows}:
            for a in range(len(ws) - n + 1):
                if (w := tuple(ws[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[w]
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data():
    rng = random.Random(5)
    vocabulary = ["the", "of", "É", "x1", "日本", "Zeta", "b", "c", "d"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.choice([1, 3, 4, 6, 9, 10, 11, 25, 60]))) for k in range(25)] + [(90, ""), (91, None), (92, "..."), (5, "solo"), (93, "the the the the the the the the the the the the")]
    docs = []
    for k in range(120):
        parts = [text(rng.randint(0, 40))]
        if rng.random() < 0.5:
            ws = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(ws) - 10))
            parts += [", ".join(ws[a : a + rng.randint(1, 30)]).upper(), text(5)]
        docs.append((k, "; ".join(parts)))
    docs += [(None, items[8][1]), (3, docs[3][1]), (3, docs[3][1]), (200, None), (201, ""), (202, "the " * 5000), (203, "ÉCOLE É é")]
    return docs, items


@pytest.mark.parametrize("bound", [60_000, 0])
def test_against_plain(spark, bound, monkeypatch):
    """With no room for broadcasts Spark shuffles; the results are the same."""
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
    monkeypatch.setattr(common, "broadcast_blocks", lambda spark: bound)
    docs, items = data()
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, h string, pos int, k int").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, wid string")
    got = sorted(map(tuple, contamination(d, b).drop("items", "file", "row").collect()), key=str)
    assert got == plain(docs, items)
    assert 10 < sum(r[5] for r in got) < len(got)


def test_empty_tables(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = contamination(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)
    assert contamination(d.limit(0), b).count() == 0
