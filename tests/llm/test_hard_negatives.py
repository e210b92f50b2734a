import math
import random

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import hard_negatives as hn
from gleanery.llm.common import work_dir

SCHEMA = "vec_id long, label int, embedding array<float>, n int, q string, windows int"


def plain(rows, positives=5, negatives=10):
    """Every pair, sorted."""
    live = []
    for k, (vec_id, label, v, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((k, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = lambda s, r: (-s, r[1] is None, r[1] or 0)
    out = []
    for a in live:
        if a[1] is None or a[1] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a[3], r[3])), r) for r in live if r[0] != a[0]]
        scored.sort(key=lambda x: order(*x))
        for p, pos in [x for x in scored if x[1][2] == a[2]][:positives]:
            near = [x for x in scored if x[1][2] != a[2] and 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(a[1], pos[1], k + 1, neg[1], p, s) for k, (s, neg) in enumerate(near)]
    return sorted(out, key=str)


def mined(spark, rows, parts=5):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    got = hn.hard_negatives(hn.vectors(table, F.col("label")), F.col("vec_id") % 100 == 0, work_dir(spark, "hn-test"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def table(n, seed, scale=1.0):
    rng = random.Random(seed)
    same = [rng.gauss(0, scale) for _ in range(6)]
    rows = []
    for i in range(n):
        v = same if rng.random() < 0.3 else [rng.gauss(0, scale) for _ in range(6)]
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), list(v)))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 64)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    rows = table(500, 1)
    rows += [(100, 1, rows[100][2]), (None, 2, rows[0][2]), (None, 0, rows[0][2]), (600, None, [1.0] * 6), (601, 0, None), (602, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, 1, [float("nan")] * 6), (604, 1, [float("inf")] * 6)]
    rows += [(700, 0, []), (701, 1, []), (800, 2, [0.5]), (801, 2, [0.5, 0.25]), (900, 0, [0.0] * 6), (1000, 9, [1.0] * 6)]
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 100


def test_wide_windows_take_more_digits(spark, monkeypatch):
    """Scores near 2^60: windows need all digits, and products are of integers."""
    monkeypatch.setattr(hn, "DIGIT", 5)
    rows = [(i, label, v) for i, label, v in table(150, 2, 3e5)]
    assert mined(spark, rows, 2) == plain(rows)


def test_nothing_to_compare(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0])]) == []
    assert mined(spark, [(100, 0, [1.0]), (2, 1, [1.0])]) == []


def test_first_places_with_many_ties():
    rng = np.random.default_rng(0)
    for n in (0, 3, 50, 400):
        part = hn.Block.__new__(hn.Block)
        part.ids, part.n, part.unknown = rng.permutation(n), np.arange(n), rng.random(n) < 0.2
        part.ids[part.unknown] = hn.LAST
        score = rng.integers(0, 3, n)
        want = sorted(range(n), key=lambda i: (-score[i], part.unknown[i], part.ids[i], i))[:4]
        assert hn.first_places(score, part, 4).tolist() == want
