import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gleanery.llm import simhash
from gleanery.llm.components import components
from gleanery.llm.simhash import fingerprint, linked, simhash_components


def plain_fingerprint(text):
    ws = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    if not ws:
        return 0
    runs = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \n", "A b", "É x Y\x0bz\x1cq", "a b c", "a b c d " * 30] + [" ".join(rng.choices("aBcé", k=rng.randint(1, 40))) for _ in range(50)]:
        assert fingerprint(text) == plain_fingerprint(text)


def cluster(rng, n):
    out = []
    for _ in range(n):
        x = rng.getrandbits(64) if not out or rng.random() < 0.3 else rng.choice(out)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("crowd", [4096, 1])
def test_links_are_complete(spark, tmp_path, seed, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    fps = cluster(random.Random(seed), 300)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, 2, f"file://{tmp_path}")
    roots = {r["node"]: r["root"] for r in components(edges, f"file://{tmp_path}/c").collect()}
    want = plain_components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2], len(fps))
    groups = defaultdict(set)
    for f, w in zip(fps, want):
        groups[w].add(simhash.signed(f))
    for g in groups.values():
        assert {roots.get(f, f) for f in g} == {min(g)}
    assert len(groups) == len({roots.get(simhash.signed(f), simhash.signed(f)) for f in fps})


def test_linked_prunes_nothing_within_reach():
    rng = np.random.default_rng(5)
    fp = (rng.integers(0, 1 << 9, 400).astype("u8") << np.uint64(11)) | np.uint64(7)
    fp = np.unique(fp)
    mask = np.full(len(fp), 0xFFFF00000000FFFF - 0xF800, "u8")
    a, b = linked(mask, fp & mask, fp, 2)
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    same = lambda i, j: (fp[i] ^ fp[j]) & mask[0] == 0
    assert got == {frozenset((i, j)) for i in range(len(fp)) for j in range(i) if same(i, j) and int(fp[i] ^ fp[j]).bit_count() <= 2}


def test_rows(spark):
    base = " ".join(f"w{i % 97}x{i}" for i in range(3000))
    rows = [(7, base, 1), (3, base.upper(), 2), (3, base.upper(), 2), (9, base + " end", 3), (None, base, 4), (4, None, 5), (5, "", 6), (6, " ", 7), (8, "solo text here", 8), (None, "only null", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(map(tuple, simhash_components(df).collect()), key=str)
    want = []
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    comp = plain_components([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2], len(rows))
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if comp[m] == comp[k] and rows[m][0] is not None]
        want.append((i, f"{fps[k]:016x}", min(ids, default=None)))
    assert got == sorted(want, key=str)
    assert simhash_components(df.limit(0)).count() == 0


def test_long_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, f"file://{tmp_path}").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
