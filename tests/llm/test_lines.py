import hashlib
import random

import numpy as np
import pytest
import xxhash

from gleanery.llm.line_dedup import chunk_ends, line_dedup


def plain_ends(lines):
    """Boundaries by the definition, in whole numbers: after each place where the hash of two neighbouring lines is
    even, chunks of 2 to 64 lines."""
    base, m = 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(x) for x in lines]
    marks = []
    for i in range(len(h) - 1):
        x = (h[i] + h[i + 1] * base) & m
        x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & m
        x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & m
        if (x ^ (x >> 33)) % 2 == 0:
            marks.append(i + 2)
    ends, start = [], 0
    for k in range(1, len(lines) + 1):
        if k - start == 64 and k < len(lines) or (k in marks and k - start >= 2) or k == len(lines):
            ends.append(k)
            start = k
    return ends


def plain(rows):
    """Chunks of all rows in (id, row) order; later equal ones of several lines, not all blank, go."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        lines = (rows[k][1] or "").encode().split(b"\n") if rows[k][1] else []
        ends, kept, removed, start = plain_ends(lines), [], 0, 0
        for end in ends:
            body = tuple(lines[start:end])
            if len(body) > 1 and b"".join(body).strip() and body in seen:
                removed += len(body)
            else:
                kept += body
                seen.add(body)
            start = end
        out[k] = (rows[k][0], len(lines), len(ends), removed, hashlib.sha256(b"\n".join(kept)).hexdigest())
    return sorted(out.values(), key=str)


def texts(rng, n):
    passages = [[f"p{i} {j} x" for j in range(rng.randint(2, 12))] for i in range(6)]
    out = []
    for k in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            lines += rng.choice(passages) if rng.random() < 0.6 else [f"own {k} {rng.random()}"] * rng.randint(1, 3)
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("digest", [xxhash.xxh64_intdigest, lambda b: len(b) % 3])
def test_against_plain(spark, digest):
    rng = random.Random(4)
    rows = [(i, t, "x") for i, t in enumerate(texts(rng, 120))] + [(500, None, "y"), (501, "", "y"), (502, "\n\n\n\n", "y"), (503, "\n\n\n\n", "y"), (None, "p0 0 x\np0 1 x\n", None), (504, "a\nb\n" * 200, "z"), (505, "q\n" + "a\nb\n" * 200, "z"), (506, "\n".join(f"long {k % 500}" for k in range(20_000)), "z"), (507, "\n".join(f"long {k}" for k in range(500)), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").coalesce(1)
    got = sorted(map(tuple, line_dedup(df, digest=digest).collect()), key=str)
    assert got == plain(rows)
    assert sum(r[3] for r in got) > 100
    assert line_dedup(df.limit(0)).count() == 0


def test_repeated_rows_keep_one(spark):
    lines = "\n".join(f"l{i}" for i in range(40))
    got = line_dedup(spark.createDataFrame([(1, lines), (1, lines), (1, lines)], "doc_id long, text string"), keep=True).collect()
    assert sorted(r["n_removed"] for r in got)[0] == 0
    assert all(r["n_removed"] >= 38 for r in sorted(got, key=lambda r: r["n_removed"])[1:])


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [rng.getrandbits(64) for _ in range(300)]
    ends = lambda x: {len(x) - e for e in chunk_ends(np.array(x, "u8"))}
    far = {e for e in ends(lines) if e < 250}
    assert len(far & ends([1, 2, 3, *lines])) > 0.9 * len(far)
    assert all(b - a <= 64 for a, b in zip([0, *chunk_ends(np.zeros(1000, "u8"))], chunk_ends(np.zeros(1000, "u8"))))
