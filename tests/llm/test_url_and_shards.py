import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm.sharding import MULTIPLIER, shard, slices_for
from gleanery.llm.url_filter import RULES, RuleIndex, host_and_path, judged, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    rest = rest[:cut]
    at = rest.find("/") if "/" in rest else len(rest)
    host, path = rest[:at].translate(LOWER), rest[at:]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "net", "http:/x", "http://", "https://NET", "https://NET/", "HTTP://a.b.Example.NET/en/x?y=/z", "https://example.net/e", "https://xexample.com/de/", "https://m.example.com/de/x#/fr/", "https://org/fr/", "https://É.org/fr/a", "https://É.ORG/fr", "x://y://net/", "https://u@net:80/", "https://a..net/", "https://net/?x", "https://net?/", "ftp://example.com/de/" + "p" * 50_000, "https://" + ".".join("a" * 200) + ".net/", "https://org\n/fr/"]


def test_urls_against_plain(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(3, URLS[7], "h", "v"), (None, URLS[7], None, None)], "page_id long, url string, host string, verdict string").repartition(3)
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df).collect()}
    want = {(i, *plain_verdict(u, RULES)) for i, u in [*enumerate(URLS), (3, URLS[7]), (None, URLS[7])]}
    assert got == want and url_filter(df).count() == len(URLS) + 2
    assert url_filter(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter(df, rules=[]).collect()} == {"allow"}


def test_collisions_are_confirmed(tmp_path):
    """All keys equal: only stored strings tell rules apart."""
    rng = random.Random(1)
    rules = [(f"{a}.{b}", f"/{c}", rng.choice(["allow", "block"])) for a in "xy" for b in ("com", "net") for c in ("", "q/", "q/r")]
    path = tmp_path / "rules.bin"
    for key in (lambda s: 7, lambda s: len(s)):
        path.write_bytes(RuleIndex.build(rules, key))
        index = RuleIndex.load(str(path))
        assert isinstance(index.keys, np.memmap)
        urls = [f"http://{s}{a}.{b}/{c}" for s in ("", "m.") for a in "xyz" for b in ("com", "net") for c in ("", "q", "q/", "q/r1")]
        pairs = [host_and_path(u) for u in urls]
        rule, verdict = judged(index, [h for h, _ in pairs], [p for _, p in pairs], "allow", key)
        assert [(r, v) for r, v in zip(rule, verdict)] == [plain_verdict(u, rules)[2:] for u in urls]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_against_the_published_walk(spark):
    rows = [(i, "t" * (i % 5), "x", 1) for i in range(3000)] + [(5, "again", "x", 1), (5, "again", "x", 1), (None, None, None, None), (None, "é", None, None), (-7, "", "x", 1), (1 << 62, "日", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, hi int").repartition(5)
    for n in (1, 2, 16, 300):
        got = shard(df, n).collect()
        for r in got:
            key = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:16], 16)
            assert (r["shard"], r["grown_shard"]) == (jump(key, n), jump(key, n + 1))
            assert r["grown_shard"] in (r["shard"], n)
        sizes = Counter(r["shard"] for r in got)
        assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    body = Counter((r["size"], r["text_crc32"]) for r in got)
    assert body == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert shard(df.limit(0)).count() == 0


def test_long_texts_and_slices_that_grow(spark):
    df = spark.createDataFrame([(1, "日" * 3_000_000), (1, "日" * 3_000_000), (None, "x" * 5_000_000)], "doc_id long, text string")
    got = sorted((r["size"], r["text_crc32"]) for r in shard(df).collect())
    want = [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in ("x" * 5_000_000, "日" * 3_000_000, "日" * 3_000_000)]
    assert got == sorted(want)
    assert [slices_for(n, 16) for n in (0, 10**6, 10**9, 3 * 10**9, 10**11)] == [64, 64, 64, 256, 8192]
    many = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'copy' as text").unionByName(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    slots = shard(many, 2).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in slots) == 100_001 and all(r["n"] == r["d"] == r["m"] + 1 for r in slots)
    runs = {r["k"]: r["n"] for r in shard(many, 2).selectExpr("spark_partition_id() as p", "slot div 65536 as k").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert sum(runs.values()) == 100_001 and len(runs) > 1
    rows = spark.range(500).selectExpr("id as doc_id", "'t' as text")
    a, b = ({r["doc_id"]: (r["shard"], r["grown_shard"]) for r in shard(rows, slices=s).collect()} for s in (1, 512))
    assert a == b
