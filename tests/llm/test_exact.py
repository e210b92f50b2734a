import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import common
from gleanery.llm.exact_dedup import exact_dedup, retained


def plain(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, k))
    out = []
    for text, members in groups.items():
        keep = min(members)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[k][0], rows[keep[2]][0], len(members), k == keep[2], sha) for *_, k in members]
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    base = ["", " ", "a b", "a  b", "a\tb", "a\x0bb", "a b", "É  x", "x" * 200_000, "y z " * 30_000, "end ", "end\n\n", "\x00 \x1c"]
    out = [(i, rng.choice(base)) for i in range(80)] + [(3, "a b"), (3, "a b"), (None, "a b"), (None, "only null"), (None, None), (200, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 0), lambda t: F.crc32(t.cast("binary")).cast("string").cast("binary").substr(1, 1)])
def test_against_plain(spark, digest):
    """The second and third digests collide: full bytes decide."""
    data = rows()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in data], "doc_id long, text string, file string, keep int").coalesce(1)
    got = exact_dedup(df, **({"digest": digest} if digest else {})).collect()
    assert sorted(map(tuple, got), key=str) == plain(data)


def test_without_broadcast(spark, monkeypatch):
    """Beyond the bound of the lists of rows Spark joins them otherwise; collisions are still told apart."""
    monkeypatch.setattr(common, "broadcast_blocks", lambda spark: 0)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = exact_dedup(df, digest=lambda t: F.crc32(t.cast("binary")).cast("string").cast("binary").substr(1, 1)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["group_size"], r["text_sha256"]) for r in got) == sorted((r[0] is None, r[0] or 0, r[2], r[4]) for r in plain(data))


def test_from_files_and_empty(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    assert sorted(map(tuple, exact_dedup(df).collect()), key=str) == plain(data)
    assert exact_dedup(df.where("false")).count() == 0
    clash = df.withColumn("_metadata", F.lit(1)).withColumn("digest", F.lit(2))
    assert exact_dedup(clash).count() == len(data)


def test_state_is_cut_into_batches(spark, tmp_path):
    """More files than one batch may take: the state carries over."""
    from gleanery.llm.exact_dedup import state_of

    schema = "arrival struct<no_id:boolean,id:long,file:string,row:long>, digest binary"
    log = spark.range(60).selectExpr("struct(false as no_id, id, 'f' as file, id as row) as arrival", "cast(cast(id % 7 as string) as binary) as digest")
    log.repartition(6).write.parquet(f"{tmp_path}/log")
    got = state_of(spark, f"{tmp_path}/log", schema, f"file://{tmp_path}/state", 1)
    assert sorted((r["keep"]["id"], r["n"]) for r in got.collect()) == sorted((k, 9 if k < 4 else 8) for k in range(7))
    assert retained(log).count() == 7
