import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import gram_index as GI
from gleanery.operators import search as Q


def texts(rng, n):
    words = ["spark", "sparse", "parquet", "東京都", "京都府", "naïve", "a", "bb", "ß𝔘x", "of"]
    return [(i, rng.choice([None, "", "ab", *(" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(9))])) for i in range(n)]


def test_postings_are_the_trigrams_of_each_text(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    for chars in (4 << 20, 64, 12):
        monkeypatch.setattr(GI, "CHARS", chars)
        rows = [(i + (1 << 33) - 150, t) for i, t in texts(rng, 400)]
        batches = [pa.RecordBatch.from_pydict({"place": [p for p, _ in rows[k : k + 90]], "text": pa.array([t for _, t in rows[k : k + 90]], pa.string())}) for k in range(0, 400, 90)]
        got = set()
        for b in GI._each(iter(batches)):
            for gram, segment, places in zip(*(b[c].to_pylist() for c in ("gram", "segment", "rows")), strict=True):
                assert places == sorted(set(places))
                got |= {(gram, (segment << GI.SEGMENT_BITS) + p) for p in places}
        assert got == {(g, p) for p, t in rows for g in GI.gram_codes(t or "")}


def test_a_large_alphabet_goes_one_by_one():
    import numpy as np

    a = np.arange(1, 140_000, dtype=np.int64)
    got = [x for b in GI._postings(5, list(range(1, 601)), [a] + [a[:3]] * 599) for x in zip(b["gram"].to_pylist(), b["rows"].to_pylist(), strict=True)]
    assert len(got) == len(a) - 2 + 599 and sorted(r for g, (r,) in got if g == 1 << 42 | 2 << 21 | 3) == list(range(1, 601))


def test_same_rows_as_contains(spark, tmp_path):
    rows = spark.createDataFrame(texts(random.Random(3), 2000), "id int, body string").repartition(5)
    GI.write(rows, F.lower("body"), f"{tmp_path}/index")
    for q in ("spark", "spa", "SPARK parquet", "京都", "東京都", "京都府 東京都", "ß𝔘", "ark sp", "a", "bb of", "", "nowhere", "spark nowhere", "k s", "sparkk", "ＳＰＡＲＫ"):
        want = sorted(r["id"] for r in rows.where(Q.has_terms(F.lower("body"), q)).collect())
        got = GI.find(spark, f"{tmp_path}/index", q)
        if Q.folded_terms(q):
            assert sorted(r["id"] for r in got.collect()) == want, q
        assert got.columns == ["id", "body"]


def test_join_beyond_the_listed_segments_and_empty_tables(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(texts(random.Random(4), 300), "id int, body string").repartition(6)
    GI.write(rows, F.col("body"), f"{tmp_path}/index")
    monkeypatch.setattr(GI, "LISTED", 2)
    got = GI.find(spark, f"{tmp_path}/index", "sparse naïve")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows.where("contains(body, 'sparse') AND contains(body, 'naïve')").collect())
    GI.write(rows.limit(0), F.col("body"), f"{tmp_path}/none")
    assert GI.find(spark, f"{tmp_path}/none", "spark").collect() == [] and GI.find(spark, f"{tmp_path}/none", "s").collect() == []
    with pytest.raises(ValueError):
        GI.write(rows.withColumn("Place", F.lit(1)), F.col("body"), f"{tmp_path}/clash")


def test_few_row_groups_are_read(spark, tmp_path):
    """One text of 40,000 has the term: of lists and texts little more than its own blocks is read."""
    rows = spark.range(40_000, numPartitions=2).select("id", F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.when(F.col("id") == 23_456, "needle")).alias("body"))
    GI.write(rows, F.col("body"), f"{tmp_path}/index", block_bytes=256 << 10)
    hit = GI.find(spark, f"{tmp_path}/index", "needle")
    assert [r["id"] for r in hit.collect()] == [23_456]
    plan = hit._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    assert sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())) <= 3 << GI.SEGMENT_BITS
