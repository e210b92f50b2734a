import random

from pyspark.sql import functions as F

from gleanery.functions import dates
from gleanery.operators import layouts as LA
from gleanery.operators import search as Q


def articles(spark, n=3000):
    rng = random.Random(2)
    day = lambda: f"{rng.randint(1990, 2025)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    rows = []
    for i in range(n):
        d = day()
        rows.append((str(i), rng.choice([d, d, d, d[:7], d[:4], None, d + "T23:30:00+09:00"]), day()))
    return spark.createDataFrame(rows, "id string, published string, first_seen_at string")


def scanned(df):
    """Rows that came back, and rows that left the scan."""
    got = sorted(r["id"] for r in df.select("id").collect())
    plan = df.select("id")._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    return got, sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_periods_read_few_blocks(spark, tmp_path):
    a, folder = articles(spark).cache(), f"{tmp_path}/by-day"
    LA.write_by_day(a, folder, 12, block_bytes=2048)
    for start, end in (("2001-03-05", "2001-06-20"), (None, "1990-02-01"), ("2025-11-30", None), ("2030-01-01", None), ("1999-12-31", "1999-12-31")):
        want = sorted(r["id"] for r in a.where(dates.overlaps(F.col("published"), start, end)).collect())
        got, read = scanned(LA.in_period(spark, folder, start, end))
        assert got == want and read < 1200
    assert LA.in_period(spark, folder, None, None).count() == 3000
    assert LA.undated(spark, folder).first()["n"] == a.where("published is null").count()
    LA.write_by_day(a.limit(0), f"{tmp_path}/none", 3)


def test_pages_open_the_ranges_they_lie_in(spark, tmp_path):
    a = articles(spark, 700).cache()
    keys = [F.coalesce("published", F.lit("")).desc(), F.col("first_seen_at").desc(), F.col("id")]
    stored = LA.write_pages(a, keys, f"{tmp_path}/pages", 8)
    assert stored.total == 700 and LA.directory(spark, f"{tmp_path}/pages") == stored
    whole = [tuple(r) for r in Q.newest_first(a).collect()]
    for page in (1, 2, 7, 8, 13, 14, 15, 99, -1):
        got = stored.page(50, page)
        _, _, start, end = Q.page_bounds(700, 50, page)
        assert [tuple(r) for r in got.collect()] == whole[start:end]
        assert len({f.split("part=")[1].split("/")[0] for f in got.inputFiles()}) <= 2
    assert [tuple(r) for r in stored.page(1000, 1).collect()] == whole
    few = LA.write_pages(a.limit(1), keys, f"{tmp_path}/few", 8)
    assert few.page(50, 3).count() == 1
