"""Ids, buckets, chunks and reasons: what the registered queries do not show."""

from pyspark.sql import functions as F

from hirelake.operators import crawl, entities
from hirelake.operators import merge as m
from hirelake.operators import score as s
from hirelake.sources import tables


def test_a_batch_for_one_company_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select("id", (F.col("id") % 50).alias("company_id"), F.lit("old").alias("state"))
    tables.write_buckets(rows, path, "company_id", 8)
    files = lambda: {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (tmp_path / "t").glob("bucket=*/part-*")}
    before = files()
    touched = spark.createDataFrame([(3,)], "company_id long")
    old = tables.read_buckets(spark, path, "company_id", touched, 8)
    assert 0 < old.select("company_id").distinct().count() < 50
    new = spark.createDataFrame(old.withColumn("state", F.when(F.col("company_id") == 3, "new").otherwise(F.col("state"))).collect(), old.schema)
    tables.write_buckets(new, path, "company_id", 8)
    after = files()
    assert len(before.keys() - after.keys()) == 1 and {n: t for n, t in after.items() if n in before}.items() <= before.items()
    states = spark.read.parquet(path).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in states} == {"old": 1960, "new": 40}


def test_a_shared_address_becomes_bounded_rows(spark):
    n, most = 100_000, 1000
    c = spark.range(n + 1).select(
        "id", F.concat(F.lit("c"), "id").alias("name"), F.when(F.col("id") < n, "https://x.com/jobs").otherwise("https://y.com").alias("careers_url"),
        F.lit(None).cast("string").alias("website"), F.lit("APPROVED").alias("status"),
    )
    watches = spark.createDataFrame([(1, 5, "https://x.com/jobs", None)], "user_id long, company_id long, careers_url string, website string")
    sources = spark.createDataFrame([("https://x.com/jobs", 3, None)], "url string, failure_count int, last_checked_at timestamp_ntz")
    work = crawl.crawl_worklist(c, watches, sources, most=most).cache()
    sizes = {(r.url, r.chunk): r.n for r in work.select("url", "chunk", F.size("companies").alias("n")).collect()}
    hot = {k: v for (u, k), v in sizes.items() if "x.com" in u}
    assert hot == dict.fromkeys(range(n // most), most) and len(sizes) == len(hot) + 1
    assert work.select(F.explode("companies.company_id")).distinct().count() == n + 1
    assert work.filter("failure_count = 3").count() == len(hot)


def test_new_ids_are_free(spark):
    rows = spark.createDataFrame([("a", "u1"), ("b", "u2")], "id string, url string")
    stored = spark.createDataFrame([("b", "u0"), ("c", "u3")], "id string, url string")
    got = {r.url: r.id for r in m.with_free_ids(rows, stored, given=False).collect()}
    assert got["u1"] == "a" and got["u2"] not in ("a", "b", "c")
    try:
        m.with_free_ids(rows, stored, given=True).collect()
        raise AssertionError("a taken id was given out")
    except Exception as e:  # Spark wraps it
        assert "a stored posting has the id b" in str(e)


def test_a_renamed_company_keeps_its_id(spark):
    names = spark.createDataFrame([("Acme",)], "name string")
    none = spark.createDataFrame([], "id string, name string")
    first = entities.find_or_create_company(none, names).first()
    renamed = spark.createDataFrame([(first.id, "Zenith")], "id string, name string")
    second = entities.find_or_create_company(renamed, names).first()
    assert first.created and second.created and first.id != second.id


def test_reasons_name_all_wishes_in_stored_order(spark):
    p = s.Profile(titles=["alpha", "beta", "gamma"], keywords=[f"k{i}" for i in range(10)], cities=["rome", "paris"])
    frame = spark.createDataFrame(
        [("Alpha beta gamma", " ".join(f"k{i}" for i in range(10)), ["Rome", "Paris"], ["IT", "FR"], None, None, False)],
        "title string, description string, city_list array<string>, country_list array<string>, remote_type string, salary_max int, followed boolean",
    )
    got = [(r.kind, r.label) for r in frame.select(F.explode(s.match_reasons(p)).alias("r")).select("r.*").collect()]
    assert got == [("city", "Rome"), *[("title", t) for t in ("alpha", "beta", "gamma")], *[("keyword", f"k{i}") for i in range(10)]]
    few = frame.select(F.explode(s.match_reasons(p, titles=2, keywords=4)).alias("r")).count()
    assert few == 7
