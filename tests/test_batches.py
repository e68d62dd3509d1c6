"""What a batch costs the driver: nothing large is gathered there, and nothing is planned or built again for every batch."""

from pyspark.sql import functions as F

from hirelake.functions import roles
from hirelake.operators import merge as m
from hirelake.operators import normalise as nz
from hirelake.plans import registry
from hirelake.schema import DISCOVERED_JOB
from hirelake.streaming import ingest as si


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_meet_without_a_broadcast(spark):
    row = "company_id int, dedup_key string, created_at timestamp_ntz"
    keys = [(c, f"senior backend engineer {n}|paris") for c in (1, 2) for n in range(40)]
    stored = spark.createDataFrame([(*k, None) for k in keys], row)
    new = spark.createDataFrame([(1, "senior backend engineer 7|paris", None), (1, "senior backend engineers 8|paris", None), (3, "cook|", None)], row)
    found = m.near_duplicate_keys(new, stored)
    meets = [x for x in plan(found).splitlines() if "Join" in x and "gram#" in x]
    assert meets and all("SortMergeJoin" in x for x in meets)
    got = {(r.company_id, r.dedup_key): r.existing for r in found.collect()}
    assert got[1, "senior backend engineer 7|paris"] == "senior backend engineer 7|paris" and (3, "cook|") not in got


def test_the_normal_form_is_built_once(spark, monkeypatch):
    listings = spark.createDataFrame([], DISCOVERED_JOB)
    at = lambda day: F.lit(f"2024-01-{day}").cast("timestamp_ntz")
    first = nz.normalise_postings(listings, at("01"))
    monkeypatch.setattr(roles, "clean_title", lambda c: 1 / 0)
    assert nz.normalise_postings(listings, at("02")).schema == first.schema


def test_dates_are_judged_by_the_time_of_each_batch(spark):
    row = {f.name: None for f in DISCOVERED_JOB.fields} | {"title": "Cook", "url": "https://x.com/1", "posted_at": "2029-06-01"}
    listings = spark.createDataFrame([tuple(row.values())], DISCOVERED_JOB)
    # A date more than five years ahead is none.
    days = [nz.normalise_postings(listings, F.lit(f"{y}-01-01").cast("timestamp_ntz")).first().posted_at for y in (2023, 2024)]
    assert days[0] is None and (days[1].year, days[1].month) == (2029, 6)


def test_a_streamed_batch_is_read_by_columns(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "board_url string, n int").write.parquet(f"{tmp_path}/in")
    boards = spark.createDataFrame([("a", 1)], "board_url string, company_id int")
    seen = []

    def run(answers, batch_id):
        session, own = si._landed(answers, boards)
        seen.append((plan(answers.select("n")), plan(own.select("n")), own.join(boards, "board_url").count(), session is spark))

    stream = spark.readStream.schema("board_url string, n int").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    ((before, after, n, same),) = seen
    assert "ExistingRDD" in before and "FileScan" in after and "board_url" not in after and n == 1 and same


def test_score_all_is_held_against_all_pairs(spark):
    sql = registry.oracle_sql()
    whole, since = sql["score_all"], sql["score_all_since_mark"]
    marks = ("WHERE p.closed_at IS NULL", "AND notify_matches", "coalesce(pr.last_notified_at")
    assert all(x in since and x not in whole for x in marks)
