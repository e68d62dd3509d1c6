"""Set operators against brute force on small inputs; files and streams end to end."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from hirelake.operators import merge as m
from hirelake.operators.rows import balanced_join, first_wins
from hirelake.plans.domain import POSTINGS_AT, Domain, at
from hirelake.session import cut_lineage, run_folder
from hirelake.sources import company_csv, listings, tables
from hirelake.streaming import ingest as si

FOLDER = "/root/testdata/sf0.001"


def grams(t):
    out = set()
    for w in t.split():
        w = f"  {w} "
        out |= {w[i : i + 3] for i in range(len(w) - 2)}
    return out


def sim(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def test_first_wins_is_the_ordered_insert(spark):
    rng = random.Random(5)
    rows = [(i, 1, f"u{rng.randrange(30)}", rng.choice([None, f"x{rng.randrange(25)}"]), f"k{rng.randrange(20)}") for i in range(120)]
    seen, kept = (set(), set(), set()), []
    for pos, _, *keys in rows:
        if not any(k is not None and k in s for k, s in zip(keys, seen)):
            kept.append(pos)
            for k, s in zip(keys, seen):
                s.add(k)
    df = spark.createDataFrame(rows, "pos int, c int, u string, x string, k string")
    got = first_wins(df, [["c", "u"], ["c", "x"], ["c", "k"]], F.col("pos"), cut_lineage)
    assert sorted(r.pos for r in got.collect()) == kept


def test_balanced_join_is_the_plain_join(spark):
    left = spark.range(300).select("id", (F.col("id") % 3 * F.when(F.col("id") > 60, 0).otherwise(1)).alias("k"))
    right = spark.range(200).select(F.col("id").alias("rid"), (F.col("id") % 2).alias("k"))
    want = {tuple(r) for r in left.join(right, "k").select("id", "rid").collect()}
    got = [tuple(r) for r in balanced_join(left, right, ["k"], ["id"], ["rid"], 50).select("id", "rid").collect()]
    assert len(got) == len(want) and set(got) == want


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(3)
    words = "senior backend platform data engineer analyst developer operations manager research associate".split()
    titles = [" ".join(rng.choices(words, k=rng.randint(3, 7))) for _ in range(150)]
    titles += [t + rng.choice([" i", " ii", "s", " 2"]) for t in titles[:80]]
    day = dt.datetime(2020, 1, 1)
    stored = [(1, f"{t}|paris", day + dt.timedelta(days=i)) for i, t in enumerate(dict.fromkeys(titles[:160]))]
    new = [(1, f"{t}|{c}") for t in titles[100:] for c in ("paris", "lyon")]
    want = {}
    for c, key in set(new):
        t, city = key.split("|")
        best = [(-sim(t, k.split("|")[0]), at_, k) for _, k, at_ in stored if k.endswith("|" + city)]
        best = [b for b in best if -b[0] >= 0.9]
        if best:
            want[key] = min(best)[2]
    got = m.near_duplicate_keys(
        spark.createDataFrame(new, "company_id int, dedup_key string"),
        spark.createDataFrame(stored, "company_id int, dedup_key string, created_at timestamp_ntz"),
    )
    assert {r.dedup_key: r.existing for r in got.collect()} == want and want


def test_level_guard(spark):
    day = dt.datetime(2020, 1, 1)
    stored = spark.createDataFrame([(1, "backend engineer ii|paris", day)], "company_id int, dedup_key string, created_at timestamp_ntz")
    new = spark.createDataFrame([(1, "backend engineer iii|paris")], "company_id int, dedup_key string")
    assert m.near_duplicate_keys(new, stored).count() == 1
    assert m.near_duplicate_keys(new, stored, guard_level_tokens=True).count() == 0


def test_ingest_twice_changes_nothing_more(spark):
    d = Domain(spark, FOLDER)
    when = at(POSTINGS_AT)
    one = m.ingest_batch(d.stored, d.places, d.incoming, when, new_id=F.col("pos"))
    postings, places = cut_lineage(one.postings), cut_lineage(one.places)
    assert postings.select("company_id", "dedup_key").distinct().count() == postings.count()
    two = m.ingest_batch(postings, places, d.incoming, when, new_id=F.col("pos"))
    assert two.inserted.count() == 0
    assert two.postings.count() == postings.count()
    key = ["posting_id", "city", "region", "country", "raw"]
    assert two.places.select(*key).exceptAll(places.select(*key)).count() == 0


def test_hash_ignores_place_order(spark):
    kind = "array<struct<city:string,region:string,country:string,raw:string>>"
    a, b = ("Paris", "", "FR", "p"), ("Lyon", "", "FR", "l")
    df = spark.createDataFrame([(1, [a, b]), (2, [b, a]), (3, [a])], f"id int, places {kind}")
    df = df.withColumns({c: F.lit("x") for c in m.CONTENT_COLUMNS})
    h = {r.id: r.h for r in df.select("id", m.content_hash(F.col("places")).alias("h")).collect()}
    assert h[1] == h[2] != h[3]


def test_company_csv_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,website,careersUrl,industry,country\n Acme ,https://a.com,,ai,FR\n,x,,,\nBeta,,,wizardry,DE\n")
    rows = company_csv.scan_company_csv(spark, str(tmp_path / "in.csv"))
    good, bad = company_csv.check_companies(rows)
    assert [tuple(r) for r in good.collect()] == [("Acme", "https://a.com", None, "AI", "FR", "PENDING")]
    assert sorted((r.row, r.message.split(".")[0]) for r in bad.collect()) == [(2, "Name is required"), (3, "Invalid industry")]
    d = Domain(spark, FOLDER)
    company_csv.write_company_csv(d.companies, str(tmp_path / "out"), status="APPROVED")
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["name", "website", "careersUrl", "industry", "country", "status"]
    assert back.count() == d.companies.filter("status = 'APPROVED'").count()


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_snapshot(spark, path) is None
    tables.write_snapshot(spark.range(3).toDF("id"), path, "a")
    tables.write_snapshot(spark.range(5).toDF("id"), path, "b")
    assert tables.current_version(spark, path) == "b"
    assert tables.read_snapshot(spark, path).count() == 5 and tables.read_snapshot(spark, path, "a").count() == 3


def land(root, token, page, jobs, cycle, pages):
    folder = root / "platform=ashby" / f"token={token}" / f"cycle={cycle}" / f"pages={pages}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "body.json").write_text(json.dumps({"jobs": jobs}))


def test_streamed_cycles(spark, tmp_path):
    job = lambda i, title: {"id": f"j{i}", "title": title, "jobUrl": f"https://jobs.ashbyhq.com/acme/{i}", "location": "Paris, France"}
    root = tmp_path / "landed"
    land(root, "acme", 1, [job(1, "Data Engineer"), job(2, "Backend Engineer"), job(3, "Sign in")], 1, 2)
    d = Domain(spark, FOLDER)
    store = si.Store(str(tmp_path / "store"))
    tables.write_snapshot(d.stored.limit(0).withColumn("id", F.col("id").cast("string")), store.postings, "seed")
    empty = d.places.limit(0).drop("id").withColumn("posting_id", F.col("posting_id").cast("string"))
    tables.write_snapshot(empty, store.places, "seed")
    boards = spark.createDataFrame([("ashby/acme", 7)], "board_url string, company_id bigint")
    told = []

    def cycle():
        stream = spark.readStream.schema("value string, platform string, token string, cycle string, pages int, page int").option("wholetext", True).text(str(root))
        answers = stream.select(
            "platform", F.concat_ws("/", "platform", "token").alias("board_url"), "token", "cycle", "pages", "page", F.col("value").alias("payload")
        )
        run = si.stream_ingest(
            answers, store, boards, lambda n: f"2024-01-0{n + 1}", str(tmp_path / "state"), lambda rows, *_: told.append(rows.count())
        )
        run.awaitTermination()
        return {r.external_id: r for r in tables.read_snapshot(spark, store.postings).collect()}

    first = cycle()
    assert set(first) == {"j1", "j2"} and told == [2]
    # The second page of the same read closes nothing that the first one lists.
    land(root, "acme", 2, [job(2, "Backend Engineer"), job(4, "QA Engineer")], 1, 2)
    second = cycle()
    assert set(second) == {"j1", "j2", "j4"} and told == [2, 1]
    assert all(r.closed_at is None for r in second.values())
    assert second["j2"].last_seen_at > first["j2"].last_seen_at
    # Half of the next read still closes nothing; its other half does.
    land(root, "acme", 1, [job(2, "Backend Engineer")], 2, 2)
    assert all(r.closed_at is None for r in cycle().values())
    land(root, "acme", 2, [job(5, "Data Analyst")], 2, 2)
    fourth = cycle()
    assert {i: r.closed_reason for i, r in fourth.items() if r.closed_at} == dict.fromkeys(["j1", "j4"], "REMOVED_FROM_LISTING")
    # The last batch run again gives the same version.
    answers = listings.load_landed(spark, str(root)).filter("cycle = 2 AND page = 2")
    si.ingest_micro_batch(store, boards, lambda n: f"2024-01-0{n + 1}")(answers, 3)
    again = {r.external_id: r for r in tables.read_snapshot(spark, store.postings).collect()}
    assert again == fourth


def test_personio_address_keeps_its_country(spark):
    xml = "<workzag-jobs><position><id>7</id><name>Data Engineer</name></position></workzag-jobs>"
    rows = [("personio", board, "acme", 1, xml) for board in ("https://acme.jobs.personio.com/xml", "personio/acme", "https://acme.jobs.personio.eu")]
    pages = spark.createDataFrame(rows, "platform string, board_url string, token string, page int, payload string")
    urls = {r.board_url: r.url for r in listings.read_listing_personio(pages).collect()}
    assert urls["https://acme.jobs.personio.com/xml"] == "https://acme.jobs.personio.com/job/7"
    assert urls["https://acme.jobs.personio.eu"] == "https://acme.jobs.personio.eu/job/7"
    assert urls["personio/acme"] == "https://acme.jobs.personio.de/job/7"


def test_first_wins_on_shared_boards(spark):
    """A winner of one company shuts out nothing of another; exact repeats and second spellings of a board count once."""
    x, y, p, z, w = (0, "x", "ex", "kx"), (1, "y", "ey", "ky"), (2, "p", "ex", "ky"), (3, "x", "ez", "kz"), (4, "w", "ez", "kw")
    rows = [(1, *x, "b")] + [(2, *r, "b") for r in (y, p, z, w)] + [(2, *y, "b"), (2, *y, "b/"), (1, *x, "b")]
    df = spark.createDataFrame(rows, "company_id long, pos long, url string, external_id string, dedup_key string, source string")
    stored = df.limit(0)
    got = sorted((r.company_id, r.pos) for r in m.insert_new(df, stored, F.lit("t"), F.col("pos")).collect())
    assert got == [(1, 0), (2, 1), (2, 3)]


def test_run_folder_is_fresh(spark):
    assert run_folder(spark, "x") != run_folder(spark, "x")
