"""What a query moves between tasks: wide rows stay where they are, and rows of repeated keys stay complete."""

from pyspark.sql import functions as F

from hirelake import session
from hirelake.functions import search
from hirelake.operators import entities as e
from hirelake.operators import merge as m
from hirelake.operators import score as sc
from hirelake.operators.rows import first_wins
from hirelake.plans import q_board, q_listings, registry
from hirelake.plans.domain import Domain

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_content_hash_moves_no_row_by_id(spark):
    assert "Exchange hashpartitioning(id" not in plan(registry.queries()["content_hash"](spark, FOLDER))


def test_place_lists_are_the_join_for_repeated_keys(spark, tmp_path):
    for t in ("lineitem", "part", "documents"):
        rows = spark.read.parquet(f"{FOLDER}/{t}.parquet")
        if t != "lineitem":
            key = rows.columns[0]
            rows = rows.unionByName(rows.filter(F.col(key) % 3 == 0))
        else:
            rows = rows.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 50 > 0, F.col("l_suppkey")))
            # Two pairs with one id.
            rows = rows.unionByName(rows.withColumns({"l_partkey": F.col("l_partkey") + 1, "l_suppkey": F.col("l_suppkey") - 100000}).limit(40))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    d = Domain(spark, str(tmp_path))
    want = d.postings.join(d.posting_places, "id")
    got = d.with_place_lists(d.postings).select(*want.columns)
    assert got.count() > d.postings.dropna(subset=["id"]).count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stored_reads_descriptions_only_if_asked(spark):
    stored = Domain(spark, FOLDER).stored
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in text(stored.select("id", "url")) and "text#" in text(stored.select("id", "description"))
    d = Domain(spark, FOLDER)
    want = d.postings.select("id", "description")
    assert stored.select("id", "description").exceptAll(want).count() == 0 and stored.filter("description IS NOT NULL").count() > 0


def test_grams_are_ranked_in_their_row(spark):
    keys = spark.createDataFrame([(1, "senior engineer", "paris"), (1, "junior engineer", "paris")], "company_id int, title_part string, city_part string")
    keys = m._with_grams(keys)
    ranked = m._rarest_grams(keys, m._gram_counts(keys), 0.9)
    assert "Exchange" not in plan(ranked)
    rare = {r.gram for r in ranked.collect()}
    assert rare and not rare & {"eng", "gin", "ine"}


def test_one_shuffle_serves_all_vendors(spark):
    landed = q_listings.every_vendor(Domain(spark, FOLDER))
    assert "Exchange" not in plan(landed) and landed.select("platform").distinct().count() == 7


def test_empty_tables_work_nothing_out(spark):
    d = Domain(spark, FOLDER)
    none = d.empty(d.postings)
    assert none.columns == d.postings.columns and none.count() == 0 and "lineitem" not in plan(none)


def test_sent_snapshot_moves_only_what_is_read(spark):
    snap = registry.queries()["sent_snapshot"](spark, FOLDER)
    assert "description" not in plan(snap)


def test_descriptions_stay_in_their_table(spark):
    for name in ("score_text", "f_search", "search_rank", "search_rank_any", "search_tokens", "match_reasons_text", "board_sort_relevance"):
        df = registry.queries()[name](spark, FOLDER)
        assert "AS description#" not in df._jdf.queryExecution().optimizedPlan().toString(), name


def test_shared_texts_answer_like_descriptions(spark):
    texts = [(1, "Les que data und LEarn"), (2, None), (3, "que the data, sch les"), (3, "Data le"), (None, "data")]
    posts = [(10, 1, "Data les", "Paris"), (11, 2, "Engineer les", None), (12, 3, "x les", "data"), (13, 4, "eau", ""), (14, None, None, "le"), (15, 1, None, None)]
    texts = spark.createDataFrame(texts, "part int, description string")
    posts = spark.createDataFrame(posts, "id int, part int, title string, location string").withColumn("department", F.lit("sch"))
    for c in ("domain", "seniority", "employment_type", "remote_type", "industry"):
        posts = posts.withColumn(c, F.lit(None).cast("string"))
    posts = posts.withColumns({"followed": F.lit(False), "company_id": F.lit(1), "city_list": F.array().cast("array<string>"), "place_known": F.lit(False)})
    terms, profile = ["data", "le"], q_board.TEXT

    def asked(shared):
        zones, wishes = search.Zones(texts=shared), sc.LiteralWishes(profile, search.Zones(texts=shared))
        return [
            search.matches_all_prefixes(zones, terms).alias("all"), search.any_term_share(zones, ["que"]).alias("share"),
            search.search_tokens(texts=shared).alias("tokens"), search.all_rank(search.search_tokens(texts=shared, starts=terms), terms).alias("rank"),
            search.any_rank(search.search_tokens(texts=shared, starts=terms), terms).alias("any"), sc.exclusion(wishes).alias("kept"),
            sc.match_reasons(profile, texts=shared).alias("reasons"),
        ]

    shared = search.SharedTexts(texts, "part")
    answers = asked(shared)
    got = sorted(map(repr, shared.join(posts).select("id", *answers).collect()))
    want = sorted(map(repr, posts.join(texts, "part", "left").select("id", *asked(None)).collect()))
    # "les que" reaches from the title of 10 into no text, from that of 12 into the first text of 3.
    assert got == want and len(got) == 7


def test_ingest_writes_no_texts(spark):
    session.clear_scratch(spark)
    out = registry.queries()["ingest_batch"](spark, FOLDER)
    written = [spark.read.parquet(path).columns for path in session._SCRATCH]
    assert written and not any("description" in columns for columns in written)
    assert out.count() > 0


def test_texts_set_aside_come_back(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, "a"), (4, None, None), (5, "", None), (6, "b", "c")]
    rows = spark.createDataFrame(rows, "id int, description string, description_html string")
    narrow, texts = m.set_texts_aside(rows)
    assert texts.count() == 5 and sorted(map(repr, m.with_texts(narrow, texts).select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    assert "Join" not in plan(m.with_texts(narrow, texts).select("id"))


def test_insert_rounds_move_numbers_alone(spark):
    rows = [(i, "u" * 50 + str(i // 2), "k" * 50 + str((i + 1) // 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "pos int, u string, k string")
    kinds = []

    def keep(x):
        kinds.append({f.dataType.simpleString() for f in x.schema.fields})
        return session.cut_lineage(x)

    taken = spark.createDataFrame([("u" * 50 + "0", "other")], "u string, k string")
    got = sorted(r.pos for r in first_wins(df, [["u"], ["k"]], F.col("pos"), keep, taken).collect())
    used, want = {taken.first().u, "other"}, []
    for pos, u, k in rows:
        if not {u, k} & used:
            want.append(pos)
            used |= {u, k}
    assert got == want and len(kinds) > 2 and all(k <= {"bigint", "boolean"} for k in kinds[1:])


def test_merged_companies_ask_for_no_postings(spark):
    d = Domain(spark, FOLDER)
    merged = e.merge_companies(d.companies, None, None, None, d.watches)
    assert merged.companies.count() > 0 and merged.watches.count() > 0
