"""Queries and operators over everything there is, where an earlier form stopped short."""

import json

import check

from hirelake.plans import q_events, registry, views
from hirelake.sources import routing

FOLDER = "/root/testdata/sf0.001"


def test_name_feed_reads_all_and_passes_shares_on(spark):
    page = lambda n: json.dumps({"data": [{"company_name": f"a{n}-{i}"} for i in range(10)]})
    rows = [("arbeitnow", n, page(n)) for n in range(1, 31)] + [("jobicy", 1, json.dumps({"jobs": [{"companyName": "b"}]}))]
    pages = spark.createDataFrame(rows, "feed string, page int, payload string")
    assert routing.read_name_feed(pages).count() == 301
    # jobicy leaves 99 of its 100 names, the two absent feeds leave theirs.
    for limit, n in ((101, 101), (200, 201), (400, 301)):
        assert routing.read_name_feed(pages, limit).count() == n


def test_score_all_keeps_old_and_closed(spark):
    queries = registry.queries()
    every, some = (set(map(tuple, queries[q](spark, FOLDER).collect())) for q in ("score_all", "score_all_since_mark"))
    assert some <= every and len(every) > len(some)


def test_score_all_equals_nested_loops(spark):
    found = registry.queries()["score_all"](spark, FOLDER)
    assert check.difference(found, check.connect(FOLDER), views.sql(q_events.EVERY_SCORE)) is None
