"""The home page of viewers with and without applications, profile and offers."""

import datetime as dt

from hirelake.operators import dashboard
from hirelake.operators.board import Viewer
from hirelake.operators.score import Profile
from hirelake.plans import q_board
from hirelake.plans.domain import Domain
from hirelake.plans.q_dashboard import as_of, live

FOLDER = "/root/testdata/sf0.001"


def page(domain, applications, viewer):
    frame = q_board.frame(domain, viewer.user_id)
    return dashboard.viewer_overview(applications, domain.companies, frame, viewer, as_of())


def test_lists_are_ordered_and_bounded(spark):
    domain = Domain(spark, FOLDER)
    day = lambda d: dt.datetime(2001, 7, d)
    tiers = ["NONE", "B_TIER", "S_TIER", "A_TIER", "S_TIER", None, "B_TIER"]
    rows = [(i, 8, 1, f"wish {i}", "u", "WISHLIST", t, None, day(20 - i)) for i, t in enumerate(tiers)]
    rows += [(100 + i, 8, None, f"sent {i}", None, "APPLIED", "NONE", day(1 + i), day(1)) for i in range(7)]
    rows += [(200, 8, 1, "fresh", "u", "APPLIED", "NONE", dt.datetime(2001, 8, 1), day(1)), (300, 9, 1, "other", "u", "WISHLIST", "S_TIER", None, day(1))]
    schema = "id long, user_id long, company_id long, position string, url string, status string, tier string, applied_at timestamp_ntz, created_at timestamp_ntz"
    got = page(domain, spark.createDataFrame(rows, schema), q_board.PLAIN).first()
    assert [a.id for a in got.wishlist_applications] == [4, 2, 3, 6, 1]  # best tier first, then the oldest
    assert [a.id for a in got.stale_applications] == [100, 101, 102, 103, 104]
    assert {a.company_name for a in got.stale_applications} == {None} and got.wishlist_applications[0].company_name
    assert [a.url for a in got.wishlist_applications] == ["u"] * 5 and got.stale_applications[0].days_since == 32
    assert (got.wishlist, got.applied, got.stale_applied, got.applied_this_week, got.streak_days) == (7, 8, 7, 1, 1)
    assert len(got.activity) == 30 and got.activity[-2].sent == 1 and sum(a.sent for a in got.activity) == 5
    # No profile: nothing is a match, saved offers are shown all the same.
    assert (got.has_profile, got.profile_completeness, got.strong_matches, got.top_matches) == (False, 0, 0, [])
    assert got.saved_undecided > 5 and len(got.saved_offers) == 5
    newest = [o.listed_at for o in got.saved_offers]
    assert newest == sorted(newest, reverse=True)


def test_viewer_without_anything(spark):
    domain = Domain(spark, FOLDER)
    rows = page(domain, live(domain), Viewer(-1, Profile(user_id=-1, domains=["NOBODY"], titles=["nothing like it"]))).collect()
    assert len(rows) == 1
    got = rows[0].asDict()
    assert all(got[c] == 0 for c in ("wishlist", "total_applications", "streak_days", "strong_matches", "saved_undecided"))
    assert got["response_rate"] is None and got["has_profile"] and got["profile_completeness"] == 14
    assert all(got[c] == [] for c in ("top_matches", "saved_offers", "wishlist_applications", "stale_applications"))
    assert [a.sent for a in got["activity"]] == [0] * 30
