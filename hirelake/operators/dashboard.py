"""The home page numbers, for all users in one pass over applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.roles import days_between
from hirelake.operators.board import BoardQuery, Viewer, board, listed_at
from hirelake.operators.rows import top_per_key
from hirelake.operators.score import STRONG_FIT_SCORE
from hirelake.session import cut_lineage

# --- fixed values -----------------------------------------------------------------
ACTIVITY_DAYS = 30
STALE_AFTER_DAYS = 14
LIST_SIZE = 5
ANSWERED = ["INTERVIEW", "OFFER", "REJECTED"]
SENT = ["APPLIED", *ANSWERED, "GHOSTED"]
COUNTED = ["WISHLIST", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "GHOSTED"]  # NOT_ELIGIBLE is left out
TIER_RANK = {"S_TIER": 1, "A_TIER": 2, "B_TIER": 3}


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def tier_rank() -> Column:
    return reduce(lambda c, kv: F.when(F.col("tier") == kv[0], kv[1]).otherwise(c), TIER_RANK.items(), F.lit(4))


def stale(as_of: Column) -> Column:
    """Sent two weeks ago or more and still without an answer."""
    return (F.col("status") == "APPLIED") & F.coalesce(F.col("applied_at") < as_of - _days(STALE_AFTER_DAYS), F.lit(False))


def days_since(as_of: Column) -> Column:
    """Whole days since it was sent, else since it was written down; never negative."""
    return F.greatest(F.lit(0), days_between(as_of, F.coalesce("applied_at", "created_at"))).cast("int")


def count_by_status(applications: DataFrame) -> DataFrame:
    return applications.groupBy("user_id", "status").agg(F.count("*").alias("count"))


def sent_between(start: Column, end: Column | None = None) -> Column:
    inside = F.col("applied_at") >= start
    return F.count_if(inside if end is None else inside & (F.col("applied_at") < end))


def funnel_stats(applications: DataFrame, as_of: Column) -> DataFrame:
    """One row per user: status counts, totals, this and last week, stale, response rate."""
    n = {s: F.count_if(F.col("status") == s) for s in COUNTED}
    answered = F.count_if(F.col("status").isin(ANSWERED))
    sent = F.count_if(F.col("applied_at").isNotNull() | F.col("status").isin(SENT))
    week, two_weeks = as_of - _days(7), as_of - _days(14)
    return applications.groupBy("user_id").agg(
        *[c.alias(s.lower()) for s, c in n.items()],
        F.count_if(F.col("status").isin(COUNTED)).alias("total_applications"),
        F.count_if(stale(as_of)).alias("stale_applied"),
        sent_between(week).alias("applied_this_week"),
        sent_between(two_weeks, week).alias("applied_last_week"),
        answered.alias("answered"),
        sent.alias("ever_sent"),
    ).withColumn(
        "response_rate",
        F.when(F.col("ever_sent") > 0, F.floor(F.col("answered") / F.col("ever_sent") * 100 + 0.5).cast("int")),
    )


def sent_per_day(applications: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, date, sent) for the last thirty days, days without any left out."""
    return (
        applications.filter(F.col("applied_at") >= as_of - _days(ACTIVITY_DAYS))
        .groupBy("user_id", F.date_format("applied_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count("*").alias("sent"))
    )


def activity(applications: DataFrame, as_of: Column) -> DataFrame:
    """One row per user and day of the window, zeros included.

    A user's sparse days become one small map (30 keys at most) read back for each day, so the
    calendar is never joined.
    """
    per_user = sent_per_day(applications, as_of).groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "sent"))).alias("days")
    )
    users = applications.select("user_id").distinct()
    calendar = F.sequence(F.to_date(as_of) - (ACTIVITY_DAYS - 1), F.to_date(as_of))
    return (
        users.join(per_user, "user_id", "left")
        .select("user_id", "days", F.explode(calendar).alias("day"))
        .select(
            "user_id",
            F.date_format("day", "yyyy-MM-dd").alias("date"),
            F.coalesce(F.try_element_at("days", F.date_format("day", "yyyy-MM-dd")), F.lit(0)).alias("sent"),
        )
    )


def streak(applications: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, streak_days): active days in a row up to today, or to yesterday while today is empty.

    Days back from today are numbered 0..29; the run is the longest prefix 0,1,2… (or 1,2,3…).
    """
    back = F.date_diff(F.to_date(as_of), F.to_date("date"))
    days = (
        sent_per_day(applications, as_of)
        .withColumn("back", back)
        .filter(F.col("back").between(0, ACTIVITY_DAYS - 1))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("back")).alias("back"))
    )
    start = F.when(F.array_contains("back", 0), 0).otherwise(1)
    ordered = F.filter("back", lambda b: b >= start)
    run = F.size(F.filter(ordered, lambda b: F.array_position(ordered, b) == b - start + 1))
    users = applications.select("user_id").distinct()
    return users.join(days.select("user_id", run.alias("streak_days")), "user_id", "left").select(
        "user_id", F.coalesce("streak_days", F.lit(0)).alias("streak_days")
    )


def with_company_name(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """`company_name` beside each listed application, null where the company is unknown; lists are short by now."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return rows.join(names, "company_id", "left")


def stale_list(applications: DataFrame, as_of: Column, n: int = LIST_SIZE) -> DataFrame:
    """Per user the applications that waited longest, oldest first."""
    rows = applications.filter(stale(as_of))
    return top_per_key(rows, ["user_id"], [F.col("applied_at"), F.col("id")], n).withColumn("days_since", days_since(as_of))


def list_by_status(applications: DataFrame, status: str, as_of: Column, n: int = LIST_SIZE) -> DataFrame:
    """Per user the best-ranked applications of one status, oldest first within a tier."""
    rows = applications.filter(F.col("status") == status)
    return top_per_key(rows, ["user_id"], [tier_rank(), F.col("created_at"), F.col("id")], n).withColumn(
        "days_since", days_since(as_of)
    )


def overview(applications: DataFrame, as_of: Column) -> DataFrame:
    """Funnel numbers and streak of every user: one aggregate over applications, joined once."""
    return funnel_stats(applications, as_of).join(streak(applications, as_of), "user_id")


def offer_highlights(frame: DataFrame, viewer: Viewer, as_of: Column, n: int = LIST_SIZE) -> DataFrame:
    """(kind, total, offers): the viewer's strong untouched matches, best first, and saved offers without an application,
    newest first; `frame` is their `board_frame`.

    Both kinds come from one pass over the board: the rows that are of either kind are written once, without their texts,
    then counted and cut to `n` of each kind. A kind without rows is not returned; without a profile nothing is a match.
    """
    rows = board(frame, BoardQuery(tracked=False), viewer, as_of)
    strong = F.coalesce((F.col("match_score") >= STRONG_FIT_SCORE) & F.col("status").isin("NEW", "SEEN"), F.lit(False))
    kinds = F.array_compact(
        F.array(F.when(strong, F.lit("match")), F.when(F.coalesce("saved", F.lit(False)), F.lit("saved")))
    )
    shown = ["id", "title", "company_id", "company_name", "url", "status", "match_score"]
    slim = cut_lineage(rows.filter(F.size(kinds) > 0).select(F.explode(kinds).alias("kind"), *shown, listed_at().alias("listed_at")))
    best = F.when(F.col("kind") == "match", F.col("match_score")).desc_nulls_last()
    place = F.struct(
        F.when(F.col("kind") == "match", -F.col("match_score")).alias("score"),
        (-F.unix_micros(F.col("listed_at").cast("timestamp"))).alias("age"), F.col("id").alias("id"),
    )
    first = top_per_key(slim, ["kind"], [best, F.col("listed_at").desc(), F.col("id")], n)
    offers = first.groupBy("kind").agg(_in_order(place, [*shown, "listed_at"]).alias("offers"))
    return slim.groupBy("kind").agg(F.count("*").alias("total")).join(offers, "kind")


def _in_order(place: Column, names: list[str]) -> Column:
    """Aggregate: the few rows of a list as an array of structs ordered by `place`."""
    return F.transform(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), F.struct(*names).alias("row")))), lambda e: e["row"]
    )


def viewer_overview(
    applications: DataFrame, companies: DataFrame, frame: DataFrame, viewer: Viewer, as_of: Column, n: int = LIST_SIZE
) -> DataFrame:
    """The home page of one viewer as one row: sixteen numbers, activity of thirty days and four lists of at most `n`.

    A viewer without applications has zeros, a null response rate and empty lists. Companies that are unknown have a null
    name; a missing `url` column counts as null.
    """
    me = F.lit(viewer.user_id)
    mine = applications.filter(F.col("user_id") == me)
    if "url" not in mine.columns:
        mine = mine.withColumn("url", F.lit(None).cast("string"))
    shown = ["id", "position", "company_name", "company_id", "url", "status", "tier", "applied_at", "created_at", "days_since"]

    def listed(rows: DataFrame, place: Column, name: str) -> DataFrame:
        return with_company_name(rows, companies).groupBy().agg(_in_order(place, shown).alias(name))

    wishes = listed(
        list_by_status(mine, "WISHLIST", as_of, n), F.struct(tier_rank(), F.col("created_at"), F.col("id")), "wishlist_applications"
    )
    waiting = listed(stale_list(mine, as_of, n), F.struct("applied_at", "id"), "stale_applications")
    days = sent_per_day(mine, as_of).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("date", "sent"))).alias("days"))
    offers = offer_highlights(frame, viewer, as_of, n).groupBy().agg(
        *[
            F.max(F.when(F.col("kind") == kind, F.col(column))).alias(name)
            for kind, column, name in (("match", "total", "strong_matches"), ("saved", "total", "saved_undecided"))
        ],
        *[
            F.any_value(F.when(F.col("kind") == kind, F.col("offers")), True).alias(name)
            for kind, name in (("match", "top_matches"), ("saved", "saved_offers"))
        ],
    )
    numbers = overview(mine, as_of).drop("user_id")
    one = frame.sparkSession.range(1).select(me.alias("user_id"))
    # Every side is one row, so these joins carry five rows in all.
    for side in (numbers, wishes, waiting, days, offers):
        one = one.join(side, F.lit(True), "left")
    calendar = F.sequence(F.to_date(as_of) - (ACTIVITY_DAYS - 1), F.to_date(as_of))

    def day(d: Column) -> Column:
        date = F.date_format(d, "yyyy-MM-dd")
        sent = F.coalesce(F.try_element_at("days", date), F.lit(0))
        return F.struct(date.alias("date"), sent.cast("long").alias("sent"))

    counts = [c for c in numbers.columns if c not in ("response_rate", "answered", "ever_sent")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    lists = ["wishlist_applications", "stale_applications"]
    none = lambda c: F.coalesce(F.col(c), F.array().cast(one.schema[c].dataType)).alias(c)
    return one.select(
        "user_id", *map(zero, counts), F.col("response_rate").cast("long").alias("response_rate"),
        zero("strong_matches"), zero("saved_undecided"),
        F.lit(viewer.profile.configured).alias("has_profile"),
        F.lit(viewer.profile.completeness).cast("long").alias("profile_completeness"),
        F.transform(calendar, day).alias("activity"),
        *map(none, ["top_matches", "saved_offers", *lists]),
    )
