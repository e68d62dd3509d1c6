"""The job board: composable filters, sort, page, counts, facets — one frame, one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions import search
from hirelake.functions.search import SharedTexts, Zones
from hirelake.operators.rows import top_per_key
from hirelake.operators.score import STRONG_FIT_SCORE, LiteralWishes, Profile, exclusion, match_predicate, match_reasons, match_score

# --- fixed values -----------------------------------------------------------------
PAGE_DEFAULT = 25
HIGHLIGHT_DEFAULT = 5
NEW_WINDOW_DAYS = 7
FACET_SIZES = {
    "company_id": 30, "department": 30, "employment_type": 30, "remote_type": 30, "city": 40, "country": 40,
}


def one_or_many(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]


def as_bool(value) -> bool | None:
    """Query-string booleans: '' is absent, 'true' and '1' are true."""
    if value is None or value == "":
        return None
    return value if isinstance(value, bool) else value in ("true", "1")


def as_int(value) -> int | None:
    """Query-string integers: a leading run of digits counts, anything else is absent."""
    if value is None or value == "" or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return int(value)
    m = re.match(r"\s*([+-]?\d+)", value)
    return int(m[1]) if m else None


@dataclass
class BoardQuery:
    status: object = None
    company_id: object = None
    city: object = None
    country: object = None
    department: object = None
    employment_type: object = None
    remote_type: object = None
    salary_min: object = None
    posted_within_days: object = None
    saved: object = None
    tracked: object = None
    followed: object = None
    include_closed: object = None
    only_matches: object = None
    min_score: object = None
    max_score: object = None
    search: str | None = None
    sort_by: str | None = None
    sort_order: str = "desc"
    page: object = None
    limit: object = None


@dataclass
class Viewer:
    user_id: object
    profile: Profile = field(default_factory=Profile)
    follows_any: bool = False


def place_lists(places: DataFrame) -> DataFrame:
    """Per posting: its distinct cities and countries, in the order of the place rows' ids where they have any, and whether
    any place is known.

    A posting has at most a few dozen place rows, so the lists stay small.
    """
    order = F.col("id") if "id" in places.columns else F.lit(0)

    def names(c: str) -> Column:
        placed = F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct(order.alias("at"), F.col(c).alias("name")))))
        return F.array_distinct(F.transform(placed, lambda x: x["name"]))

    return places.groupBy("posting_id").agg(
        names("city").alias("city_list"),
        names("country").alias("country_list"),
        F.max((F.col("city") != "") | (F.col("country") != "")).alias("place_known"),
    )


def with_places_known(postings: DataFrame, places: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return (
        postings.join(place_lists(places), F.col("id") == F.col("posting_id"), "left")
        .drop("posting_id")
        .withColumns(
            {
                "city_list": F.coalesce("city_list", empty),
                "country_list": F.coalesce("country_list", empty),
                "place_known": F.coalesce("place_known", F.lit(False)),
            }
        )
        .withColumns(
            {
                "cities_lower": F.transform("city_list", F.lower),
                "countries_upper": F.transform("country_list", F.upper),
            }
        )
    )


def with_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Inner join; Spark broadcasts the companies when they are small enough, else shuffles."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "industry")
    return postings.join(c, "company_id")


def board_frame(
    postings: DataFrame, companies: DataFrame, places: DataFrame, interactions: DataFrame, watches: DataFrame, viewer: Viewer
) -> DataFrame:
    """Postings with company, place lists and what this viewer did with them."""
    mine = interactions.filter(F.col("user_id") == F.lit(viewer.user_id)).select(
        F.col("posting_id").alias("id"), "status", "saved", "application_id"
    )
    followed = (
        watches.filter(F.col("user_id") == F.lit(viewer.user_id))
        .select("company_id")
        .distinct()
        .withColumn("followed", F.lit(True))
    )
    return (
        with_places_known(with_company(postings, companies), places)
        .join(mine, "id", "left")
        .join(followed, "company_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("NEW")))
        .withColumn("followed", F.coalesce("followed", F.lit(False)))
    )


def listed_at() -> Column:
    return F.coalesce("posted_at", "created_at")


def search_predicate(text: str, texts: SharedTexts | None = None) -> Column | None:
    """Company name contains the text, or every term starts a word of the posting.

    `%` and `_` in the text stand for themselves.
    """
    text = (text or "").strip()
    if not text:
        return None
    named = F.contains(F.lower("company_name"), F.lit(text.lower()))
    terms = search.query_terms(text)
    return named | search.matches_all_prefixes(Zones(texts=texts), terms) if terms else named


def dimension_filters(q: BoardQuery) -> dict[str, Column]:
    """The filters a facet leaves out when it counts its own dimension."""
    out: dict[str, Column] = {}
    for name in ("company_id", "department", "employment_type", "remote_type"):
        if values := one_or_many(getattr(q, name)):
            out[name] = F.coalesce(F.col(name).isin(values), F.lit(False))
    if cities := one_or_many(q.city):
        out["city"] = F.arrays_overlap("city_list", F.array(*map(F.lit, cities)))
    if countries := one_or_many(q.country):
        out["country"] = F.arrays_overlap("country_list", F.array(*[F.lit(c.upper()) for c in countries]))
    return out


def common_filters(q: BoardQuery, viewer: Viewer, as_of: Column, texts: SharedTexts | None = None) -> list[Column]:
    """Every other filter of a board query."""
    wishes = LiteralWishes(viewer.profile, Zones(texts=texts))
    out: list[Column] = []
    if not as_bool(q.include_closed):
        out.append(F.col("closed_at").isNull())
    if statuses := one_or_many(q.status):
        out.append(F.col("status").isin(statuses))
    if (salary := as_int(q.salary_min)) is not None:
        out.append((F.col("salary_max") >= salary) | (F.col("salary_min") >= salary))
    if (days := as_int(q.posted_within_days)) is not None and days > 0:
        out.append(listed_at() >= as_of - F.make_dt_interval(F.lit(days)))
    if as_bool(q.saved):
        out.append(F.col("saved"))
    if (tracked := as_bool(q.tracked)) is not None:
        out.append(F.col("application_id").isNotNull() if tracked else F.col("application_id").isNull())
    if as_bool(q.followed):
        out.append(F.col("followed"))
    if (kept := exclusion(wishes)) is not None:
        out.append(kept)
    if as_bool(q.only_matches) and (wanted := match_predicate(wishes) if viewer.profile.configured else None) is not None:
        out.append(wanted)
    score = viewer_score(viewer, as_of, texts)
    if score is not None:
        low, high = as_int(q.min_score), as_int(q.max_score)
        if low is not None and low > 0:
            out.append(score >= low)
        if high is not None and high < 100:
            out.append(score <= high)
    if (found := search_predicate(q.search, texts)) is not None:
        out.append(found)
    return out


def viewer_score(viewer: Viewer, as_of: Column, texts: SharedTexts | None = None) -> Column | None:
    if not viewer.profile.configured:
        return None
    return match_score(LiteralWishes(viewer.profile, Zones(texts=texts)), viewer.follows_any, as_of)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def board(frame: DataFrame, q: BoardQuery, viewer: Viewer, as_of: Column, texts: SharedTexts | None = None) -> DataFrame:
    """All rows the query keeps, with `match_score` (NULL without a profile).

    With `texts` the frame carries their key instead of a description, and the answers to all that was asked of them, by
    the caller before or here, stay in the rows until `texts.drop`.
    """
    conditions = [*common_filters(q, viewer, as_of, texts), *dimension_filters(q).values()]
    score = viewer_score(viewer, as_of, texts)
    rows = (frame if texts is None else texts.join(frame)).filter(_all(conditions))
    return rows.withColumn("match_score", F.lit(None).cast("int") if score is None else score)


def board_sort(
    rows: DataFrame, q: BoardQuery, viewer: Viewer, texts: SharedTexts | None = None
) -> tuple[DataFrame, list[Column]]:
    """Rows plus the order to read them in; always ends with the id, so pages are stable."""
    terms = search.query_terms(q.search or "")
    scored = viewer.profile.configured
    by = q.sort_by or ("relevance" if terms else "match" if scored else "posted_at")
    newest = [listed_at().desc(), F.col("id").asc()]
    if by == "match" and scored:
        return rows, [F.col("match_score").desc(), *newest]
    if by == "relevance" and terms:
        ranked = rows.withColumn("search_rank", search_rank(terms, texts))
        return ranked, [F.col("search_rank").desc(), *newest]
    key = {
        "title": F.col("title"), "company": F.col("company_name"), "created_at": F.col("created_at"),
        "salary_max": F.col("salary_max"),
    }.get(by, listed_at())
    up = q.sort_order == "asc"
    if by == "salary_max":
        first = key.asc_nulls_last() if up else key.desc_nulls_last()
    else:
        first = key.asc() if up else key.desc()
    return rows, [first, F.col("id").asc()]


def search_rank(terms: list[str], texts: SharedTexts | None = None) -> Column:
    """Cover-density rank; 0 where a row lacks a term (it came in by company name)."""
    found = search.matches_all_prefixes(Zones(texts=texts), terms)
    return F.when(found, search.all_rank(search.search_tokens(texts=texts, starts=terms), terms)).otherwise(F.lit(0.0))


def paginate(rows: DataFrame, order: list[Column], page=None, limit=None) -> DataFrame:
    """One page by offset: offset and limit rows meet in one task. `page_after` reads deep pages without that."""
    page = max(as_int(page) or 1, 1)
    size = as_int(limit)
    size = max(PAGE_DEFAULT if size is None else size, 1)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(rows: DataFrame, keys: dict[str, bool], last: dict, limit: int = PAGE_DEFAULT) -> DataFrame:
    """The page behind a row: `keys` maps each sort column to "descending", the last of them is unique; `last` holds the
    row's values. Every task keeps `limit` rows, however deep the page is. Columns without nulls only."""
    behind, same = F.lit(False), F.lit(True)
    for name, descending in keys.items():
        value = F.lit(last[name])
        behind = behind | (same & ((F.col(name) < value) if descending else (F.col(name) > value)))
        same = same & (F.col(name) == value)
    order = [F.col(name).desc() if descending else F.col(name).asc() for name, descending in keys.items()]
    return rows.filter(behind).orderBy(*order).limit(limit)


def board_page(frame: DataFrame, q: BoardQuery, viewer: Viewer, as_of: Column, texts: SharedTexts | None = None) -> DataFrame:
    reasons = match_reasons(viewer.profile, texts=texts)
    if texts is not None and (terms := search.query_terms(q.search or "")):
        search_rank(terms, texts)  # asked before the join
    rows, order = board_sort(board(frame, q, viewer, as_of, texts), q, viewer, texts)
    page = paginate(rows, order, q.page, q.limit).withColumn("match_reasons", reasons)
    return page if texts is None else texts.drop(page)


def count_total(frame: DataFrame, q: BoardQuery, viewer: Viewer, as_of: Column) -> DataFrame:
    return board(frame, q, viewer, as_of).agg(F.count("*").alias("total"))


def highlights(frame: DataFrame, q: BoardQuery, viewer: Viewer, as_of: Column) -> DataFrame:
    """The first few rows; `count_total` of the same query is the total that stands beside them."""
    size = as_int(q.limit)
    size = max(HIGHLIGHT_DEFAULT if size is None else size, 1)
    rows, order = board_sort(board(frame, q, viewer, as_of), q, viewer)
    return rows.orderBy(*order).limit(size)


def get_posting(frame: DataFrame, posting_id, viewer: Viewer) -> DataFrame:
    """One posting as the viewer sees it; opening a posting computes no score."""
    return (
        frame.filter(F.col("id") == F.lit(posting_id))
        .withColumn("match_score", F.lit(None).cast("int"))
        .withColumn("match_reasons", match_reasons(viewer.profile))
    )


def count_new(frame: DataFrame, interactions: DataFrame, viewer: Viewer, as_of: Column) -> DataFrame:
    """Open postings of the last week the viewer has not touched, that fit strongly."""
    seen = interactions.filter(F.col("user_id") == F.lit(viewer.user_id)).select(F.col("posting_id").alias("id"))
    rows = frame.filter(
        F.col("closed_at").isNull() & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(NEW_WINDOW_DAYS)))
    ).join(seen, "id", "left_anti")
    wishes = LiteralWishes(viewer.profile)
    if viewer.profile.configured:
        conditions = [match_predicate(wishes), exclusion(wishes)]
        score = viewer_score(viewer, as_of)
        conditions.append(None if score is None else score >= STRONG_FIT_SCORE)
        rows = rows.filter(_all([c for c in conditions if c is not None]))
    return rows.agg(F.count("*").alias("new_count"))


def facets(frame: DataFrame, q: BoardQuery, viewer: Viewer, as_of: Column) -> DataFrame:
    """(dimension, value, label, count) for six dimensions, each under all filters but its own.

    One pass: a row is emitted for a dimension when it fails no other dimension's filter. Values
    within a posting are distinct, so counting rows counts postings and combines map-side.
    """
    common = frame.filter(_all(common_filters(q, viewer, as_of)))
    own = dimension_filters(q)
    others = {d: _all([c for name, c in own.items() if name != d]) for d in FACET_SIZES}
    kind = "array<struct<dimension:string,value:string,label:string>>"

    def single(d: str, label: Column) -> Column:
        item = F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), label.alias("label"))
        return F.when(F.col(d).isNotNull() & others[d], F.array(item)).otherwise(F.array().cast(kind))

    def several(d: str, values: str) -> Column:
        items = F.transform(
            values, lambda v: F.struct(F.lit(d).alias("dimension"), v.alias("value"), v.alias("label"))
        )
        return F.when(others[d], items).otherwise(F.array().cast(kind))

    emitted = F.concat(
        single("company_id", F.col("company_name")),
        *[single(d, F.col(d)) for d in ("department", "employment_type", "remote_type")],
        several("city", "city_list"),
        several("country", "country_list"),
    )
    counts = (
        common.select(F.explode(emitted).alias("e"))
        .groupBy("e.dimension", "e.value", "e.label")
        .agg(F.count("*").alias("count"))
    )
    ranked = top_per_key(counts, ["dimension"], [F.col("count").desc(), F.col("value")], max(FACET_SIZES.values()))
    # The four scalar dimensions keep thirty of the forty.
    place = F.row_number().over(W.partitionBy("dimension").orderBy(F.col("count").desc(), "value"))
    size = F.when(F.col("dimension").isin("city", "country"), FACET_SIZES["city"]).otherwise(FACET_SIZES["company_id"])
    return ranked.withColumn("_place", place).filter(F.col("_place") <= size).drop("_place")

