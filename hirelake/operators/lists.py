"""Application, company and suggestion lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.similarity import trigram_similarity
from hirelake.operators.board import as_int, one_or_many
from hirelake.operators.dashboard import tier_rank
from hirelake.schema import APPLICATION_STATUSES, COMPANY_STATUSES

# --- fixed values -----------------------------------------------------------------
APPLICATION_SORTS = ["created_at", "updated_at", "company", "position", "salary_min", "salary_max", "city", "country"]
SUGGESTION_SIMILARITY = 0.3
SUGGESTION_LIMIT = 20
OWN_PLACE_WEIGHT = 10


def contains_text(columns: list[str], text: str) -> Column:
    """Any column contains the text, case aside; `%` and `_` stand for themselves."""
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def _cleaned(value) -> list[str]:
    return [v.strip() for v in one_or_many(value) if v.strip()]


def application_rows(
    applications: DataFrame, companies: DataFrame, user_id, status=None, search: str | None = None, city=None, country=None
) -> DataFrame:
    """The user's live applications with company names, filtered."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    rows = applications.filter((F.col("user_id") == F.lit(user_id)) & F.col("deleted_at").isNull()).join(c, "company_id", "left")
    if statuses := one_or_many(status):
        rows = rows.filter(F.col("status").isin(statuses))
    if search:
        rows = rows.filter(contains_text(["company", "position", "city", "country"], search))
    if cities := _cleaned(city):
        rows = rows.filter(F.lower("city").isin([v.lower() for v in cities]))
    if countries := _cleaned(country):
        rows = rows.filter(F.upper("country").isin([v.upper() for v in countries]))
    return rows


def list_applications(
    applications: DataFrame,
    companies: DataFrame,
    user_id,
    sort_by: str = "created_at",
    sort_order: str = "desc",
    page: int = 1,
    limit: int = 20,
    **filters,
) -> DataFrame:
    """One page, best tier first, then the asked column; blank places go last."""
    if sort_by not in APPLICATION_SORTS:
        raise ValueError(f"Invalid sort_by value: {sort_by}")
    rows = application_rows(applications, companies, user_id, **filters)
    key, up = F.col(sort_by), sort_order.lower() == "asc"
    last = sort_by in ("city", "country")
    order = (key.asc_nulls_last() if up else key.desc_nulls_last() if last else key.desc_nulls_first())
    return rows.orderBy(tier_rank(), order, F.col("id")).offset((page - 1) * limit).limit(limit)


def application_totals(applications: DataFrame, companies: DataFrame, user_id, **filters) -> DataFrame:
    """`total` counts the user's live rows whatever the filters; `matched` those the filters keep."""
    every = application_rows(applications, companies, user_id).select(F.lit(1).alias("total"), F.lit(0).alias("matched"))
    kept = application_rows(applications, companies, user_id, **filters).select(F.lit(0).alias("total"), F.lit(1).alias("matched"))
    return every.unionByName(kept).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched")
    )


def applications_with_files(applications: DataFrame, users: DataFrame, companies: DataFrame, files: DataFrame) -> DataFrame:
    """Applications joined to owner, company and both documents; the file bytes are never read."""
    f = lambda prefix: files.select(
        F.col("id").alias(f"{prefix}_file_id"), F.col("name").alias(f"{prefix}_name"), F.col("byte_size").alias(f"{prefix}_bytes")
    )
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return (
        applications.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left")
        .join(c, "company_id", "left")
        .join(f("resume"), "resume_file_id", "left")
        .join(f("cover_letter"), "cover_letter_file_id", "left")
    )


def company_filters(companies: DataFrame, search: str | None = None, industry=None, status=None) -> DataFrame:
    rows = companies
    if search:
        rows = rows.filter(contains_text(["name", "industry", "country"], search))
    if statuses := one_or_many(status):
        rows = rows.filter(F.col("status").isin(statuses))
    if industries := one_or_many(industry):
        rows = rows.filter(F.col("industry").isin(industries))
    return rows


def list_companies(
    companies: DataFrame, search=None, industry=None, status=None, sort_by="created_at", sort_order="desc", page=1, limit=12
) -> DataFrame:
    key = F.col(sort_by)
    order = key.asc_nulls_last() if sort_order == "asc" else key.desc_nulls_first()
    size = as_int(limit) or 12
    return company_filters(companies, search, industry, status).orderBy(order, F.col("id")).offset((page - 1) * size).limit(size)


def company_status_counts(companies: DataFrame, search=None, industry=None) -> DataFrame:
    """One row with a count per status under the search and industry filters; no status filter."""
    return company_filters(companies, search, industry).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in COMPANY_STATUSES]
    )


def watched_with_counts(watches: DataFrame, companies: DataFrame, applications: DataFrame) -> DataFrame:
    """Each user's followed companies with that user's number of applications there."""
    n = applications.groupBy("user_id", "company_id").agg(F.count("*").alias("applications_count"))
    c = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("careers_url").alias("_careers"), F.col("website").alias("_site")
    )
    return (
        watches.join(c, "company_id")
        .join(n, ["user_id", "company_id"], "left")
        .select(
            "user_id", "company_id", "company_name",
            F.coalesce("careers_url", "_careers").alias("careers_url"),
            F.coalesce("website", "_site").alias("website"),
            "notes",
            F.coalesce("applications_count", F.lit(0)).alias("applications_count"),
        )
    )


def suggest_companies(companies: DataFrame, watches: DataFrame, user_id, text: str, limit: int = SUGGESTION_LIMIT) -> DataFrame:
    """Names that resemble or contain the text, among approved or followed companies."""
    wanted = (text or "").strip()
    mine = watches.filter(F.col("user_id") == F.lit(user_id)).select(F.col("company_id").alias("id")).distinct().withColumn("_mine", F.lit(True))
    sim = trigram_similarity(F.col("name"), F.lit(wanted))
    return (
        companies.join(mine, "id", "left")
        .filter((F.col("status") == "APPROVED") | F.col("_mine"))
        .select("id", "name", sim.alias("similarity"))
        .filter((F.col("similarity") >= SUGGESTION_SIMILARITY) | F.contains(F.lower("name"), F.lit(wanted.lower())))
        .orderBy(F.col("similarity").desc(), "name", "id")
        .limit(limit or SUGGESTION_LIMIT)
    )


def location_suggestions(applications: DataFrame, places: DataFrame, user_id, text: str = "", limit: int = 20) -> DataFrame:
    """Places by how often they are used; the user's own count ten times, deleted ones included."""
    wanted = (text or "").strip()

    def counted(df: DataFrame, weight: int) -> DataFrame:
        if wanted:
            df = df.filter(contains_text(["city", "country"], wanted))
        return df.groupBy(
            F.coalesce("city", F.lit("")).alias("city"), F.upper(F.coalesce("country", F.lit(""))).alias("country")
        ).agg((F.count("*") * weight).alias("uses"))

    named = (F.coalesce("city", F.lit("")) != "") | (F.coalesce("country", F.lit("")) != "")
    own = applications.filter((F.col("user_id") == F.lit(user_id)) & named)
    real = (F.col("city") == "") | ((F.length("city") > 1) & F.col("city").rlike(r"\p{L}"))
    scraped = places.filter(named & real & ~F.col("city").rlike(r"(?i)\A[0-9]+ +locations?\z"))
    return (
        counted(own.select("city", "country"), OWN_PLACE_WEIGHT)
        .unionByName(counted(scraped.select("city", "country"), 1))
        .groupBy("city", "country")
        .agg(F.sum("uses").alias("uses"))
        .orderBy(F.col("uses").desc(), F.col("city") == "", "city", "country")
        .limit(max(limit, 1))
    )


def kanban_columns(applications: DataFrame) -> DataFrame:
    """(user_id, status, ids): each column's cards in display order.

    A user's board is what one person keeps by hand, so a column is a small group.
    """
    item = F.struct(
        F.coalesce("kanban_order", F.lit(9007199254740991)).alias("o"), F.col("created_at").alias("c"), F.col("id").alias("id")
    )
    lists = applications.filter(F.col("status").isin(APPLICATION_STATUSES)).groupBy("user_id", "status").agg(
        F.array_sort(F.collect_list(item)).alias("cards")
    )
    return lists.select("user_id", "status", F.transform("cards", lambda c: c["id"]).alias("ids"))


def kanban_positions(applications: DataFrame) -> DataFrame:
    """(user_id, status, id, position): the same order as rows."""
    order = W.partitionBy("user_id", "status").orderBy(
        F.col("kanban_order").asc_nulls_last(), F.col("created_at"), F.col("id")
    )
    return applications.select("user_id", "status", "id", "kanban_order", (F.row_number().over(order) - 1).alias("position"))


def reindex_column(columns: DataFrame, applications: DataFrame) -> DataFrame:
    """(id, kanban_order) of the cards whose place in (user_id, status, ids) differs from the stored one."""
    placed = columns.select(F.posexplode("ids").alias("kanban_order", "id"))
    stored = applications.select("id", F.col("kanban_order").alias("_stored"))
    return placed.join(stored, "id").filter(~F.col("kanban_order").eqNullSafe(F.col("_stored"))).select("id", "kanban_order")


def document_catalogue(files: DataFrame, user_id, kind: str | None = None) -> DataFrame:
    """A user's documents, newest first, without their content."""
    rows = files.filter(F.col("user_id") == F.lit(user_id))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows.select("id", "kind", "name", "filename", "byte_size", "stored_size", "created_at", "updated_at").orderBy(
        F.col("created_at").desc(), "id"
    )
