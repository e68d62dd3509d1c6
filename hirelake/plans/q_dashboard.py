"""Dashboard, list and suggestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import dashboard as b
from hirelake.operators import lists as li
from hirelake.plans.domain import APPLICATIONS_AT, Domain, at
from hirelake.plans.registry import query

NOW = f"TIMESTAMP '{APPLICATIONS_AT}'"
LIVE = "(SELECT * FROM application WHERE deleted_at IS NULL)"
USER = 42


def as_of():
    return at(APPLICATIONS_AT)


def live(d: Domain) -> DataFrame:
    return d.applications.filter("deleted_at IS NULL")


@query("count_by_status", f"SELECT user_id, status, count(*) AS count FROM {LIVE} GROUP BY 1, 2")
def count_by_status(d: Domain) -> DataFrame:
    return b.count_by_status(live(d))


_N = lambda s: f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}"
_STALE = f"status = 'APPLIED' AND applied_at < {NOW} - INTERVAL 14 DAY"
FUNNEL = f"""SELECT user_id, {', '.join(map(_N, b.COUNTED))}, count(*) FILTER (WHERE status <> 'NOT_ELIGIBLE') AS total_applications,
  count(*) FILTER (WHERE {_STALE}) AS stale_applied, count(*) FILTER (WHERE applied_at >= {NOW} - INTERVAL 7 DAY) AS applied_this_week,
  count(*) FILTER (WHERE applied_at >= {NOW} - INTERVAL 14 DAY AND applied_at < {NOW} - INTERVAL 7 DAY) AS applied_last_week,
  count(*) FILTER (WHERE status IN ('INTERVIEW', 'OFFER', 'REJECTED')) AS answered,
  count(*) FILTER (WHERE applied_at IS NOT NULL OR status IN ('APPLIED', 'INTERVIEW', 'OFFER', 'REJECTED', 'GHOSTED')) AS ever_sent FROM {LIVE} GROUP BY 1"""


@query("funnel_stats", f"SELECT *, CAST(floor(answered / nullif(ever_sent, 0)::DOUBLE * 100 + 0.5) AS INTEGER) AS response_rate FROM ({FUNNEL})")
def funnel_stats(d: Domain) -> DataFrame:
    return b.funnel_stats(live(d), as_of())


@query("sent_between", f"SELECT user_id, applied_this_week, applied_last_week FROM ({FUNNEL})")
def sent_between(d: Domain) -> DataFrame:
    week, two = as_of() - F.make_dt_interval(F.lit(7)), as_of() - F.make_dt_interval(F.lit(14))
    return live(d).groupBy("user_id").agg(
        b.sent_between(week).alias("applied_this_week"), b.sent_between(two, week).alias("applied_last_week")
    )


PER_DAY = f"SELECT user_id, strftime(applied_at, '%Y-%m-%d') AS date, count(*) AS sent FROM {LIVE} WHERE applied_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2"


@query("sent_per_day", PER_DAY)
def sent_per_day(d: Domain) -> DataFrame:
    return b.sent_per_day(live(d), as_of())


DAYS = f"SELECT strftime({NOW} - to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS date, i FROM range(0, 30) r(i)"


@query(
    "activity",
    f"WITH per_day AS ({PER_DAY}) SELECT u.user_id, c.date, coalesce(p.sent, 0) AS sent FROM (SELECT DISTINCT user_id FROM {LIVE}) u CROSS JOIN ({DAYS}) c LEFT JOIN per_day p ON p.user_id = u.user_id AND p.date = c.date",
)
def activity(d: Domain) -> DataFrame:
    return b.activity(live(d), as_of())


STREAK = f"""WITH per_day AS ({PER_DAY}), b AS (SELECT user_id, i FROM per_day JOIN ({DAYS}) c USING (date)),
  s AS (SELECT user_id, i, CASE WHEN min(i) OVER (PARTITION BY user_id) = 0 THEN 0 ELSE 1 END AS start FROM b),
  r AS (SELECT user_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 + start AS want FROM s WHERE i >= start) WHERE i = want GROUP BY 1)
  SELECT u.user_id, CAST(coalesce(r.n, 0) AS INTEGER) AS streak_days FROM (SELECT DISTINCT user_id FROM {LIVE}) u LEFT JOIN r USING (user_id)"""


@query("streak", STREAK)
def streak(d: Domain) -> DataFrame:
    return b.streak(live(d), as_of())


@query("stale_count", f"SELECT user_id, stale_applied FROM ({FUNNEL})")
def stale_count(d: Domain) -> DataFrame:
    return live(d).groupBy("user_id").agg(F.count_if(b.stale(as_of())).alias("stale_applied"))


_SINCE = f"CAST(greatest(0, date_diff('day', coalesce(applied_at, created_at), {NOW})) AS INTEGER) AS days_since"


@query(
    "stale_list",
    f"SELECT r.*, c.name AS company_name FROM (SELECT user_id, id, applied_at, company_id, {_SINCE} FROM {LIVE} WHERE {_STALE} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY applied_at, id) <= 5) r LEFT JOIN company c ON c.id = r.company_id",
)
def stale_list(d: Domain) -> DataFrame:
    rows = b.with_company_name(b.stale_list(live(d), as_of()), d.companies)
    return rows.select("user_id", "id", "applied_at", "company_id", "days_since", "company_name")


_TIER = "CASE tier WHEN 'S_TIER' THEN 1 WHEN 'A_TIER' THEN 2 WHEN 'B_TIER' THEN 3 ELSE 4 END"


@query(
    "list_by_status",
    f"SELECT r.*, c.name AS company_name FROM (SELECT user_id, id, tier, company_id, {_SINCE} FROM {LIVE} WHERE status = 'WISHLIST' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_TIER}, created_at, id) <= 5) r LEFT JOIN company c ON c.id = r.company_id",
)
def list_by_status(d: Domain) -> DataFrame:
    rows = b.with_company_name(b.list_by_status(live(d), "WISHLIST", as_of()), d.companies)
    return rows.select("user_id", "id", "tier", "company_id", "days_since", "company_name")


@query("days_since", f"SELECT id, {_SINCE} FROM application")
def days_since(d: Domain) -> DataFrame:
    return d.applications.select("id", b.days_since(as_of()).alias("days_since"))


@query("overview", f"WITH s AS ({STREAK}) SELECT f.*, CAST(floor(answered / nullif(ever_sent, 0)::DOUBLE * 100 + 0.5) AS INTEGER) AS response_rate, s.streak_days FROM ({FUNNEL}) f JOIN s USING (user_id)")
def overview(d: Domain) -> DataFrame:
    return b.overview(live(d), as_of())


# --- lists ----------------------------------------------------------------------------

LISTER = 84  # has applications in the places that are asked for
_OF = lambda user: f"(SELECT a.*, c.name AS company FROM {LIVE} a LEFT JOIN company c ON c.id = a.company_id WHERE a.user_id = {user})"
_MINE = _OF(USER)
_FILTER = "lower(city) IN ('paris', 'lyon') AND status IN ('APPLIED', 'INTERVIEW', 'OFFER', 'REJECTED')"


@query("list_applications", f"SELECT id, position, company, city, tier FROM {_OF(LISTER)} WHERE {_FILTER} ORDER BY {_TIER}, city ASC NULLS LAST, id LIMIT 20")
def list_applications(d: Domain) -> DataFrame:
    rows = li.list_applications(
        d.applications, d.companies, LISTER, sort_by="city", sort_order="asc", city=["Paris ", "LYON"], status=["APPLIED", "INTERVIEW", "OFFER", "REJECTED"]
    )
    return rows.select("id", "position", "company", "city", "tier")


@query("list_applications_search", f"SELECT id, position, tier FROM {_MINE} WHERE contains(lower(position), 'engineer') OR contains(lower(coalesce(company, '')), 'engineer') ORDER BY {_TIER}, salary_min DESC, id LIMIT 20")
def list_applications_search(d: Domain) -> DataFrame:
    return li.list_applications(d.applications, d.companies, USER, sort_by="salary_min", search="Engineer").select("id", "position", "tier")


@query("application_totals", f"SELECT (SELECT count(*) FROM {_MINE}) AS total, (SELECT count(*) FROM {_MINE} WHERE {_FILTER}) AS matched")
def application_totals(d: Domain) -> DataFrame:
    return li.application_totals(d.applications, d.companies, USER, city=["Paris ", "LYON"], status=["APPLIED", "INTERVIEW", "OFFER", "REJECTED"])


@query(
    "kanban_columns",
    f"SELECT user_id, status, array_to_string(list(id ORDER BY kanban_order ASC NULLS LAST, created_at, id), ',') AS ids FROM {LIVE} GROUP BY 1, 2",
)
def kanban_columns(d: Domain) -> DataFrame:
    return li.kanban_columns(live(d)).select("user_id", "status", F.array_join("ids", ",").alias("ids"))


@query(
    "reindex_column",
    f"SELECT id, CAST(pos AS INTEGER) AS kanban_order FROM (SELECT id, kanban_order, row_number() OVER (PARTITION BY user_id, status ORDER BY kanban_order ASC NULLS LAST, created_at, id) - 1 AS pos FROM {LIVE}) WHERE pos IS DISTINCT FROM kanban_order",
)
def reindex_column(d: Domain) -> DataFrame:
    return li.reindex_column(li.kanban_columns(live(d)), d.applications)




@query("list_companies", "SELECT id, name, industry FROM company WHERE contains(lower(name), '#0000000') AND status IN ('APPROVED', 'PENDING') AND industry IN ('AI', 'RETAIL') ORDER BY created_at DESC, id LIMIT 12 OFFSET 12")
def list_companies(d: Domain) -> DataFrame:
    return li.list_companies(d.companies, search="#0000000", status=["APPROVED", "PENDING"], industry=["AI", "RETAIL"], page=2).select("id", "name", "industry")


@query("company_status_counts", "SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'APPROVED') AS approved, count(*) FILTER (WHERE status = 'REJECTED') AS rejected FROM company WHERE contains(lower(name), 'supplier') AND industry = 'AI'")
def company_status_counts(d: Domain) -> DataFrame:
    return li.company_status_counts(d.companies, search="Supplier", industry="AI")


@query(
    "watched_with_counts",
    """SELECT w.user_id, w.company_id, c.name AS company_name, coalesce(w.careers_url, c.careers_url) AS careers_url, coalesce(n, 0) AS applications_count FROM watch w JOIN company c ON c.id = w.company_id
    LEFT JOIN (SELECT user_id, company_id, count(*) AS n FROM application WHERE deleted_at IS NULL GROUP BY 1, 2) a ON a.user_id = w.user_id AND a.company_id = w.company_id""",
)
def watched_with_counts(d: Domain) -> DataFrame:
    return li.watched_with_counts(d.watches, d.companies, live(d)).select("user_id", "company_id", "company_name", "careers_url", "applications_count")


_G = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    "suggest_companies",
    f"""WITH g AS (SELECT c.id, c.name, c.status, w.company_id AS mine, {_G.format('c.name')} AS a, {_G.format("'Supplier#000000042'")} AS b FROM company c
      LEFT JOIN (SELECT DISTINCT company_id FROM watch WHERE user_id = 8) w ON w.company_id = c.id)
    SELECT id, name, round(s, 9) AS similarity FROM (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS s FROM g)
    WHERE (status = 'APPROVED' OR mine IS NOT NULL) AND (s >= 0.3 OR contains(lower(name), 'supplier#000000042')) ORDER BY s DESC, name, id LIMIT 20""",
)
def suggest_companies(d: Domain) -> DataFrame:
    return li.suggest_companies(d.companies, d.watches, 8, " Supplier#000000042").withColumn("similarity", F.round("similarity", 9))


@query(
    "location_suggestions",
    f"""SELECT city, country, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT coalesce(city, '') AS city, upper(coalesce(country, '')) AS country, count(*) * 10 AS uses FROM application WHERE user_id = {USER}
      AND (coalesce(city, '') <> '' OR coalesce(country, '') <> '') GROUP BY 1, 2
      UNION ALL SELECT city, upper(country), count(*) FROM place WHERE (city <> '' OR country <> '') AND (city = '' OR (length(city) > 1 AND regexp_matches(city, '\\p{{L}}')))
        AND NOT regexp_matches(city, '(?i)^[0-9]+ +locations?$') GROUP BY 1, 2) GROUP BY 1, 2 ORDER BY uses DESC, city = '', city, country LIMIT 20""",
)
def location_suggestions(d: Domain) -> DataFrame:
    return li.location_suggestions(d.applications, d.places, USER)


@query(
    "location_suggestions_search",
    f"""SELECT city, country, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT coalesce(city, '') AS city, upper(coalesce(country, '')) AS country, 10 AS uses FROM application WHERE user_id = {USER}
      AND (coalesce(city, '') <> '' OR coalesce(country, '') <> '') AND (lower(city) LIKE '%r%' OR lower(country) LIKE '%r%')
      UNION ALL SELECT city, upper(country), 1 FROM place WHERE lower(city) LIKE '%r%' OR lower(country) LIKE '%r%') GROUP BY 1, 2 ORDER BY uses DESC, city = '', city, country LIMIT 50""",
)
def location_suggestions_search(d: Domain) -> DataFrame:
    return li.location_suggestions(d.applications, d.places, USER, "R", 50)


def files(d: Domain) -> DataFrame:
    """A document per order line-up: owner, kind and sizes, with content nobody selects."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "RESUME").when(k % 4 == 1, "COVER_LETTER").when(k % 4 == 2, "DIPLOMA").otherwise("CERTIFICATE")
    return d.raw("orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), kind.alias("kind"), F.concat(F.lit("file "), k.cast("string")).alias("name"),
        F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("filename"), (k % 1000 + 100).alias("byte_size"), (k % 500 + 50).alias("stored_size"),
        F.to_binary(F.lit("ff"), F.lit("hex")).alias("content"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


@query(
    "document_catalogue",
    f"""SELECT o_orderkey AS id, 'RESUME' AS kind, 'f' || o_orderkey || '.pdf' AS filename, o_orderkey % 1000 + 100 AS byte_size, o_orderkey % 500 + 50 AS stored_size, o_orderdate AS created_at
    FROM orders WHERE o_custkey = {USER} AND o_orderkey % 4 = 0""",
)
def document_catalogue(d: Domain) -> DataFrame:
    return li.document_catalogue(files(d), USER, "RESUME").select("id", "kind", "filename", "byte_size", "stored_size", "created_at")


@query(
    "applications_with_files",
    f"""SELECT a.id, u.name AS user_name, c.name AS company, CASE WHEN a.id % 4 = 0 THEN 'file ' || a.id END AS resume_name, CASE WHEN a.id % 2 = 1 THEN 'file ' || (a.id - 1) END AS cover_letter_name
    FROM application a LEFT JOIN users u ON u.user_id = a.user_id LEFT JOIN company c ON c.id = a.company_id""",
)
def applications_with_files(d: Domain) -> DataFrame:
    k = F.col("id")
    apps = d.applications.withColumns(
        {"resume_file_id": F.when(k % 4 == 0, k), "cover_letter_file_id": F.when(k % 2 == 1, k - 1)}
    )
    return li.applications_with_files(apps, d.users, d.companies, files(d)).select("id", "user_name", "company", "resume_name", "cover_letter_name")
