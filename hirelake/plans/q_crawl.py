"""Crawl state, lifecycle and board discovery queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import crawl as c
from hirelake.operators import lifecycle as lc
from hirelake.plans.domain import EVENTS_AT, POSTINGS_AT, Domain, at, pick
from hirelake.plans.registry import query
from hirelake.plans.views import pick as pick_sql
from hirelake.plans.views import q as quoted

NOW = f"TIMESTAMP '{POSTINGS_AT}'"
LATER = f"TIMESTAMP '{EVENTS_AT}'"


# --- lifecycle ------------------------------------------------------------------------

# What boards list now: two thirds of the postings by url or by id; every ninth board only in part.
LISTED = """SELECT company_id, source, CASE WHEN id % 2 = 0 THEN url ELSE 'https://elsewhere.example.com/' || id END AS url,
  CASE WHEN id % 4 <> 0 THEN external_id END AS external_id, company_id % 9 = 0 AS partial FROM posting WHERE id % 3 <> 0 AND company_id % 5 <> 0"""


def listed(d: Domain) -> DataFrame:
    i = F.col("id")
    return d.postings.filter((i % 3 != 0) & (F.col("company_id") % 5 != 0)).select(
        "company_id", "source",
        F.when(i % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://elsewhere.example.com/"), i.cast("string"))).alias("url"),
        F.when(i % 4 != 0, F.col("external_id")).alias("external_id"), (F.col("company_id") % 9 == 0).alias("partial"),
    )


@query(
    "reconcile",
    f"""WITH listed AS ({LISTED}), done AS (SELECT company_id, source FROM listed GROUP BY 1, 2 HAVING NOT bool_or(partial)),
    gone AS (SELECT p.id FROM posting p JOIN done USING (company_id, source) WHERE p.closed_at IS NULL
      AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.company_id = p.company_id AND l.source = p.source AND l.url = p.url)
      AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.company_id = p.company_id AND l.source = p.source AND l.external_id = p.external_id))
    SELECT p.id, CASE WHEN g.id IS NOT NULL THEN {NOW} ELSE closed_at END AS closed_at, CASE WHEN g.id IS NOT NULL THEN 'REMOVED_FROM_LISTING' ELSE closed_reason END AS closed_reason FROM posting p LEFT JOIN gone g ON g.id = p.id""",
)
def reconcile(d: Domain) -> DataFrame:
    return lc.reconcile(d.postings, listed(d), at(POSTINGS_AT)).select("id", "closed_at", "closed_reason")


@query(
    "close_expired",
    f"SELECT id, CASE WHEN x THEN {NOW} ELSE closed_at END AS closed_at, CASE WHEN x THEN 'EXPIRED' ELSE closed_reason END AS closed_reason FROM (SELECT *, closed_at IS NULL AND coalesce(valid_through < {NOW}, false) AS x FROM posting)",
)
def close_expired(d: Domain) -> DataFrame:
    return lc.close_expired(d.postings, at(POSTINGS_AT)).select("id", "closed_at", "closed_reason")


@query(
    "find_stale",
    f"""SELECT id, url FROM posting p WHERE closed_at IS NULL AND (last_validated_at IS NULL OR last_validated_at < {NOW} - INTERVAL 48 HOUR)
    ORDER BY CASE WHEN EXISTS (SELECT 1 FROM interaction i WHERE i.posting_id = p.id AND (i.saved OR i.application_id IS NOT NULL)) THEN 0 ELSE 1 END, last_validated_at ASC NULLS FIRST, id LIMIT 9999""",
)
def find_stale(d: Domain) -> DataFrame:
    return lc.find_stale(d.postings, d.interactions, at(POSTINGS_AT), limit=9999)


@query("backfill_last_seen", "SELECT id, CASE WHEN id % 3 = 0 THEN updated_at ELSE last_seen_at END AS last_seen_at FROM posting")
def backfill_last_seen(d: Domain) -> DataFrame:
    rows = d.postings.withColumn("last_seen_at", F.when(F.col("id") % 3 != 0, F.col("last_seen_at")))
    return lc.backfill_last_seen(rows).select("id", "last_seen_at")


VERDICTS = "SELECT id, id % 4 <> 0 AS alive, CASE WHEN id % 8 = 0 THEN 'MARKED_CLOSED' END AS reason FROM posting WHERE id % 5 < 3"


def verdicts(d: Domain) -> DataFrame:
    i = F.col("id")
    return d.postings.filter(i % 5 < 3).select("id", (i % 4 != 0).alias("alive"), F.when(i % 8 == 0, "MARKED_CLOSED").alias("reason"))


@query(
    "apply_validity",
    f"""SELECT p.id, CASE WHEN v.alive OR (NOT v.alive AND closed_at IS NULL) THEN {NOW} ELSE last_validated_at END AS last_validated_at,
      CASE WHEN NOT v.alive AND closed_at IS NULL THEN {NOW} ELSE closed_at END AS closed_at,
      CASE WHEN NOT v.alive AND closed_at IS NULL THEN coalesce(v.reason, 'DEAD_LINK') ELSE closed_reason END AS closed_reason FROM posting p LEFT JOIN ({VERDICTS}) v ON v.id = p.id""",
)
def apply_validity(d: Domain) -> DataFrame:
    return lc.apply_validity(d.postings, verdicts(d), at(POSTINGS_AT)).select("id", "last_validated_at", "closed_at", "closed_reason")


@query("validity_counts", f"SELECT (SELECT count(*) FROM posting p JOIN ({VERDICTS}) v ON v.id = p.id WHERE NOT alive AND closed_at IS NULL) AS closed, (SELECT count(*) FROM ({VERDICTS}) WHERE alive) AS confirmed")
def validity_counts(d: Domain) -> DataFrame:
    return lc.validity_counts(d.postings, verdicts(d))


# --- work list and source state -----------------------------------------------------------

# One state row per company's careers page, last touched by the supplier's own events.
SOURCES = """SELECT 'https://jobs.lever.co/team' || n AS url, 'lever' AS platform, CASE WHEN n % 4 = 0 THEN n % 9 ELSE 0 END AS failure_count, n AS job_count, n % 3 = 0 AS requires_browser,
  TIMESTAMP '2024-01-30' + to_hours(CAST(n % 48 AS INTEGER)) AS last_checked_at, CASE WHEN n % 5 <> 0 THEN TIMESTAMP '2024-01-29' + to_hours(CAST(n % 72 AS INTEGER)) END AS last_synced_at
  FROM (SELECT DISTINCT s_suppkey // 2 AS n FROM supplier WHERE s_suppkey % 3 = 0)"""


def sources(d: Domain) -> DataFrame:
    n = F.col("n")
    hours = lambda m: F.make_dt_interval(F.lit(0), (n % m).cast("int"))
    rows = d.raw("supplier").filter("s_suppkey % 3 = 0").select(F.floor(F.col("s_suppkey") / 2).alias("n")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        F.concat(F.lit("https://jobs.lever.co/team"), n.cast("string")).alias("url"), F.lit("lever").alias("platform"),
        none("string").alias("strategy"), none("string").alias("etag"), none("string").alias("last_modified"), none("string").alias("content_hash"),
        n.cast("int").alias("job_count"), (n % 3 == 0).alias("requires_browser"),
        F.when(n % 4 == 0, n % 9).otherwise(0).cast("int").alias("failure_count"), none("string").alias("last_error"),
        (at("2024-01-30") + hours(48)).alias("last_checked_at"), none("timestamp_ntz").alias("last_changed_at"),
        F.when(n % 5 != 0, at("2024-01-29") + hours(72)).alias("last_synced_at"),
    )


WORK = f"""SELECT url, list_sort(list(DISTINCT company_id)) AS ids FROM (
  SELECT CASE WHEN careers_url IS NULL THEN website ELSE regexp_replace(replace(careers_url, 'Jobs.Lever.co', 'jobs.lever.co'), '/$', '') END AS url, id AS company_id
    FROM company WHERE status <> 'REJECTED' AND coalesce(careers_url, website) IS NOT NULL
  UNION ALL SELECT w.careers_url, w.company_id FROM watch w WHERE w.careers_url IS NOT NULL) GROUP BY 1"""


@query(
    "crawl_worklist",
    f"""WITH work AS ({WORK}), src AS ({SOURCES}) SELECT work.url, array_to_string(ids, ',') AS companies, platform, coalesce(failure_count, 0) AS failure_count, coalesce(job_count, 0) AS job_count, last_checked_at
    FROM work LEFT JOIN src ON src.url = work.url""",
)
def crawl_worklist(d: Domain) -> DataFrame:
    work = c.crawl_worklist(d.companies, d.watches, sources(d))
    ids = F.array_join(F.transform("companies", lambda x: x["company_id"].cast("string")), ",")
    return work.select("url", ids.alias("companies"), "platform", "failure_count", "job_count", "last_checked_at")


@query(
    "watched_companies_feed",
    """SELECT w.user_id, u.email AS user_email, coalesce(u.name, u.email) AS user_name, w.company_id, c.name AS company_name, coalesce(w.careers_url, c.careers_url) AS careers_url, coalesce(w.website, c.website) AS website
    FROM watch w JOIN company c ON c.id = w.company_id JOIN users u ON u.user_id = w.user_id""",
)
def watched_companies_feed(d: Domain) -> DataFrame:
    return c.watched_companies_feed(d.watches, d.companies, d.users)


# A finished run per event; errors fail it. Sources are shared by users modulo the board count.
RUNS = """SELECT 'https://jobs.lever.co/team' || (user_id % 60) AS url, ts, CASE WHEN event_type = 'error' THEN 'HTTP ' || event_id END AS error, event_type = 'purchase' AS changed,
  event_type IN ('purchase', 'view') AS synced, CASE WHEN event_type = 'view' THEN CAST(event_id AS INTEGER) END AS job_count FROM events"""


def runs(d: Domain) -> DataFrame:
    kind = F.col("event_type")
    none = lambda n: F.lit(None).cast("string").alias(n)
    return d.raw("events").select(
        F.concat(F.lit("https://JOBS.lever.co/team"), (F.col("user_id") % 60).cast("string"), F.lit("/")).alias("url"), F.col("ts").alias("at"),
        F.when(kind == "error", F.concat(F.lit("HTTP "), F.col("event_id").cast("string"))).alias("error"),
        (kind == "purchase").alias("changed"), kind.isin("purchase", "view").alias("synced"),
        F.when(kind == "view", F.col("event_id").cast("int")).alias("job_count"), none("platform"), none("strategy"), none("etag"),
        none("last_modified"), none("content_hash"), F.lit(None).cast("boolean").alias("requires_browser"),
    )


@query(
    "update_source_state",
    f"""WITH src AS ({SOURCES}), r AS ({RUNS}), ok AS (SELECT url, max(ts) AS ok_at FROM r WHERE error IS NULL GROUP BY 1),
    f AS (SELECT r.url, max(ts) AS last_at, max(ok_at) AS ok_at, count(*) FILTER (WHERE error IS NOT NULL AND (ok_at IS NULL OR ts > ok_at)) AS errors, arg_max_null(error, ts) AS error,
      max(ts) FILTER (WHERE changed) AS changed_at, max(ts) FILTER (WHERE synced) AS synced_at, max_by(job_count, ts) FILTER (WHERE job_count IS NOT NULL) AS jobs FROM r LEFT JOIN ok ON ok.url = r.url GROUP BY 1)
    SELECT coalesce(src.url, f.url) AS url, CAST(CASE WHEN f.url IS NULL THEN failure_count WHEN ok_at IS NOT NULL THEN errors ELSE coalesce(failure_count, 0) + errors END AS INTEGER) AS failure_count,
      f.error AS last_error, coalesce(jobs, job_count) AS job_count, coalesce(last_at, last_checked_at) AS last_checked_at, changed_at AS last_changed_at, coalesce(synced_at, last_synced_at) AS last_synced_at
    FROM src FULL JOIN f ON f.url = src.url""",
)
def update_source_state(d: Domain) -> DataFrame:
    out = c.update_source_state(sources(d), runs(d))
    return out.select("url", "failure_count", "last_error", "job_count", "last_checked_at", "last_changed_at", "last_synced_at")


_H = lambda col: f"coalesce((epoch_us({LATER}) - epoch_us({col})) / 3600000000.0, 1e18)"
_BACK = "CASE WHEN failure_count < 4 THEN 0 ELSE least(24, power(2, least(failure_count - 4, 4))) END"


@query(
    "plan_source",
    f"""WITH src AS ({SOURCES}), x AS (SELECT *, {_H('last_checked_at')} AS since, {_H('last_synced_at')} AS synced, {_BACK} AS backoff FROM src),
    y AS (SELECT *, (backoff > 0 AND since < backoff) OR (requires_browser AND since < 4) AS skip FROM x)
    SELECT url, skip, skip OR (NOT requires_browser AND since < 4) AS fast_only, NOT skip AND synced >= 24 AS reconcile FROM y""",
)
def plan_source(d: Domain) -> DataFrame:
    return c.plan_source(sources(d), at(EVENTS_AT), "fast").select("url", "skip", "fast_only", "reconcile")


OUTCOMES = """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'skipped' WHEN event_type = 'view' THEN 'not_modified' WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'failed'
  WHEN event_id % 3 = 0 THEN 'empty' ELSE 'ingested' END AS outcome, event_id % 7 AS inserted FROM events"""


def finished(d: Domain) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    return d.raw("events").select(
        "event_id", (kind == "signup").alias("skip"), (kind == "view").alias("not_modified"), (i % 3).alias("jobs"),
        F.when(kind == "error", "timeout").alias("error"), (i % 7).alias("inserted"),
    )


@query("classify_run", f"SELECT event_id, outcome FROM ({OUTCOMES})")
def classify_run(d: Domain) -> DataFrame:
    return c.classify_run(finished(d)).select("event_id", "outcome")


@query(
    "cycle_summary",
    f"SELECT count(*) AS sources, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed, CAST(sum(inserted) FILTER (WHERE outcome = 'ingested') AS BIGINT) AS inserted FROM ({OUTCOMES})",
)
def cycle_summary(d: Domain) -> DataFrame:
    return c.cycle_summary(finished(d))


# --- discovery ------------------------------------------------------------------------

NAMES = ["The Acme & Sons Ltd", "Société Générale SA", "Spark", "Atlas Robotics", "É", "GmbH", "a-b"]
_NAME = f"{pick_sql('c_custkey % 8', NAMES, 'Customer')} || CASE WHEN c_custkey % 8 = 7 THEN ' ' || c_custkey ELSE '' END"
_SUFFIX = ", ".join(map(quoted, c.LEGAL_SUFFIXES))
_GENERIC = ", ".join(map(quoted, c.GENERIC_TOKENS))


@query(
    "candidate_tokens",
    f"""WITH n AS (SELECT c_custkey, {_NAME} AS name FROM customer),
    w AS (SELECT *, list_filter(string_split_regex(trim(regexp_replace(replace(lower(strip_accents(name)), '&', 'and'), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+'), lambda x: x <> '') AS words FROM n),
    p AS (SELECT *, CASE WHEN len(list_filter(words, lambda x: x NOT IN ({_SUFFIX}))) > 0 THEN list_filter(words, lambda x: x NOT IN ({_SUFFIX})) ELSE words END AS parts FROM w),
    t AS (SELECT DISTINCT c_custkey, parts, unnest([array_to_string(parts, ''), array_to_string(parts, '-'), regexp_replace(name, '[^A-Za-z0-9]', '', 'g')]) AS token FROM p)
    SELECT c_custkey, token FROM t WHERE length(token) BETWEEN 3 AND 60 AND NOT (len(parts) = 1 AND lower(token) IN ({_GENERIC}))""",
)
def candidate_tokens(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(pick(k % 8, NAMES, "Customer"), F.when(k % 8 == 7, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.lit("")))
    return d.raw("customer").select("c_custkey", F.explode(c.candidate_tokens(name)).alias("token"))


VENDORS = ["ashby", "greenhouse", "lever", "teamtailor", "smartrecruiters", "personio"]
HITS = f"""SELECT {pick_sql('o_orderkey % 6', VENDORS)} AS platform, CASE WHEN o_orderkey % 4 = 0 THEN 'Token' ELSE 'token' END || (o_custkey % 700) AS token,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 700 END AS job_count FROM orders"""


def probe_hits(d: Domain) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 700
    return d.raw("orders").select(
        pick(k % 6, VENDORS).alias("platform"),
        F.concat(F.when(k % 4 == 0, "Token").otherwise("token"), n.cast("string")).alias("token"),
        F.when(k % 5 == 0, 0).otherwise(n).alias("job_count"),
    )


CONFIRMED = f"""WITH h AS (SELECT *, list_position([{', '.join(map(quoted, VENDORS))}], platform) AS v FROM ({HITS}) WHERE job_count > 0),
  one AS (SELECT DISTINCT platform, token, job_count FROM (SELECT *, min(v) OVER (PARTITION BY token) AS best FROM h) WHERE v = best)
  SELECT platform, token, job_count FROM one QUALIFY row_number() OVER (PARTITION BY platform, lower(token) ORDER BY token = lower(token) DESC, token) = 1"""


@query("confirm_boards", CONFIRMED)
def confirm_boards(d: Domain) -> DataFrame:
    return c.confirm_boards(probe_hits(d)).select("platform", "token", "job_count")


@query("board_summary", f"SELECT platform, count(*) AS boards, CAST(sum(job_count) AS BIGINT) AS open_roles FROM ({CONFIRMED}) GROUP BY 1")
def board_summary(d: Domain) -> DataFrame:
    return c.board_summary(c.confirm_boards(probe_hits(d)))
