"""Event log, digest and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import digest as dg
from hirelake.operators import events as ev
from hirelake.plans.domain import EVENTS_AT, POSTINGS_AT, Domain, at
from hirelake.plans.q_board import points
from hirelake.plans.registry import query
from hirelake.schema import USER_RECORDABLE_EVENTS
from hirelake.session import run_folder
from hirelake.streaming import events as se
from hirelake.streaming import source_state as ss

NOW = f"TIMESTAMP '{POSTINGS_AT}'"


# --- the log --------------------------------------------------------------------------


@query(
    "append_event",
    f"SELECT event_id, type, coalesce(occurred_at, TIMESTAMP '{EVENTS_AT}') AS occurred_at FROM (SELECT event_id, type, occurred_at FROM job_event UNION ALL SELECT event_id + 1000000, type, CASE WHEN event_id % 2 = 0 THEN occurred_at END FROM job_event)",
)
def append_event(d: Domain) -> DataFrame:
    new = d.events.withColumns(
        {"event_id": F.col("event_id") + 1000000, "occurred_at": F.when(F.col("event_id") % 2 == 0, F.col("occurred_at"))}
    )
    return ev.append_event(d.events, new, at(EVENTS_AT)).select("event_id", "type", "occurred_at")


# A status feed per application: every event moves the card of application user * 10 + event % 7.
_FEED_STATUS = "CASE event_type WHEN 'view' THEN 'APPLIED' WHEN 'click' THEN 'INTERVIEW' WHEN 'purchase' THEN 'WISHLIST' WHEN 'signup' THEN 'APPLIED' ELSE 'GHOSTED' END"
_EVENT = "CASE status WHEN 'APPLIED' THEN 'APPLICATION_SENT' WHEN 'INTERVIEW' THEN 'INTERVIEW_SCHEDULED' WHEN 'GHOSTED' THEN 'MARKED_GHOSTED' END"


def feed(d: Domain) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "signup"), "APPLIED").when(kind == "click", "INTERVIEW").when(kind == "purchase", "WISHLIST").otherwise("GHOSTED")
    return d.raw("events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("application_id"), "user_id", status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq")
    )


@query(
    "status_to_event",
    f"""WITH f AS (SELECT user_id * 10 + event_id % 7 AS application_id, user_id, {_FEED_STATUS} AS status, ts, event_id FROM events),
    b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY application_id ORDER BY ts, event_id), 'WISHLIST') AS before FROM f)
    SELECT {_EVENT} AS type, ts AS occurred_at, user_id, application_id FROM b WHERE status <> before AND status <> 'WISHLIST'""",
)
def status_to_event(d: Domain) -> DataFrame:
    return ev.status_to_event(feed(d))


@query(
    "posting_status_to_event",
    """SELECT type, created_at AS occurred_at, user_id, posting_id FROM (SELECT user_id, posting_id, created_at, unnest(list_filter([CASE status WHEN 'SEEN' THEN 'POSTING_VIEWED' WHEN 'DISMISSED' THEN 'POSTING_DISMISSED' END,
    CASE WHEN posting_id % 3 = 0 THEN CASE WHEN saved THEN 'POSTING_SAVED' ELSE 'POSTING_UNSAVED' END END], lambda x: x IS NOT NULL)) AS type FROM interaction)""",
)
def posting_status_to_event(d: Domain) -> DataFrame:
    marks = d.interactions.select(
        "user_id", "posting_id", "status", F.when(F.col("posting_id") % 3 == 0, F.col("saved")).alias("saved"), F.col("created_at").alias("at")
    )
    return ev.posting_status_to_event(marks)


@query(
    "stamp_applied_at",
    "SELECT a.id, coalesce(a.applied_at, s.sent) AS applied_at FROM application a LEFT JOIN (SELECT application_id, min(occurred_at) AS sent FROM job_event WHERE type = 'APPLICATION_SENT' GROUP BY 1) s ON s.application_id = a.id",
)
def stamp_applied_at(d: Domain) -> DataFrame:
    return ev.stamp_applied_at(d.applications, d.events).select("id", "applied_at")


# Two versions of each posting: as listed at first, and retitled in mid January 2024.
VERSIONS = "SELECT id, company_id, title, created_at AS version_at FROM posting UNION ALL SELECT id, company_id, title || ' (updated)', TIMESTAMP '2024-01-15' FROM posting WHERE id % 2 = 0"
SENT_AS = "SELECT user_id, posting_id, application_id, created_at AS occurred_at, application_id AS event_id FROM interaction WHERE application_id IS NOT NULL"


def sent_events(d: Domain) -> DataFrame:
    """Each tracked application was sent when it was linked, and once more an hour later."""
    i = d.interactions.dropna(subset=["application_id"])
    again = F.explode(F.array(F.lit(0), F.lit(1)))
    return i.withColumn("n", again).select(
        F.lit("APPLICATION_SENT").alias("type"), "user_id", "application_id",
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.col("n"))).alias("occurred_at"), (F.col("application_id") * 2 + F.col("n")).alias("event_id"),
    )


@query(
    "sent_snapshot",
    f"""WITH v AS ({VERSIONS}), s AS ({SENT_AS}) SELECT s.application_id, s.posting_id, s.occurred_at AS captured_at, c.name AS company, v.title FROM s JOIN v ON v.id = s.posting_id AND v.version_at <= s.occurred_at
    JOIN company c ON c.id = v.company_id QUALIFY row_number() OVER (PARTITION BY s.application_id ORDER BY v.version_at DESC) = 1""",
)
def sent_snapshot(d: Domain) -> DataFrame:
    first = d.postings.withColumn("version_at", F.col("created_at"))
    second = d.postings.filter("id % 2 = 0").withColumns({"title": F.concat("title", F.lit(" (updated)")), "version_at": at("2024-01-15")})
    snap = ev.sent_snapshot(sent_events(d), d.interactions, first.unionByName(second), d.companies, d.places)
    return snap.select("application_id", "posting_id", "captured_at", "company", "title")


@query("timeline", "SELECT event_id, type, occurred_at FROM job_event WHERE user_id = 8 AND application_id = 83 ORDER BY occurred_at")
def timeline(d: Domain) -> DataFrame:
    return ev.timeline(d.events, 8, 83).select("event_id", "type", "occurred_at")


@query("snapshot_of", "SELECT user_id, application_id, payload FROM job_event WHERE type = 'APPLICATION_SENT' QUALIFY row_number() OVER (PARTITION BY user_id, application_id ORDER BY occurred_at, event_id) = 1")
def snapshot_of(d: Domain) -> DataFrame:
    return ev.snapshot_of(d.events)


_OWN = ", ".join(f"'{t}'" for t in USER_RECORDABLE_EVENTS)


@query("validate_user_event", f"SELECT event_id, type, type IN ({_OWN}) AS accepted FROM job_event")
def validate_user_event(d: Domain) -> DataFrame:
    good, bad = ev.validate_user_event(d.events)
    pick = lambda df, ok: df.select("event_id", "type", F.lit(ok).alias("accepted"))
    return pick(good, True).unionByName(pick(bad, False))


@query(
    "backfill_events",
    """SELECT 'POSTING_VIEWED' AS type, created_at AS occurred_at, user_id, posting_id, CAST(NULL AS BIGINT) AS application_id, CAST(NULL AS VARCHAR) AS payload FROM interaction
    UNION ALL SELECT 'POSTING_SAVED', coalesce(saved_at, created_at), user_id, posting_id, NULL, NULL FROM interaction WHERE saved
    UNION ALL SELECT 'POSTING_DISMISSED', updated_at, user_id, posting_id, NULL, NULL FROM interaction WHERE status = 'DISMISSED'
    UNION ALL SELECT 'APPLICATION_CREATED', created_at, user_id, NULL, id, NULL FROM application WHERE deleted_at IS NULL
    UNION ALL SELECT 'APPLICATION_SENT', coalesce(applied_at, created_at), user_id, NULL, id, NULL FROM application WHERE deleted_at IS NULL AND status <> 'WISHLIST'
    UNION ALL SELECT CASE status WHEN 'INTERVIEW' THEN 'INTERVIEW_SCHEDULED' WHEN 'OFFER' THEN 'OFFER_RECEIVED' WHEN 'REJECTED' THEN 'REJECTION_RECEIVED' ELSE 'MARKED_GHOSTED' END, updated_at, user_id, NULL, id, '{"backfilled": true}'
      FROM application WHERE deleted_at IS NULL AND status IN ('INTERVIEW', 'OFFER', 'REJECTED', 'GHOSTED')""",
)
def backfill_events(d: Domain) -> DataFrame:
    return ev.backfill_events(d.interactions, d.applications)


STATUS_NOW = """SELECT application_id, CASE type WHEN 'APPLICATION_SENT' THEN 'APPLIED' WHEN 'REJECTION_RECEIVED' THEN 'REJECTED' ELSE 'WISHLIST' END AS status, occurred_at AS since
  FROM job_event WHERE type IN ('APPLICATION_SENT', 'REJECTION_RECEIVED', 'APPLICATION_CREATED') QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY occurred_at DESC, event_id DESC) = 1"""


@query("status_fold", STATUS_NOW)
def status_fold(d: Domain) -> DataFrame:
    return ev.status_fold(d.events)


# --- all users at once ------------------------------------------------------------------


@query("is_configured", "SELECT c_custkey AS user_id, c_custkey % 11 <> 0 AND (n > 0) AS configured FROM (SELECT c_custkey, n FROM customer JOIN (SELECT user_id, len(domains) + len(seniorities) + len(employment_types) + len(remote_types) + len(countries) + len(cities) + len(titles) + len(keywords) + len(required_keywords) + len(industries) + len(motivations) + len(resume_keywords) + len(excluded_keywords) + len(excluded_company_ids) + coalesce(min_salary, 0) + coalesce(max_age_days, 0) AS n FROM preference) ON user_id = c_custkey)")
def is_configured(d: Domain) -> DataFrame:
    return d.preferences.select("user_id", dg.is_configured().alias("configured"))


_FLAG = lambda c: f"CAST({c} AS INTEGER)"
_SIGNALS = " + ".join(
    [_FLAG(f"len({c}) > 0") for c in ("domains", "seniorities", "employment_types", "remote_types", "titles", "keywords", "required_keywords", "industries", "motivations", "resume_keywords")]
    + [_FLAG("len(countries) + len(cities) > 0"), _FLAG("len(excluded_keywords) + len(excluded_company_ids) > 0"), _FLAG("min_salary IS NOT NULL"), _FLAG("max_age_days IS NOT NULL")]
)


@query("completeness", f"SELECT user_id, CAST(floor(({_SIGNALS}) * 100 / 14.0::DOUBLE + 0.5) AS INTEGER) AS completeness FROM preference")
def completeness(d: Domain) -> DataFrame:
    return d.preferences.select("user_id", dg.completeness().alias("completeness"))


# Pairs of a wish list and a posting, as SQL reads them, in nested loops: all of them, or those created after the user's mark.
_TOK = "list_filter(list_transform(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}+#.]+'), lambda w: trim(w, '.+#')), lambda w: w <> '')"
EVERY_DOC = f"""SELECT p.*, c.name AS company_name, c.industry, coalesce(l.cities, []) AS p_cities, coalesce(l.countries, []) AS p_countries, coalesce(l.known, false) AS place_known,
  {_TOK.format('title')} AS ta, {_TOK.format("concat_ws(' ', location, department)")} AS tb, {_TOK.format("coalesce(description, '')")} AS tc
  FROM posting p JOIN company c ON c.id = p.company_id LEFT JOIN (SELECT posting_id, list(lower(city)) FILTER (WHERE city <> '') AS cities, list(upper(country)) FILTER (WHERE country <> '') AS countries,
    bool_or(city <> '' OR country <> '') AS known FROM place GROUP BY 1) l ON l.posting_id = p.id"""
DOCS = f"{EVERY_DOC} WHERE p.closed_at IS NULL AND p.created_at > {NOW} - INTERVAL 40 DAY"


def _in(zone: str, terms: str) -> str:
    return f"len(list_filter({zone}, lambda w: len(list_filter({terms}, lambda t: starts_with(w, t))) > 0))"


_SHARE = lambda terms: f"CASE WHEN {_in('ta', terms)} > 0 OR {_in('tb', terms)} > 0 OR {_in('tc', terms)} > 1 THEN 1.0::DOUBLE WHEN {_in('tc', terms)} = 1 THEN 2.0::DOUBLE / 3.0::DOUBLE ELSE 0.0::DOUBLE END"
_NONE_OR = lambda wish, column: f"(len({wish}) = 0 OR {column} IS NULL OR list_contains({wish}, {column}))"
_ACCEPTS = "(len(remote_types) = 0 OR list_contains(remote_types, 'REMOTE'))"
_CITY, _COUNTRY = "list_has_any(p_cities, cities)", "list_has_any(p_countries, countries)"
_REMOTE = f"({_ACCEPTS} AND coalesce(remote_type = 'REMOTE', false))"
_PLACED = "len(cities) + len(countries) > 0 AND w_location > 0"
_COMPARABLE = "(wish_currency IS NULL OR salary_currency IS NULL OR salary_currency = wish_currency)"
_ENOUGH = "(coalesce(salary_max >= min_salary, false) OR coalesce(salary_min >= min_salary, false))"
_ALL_WORDS = "len(list_filter(required_keywords, lambda t: list_contains(ta, t) OR list_contains(tb, t) OR list_contains(tc, t))) = len(required_keywords)"
EVERY_PAIR = f"""SELECT pr.*, u.email, d.*, w.company_id IS NOT NULL AS followed FROM preference pr LEFT JOIN users u ON u.user_id = pr.user_id CROSS JOIN docs d
  LEFT JOIN (SELECT DISTINCT user_id, company_id FROM watch) w ON w.user_id = pr.user_id AND w.company_id = d.company_id
  WHERE ({_SIGNALS}) > 0
  AND {_NONE_OR('domains', 'domain')} AND {_NONE_OR('seniorities', 'seniority')} AND {_NONE_OR('employment_types', 'employment_type')} AND {_NONE_OR('remote_types', 'remote_type')} AND {_NONE_OR('industries', 'industry')}
  AND (NOT ({_PLACED}) OR open_to_relocation OR {_CITY} OR {_COUNTRY} OR {_REMOTE} OR NOT place_known) AND {_ALL_WORDS}
  AND (min_salary IS NULL OR coalesce(salary_max, salary_min) IS NULL OR NOT {_COMPARABLE} OR {_ENOUGH})
  AND {_in('ta', 'excluded_keywords')} + {_in('tb', 'excluded_keywords')} + {_in('tc', 'excluded_keywords')} = 0 AND NOT list_contains(excluded_company_ids, d.company_id)"""
PAIRS = f"{EVERY_PAIR} AND notify_matches AND u.email IS NOT NULL AND d.created_at > coalesce(pr.last_notified_at, {NOW} - INTERVAL 3 DAY)"


def _one_of(wish: str, column: str, n: str) -> tuple[str, str]:
    return (
        f"CASE WHEN len({wish}) > 0 AND list_contains({wish}, {column}) THEN {n} ELSE 0 END::DOUBLE",
        f"CASE WHEN len({wish}) > 0 AND {column} IS NOT NULL THEN {n} ELSE 0 END::DOUBLE",
    )


_TEXT = lambda wish, n: (f"CASE WHEN len({wish}) > 0 THEN {n} * ({_SHARE(wish)}) ELSE 0 END", points(f"len({wish}) > 0", n))
_PRICED = f"min_salary IS NOT NULL AND coalesce(salary_max, salary_min) IS NOT NULL AND {_COMPARABLE}"
_PARTS = [
    _one_of("domains", "domain", "40 * w_domain"), _one_of("seniorities", "seniority", "20"), _TEXT("motivations", 15), _TEXT("resume_keywords", 20),
    _one_of("employment_types", "employment_type", "35"),
    (
        f"CASE WHEN {_PLACED} THEN CASE WHEN {_CITY} THEN 30 WHEN {_COUNTRY} THEN 20 WHEN {_REMOTE} THEN 22 WHEN place_known AND open_to_relocation THEN 10 ELSE 0 END ELSE 0 END::DOUBLE",
        points(f"{_PLACED} AND place_known", 30),
    ),
    _one_of("remote_types", "remote_type", "15 * w_remote"),
    (points("len(titles) > 0 AND len(list_filter(titles, lambda t: contains(lower(title), t))) > 0", 35), points("len(titles) > 0", 35)),
    _TEXT("keywords", 25),
    (points(f"len(required_keywords) > 0 AND {_ALL_WORDS}", 30), points("len(required_keywords) > 0", 30)),
    _one_of("industries", "industry", "15"),
    (f"CASE WHEN {_PRICED} AND {_ENOUGH} THEN 10 * w_salary ELSE 0 END::DOUBLE", f"CASE WHEN {_PRICED} THEN 10 * w_salary ELSE 0 END::DOUBLE"),
    (
        f"CASE WHEN max_age_days IS NULL OR posted_at IS NULL THEN 0::DOUBLE ELSE 10 * greatest(0.0::DOUBLE, 1.0::DOUBLE - (epoch_us({NOW}) - epoch_us(posted_at)) / 1000000.0::DOUBLE / 86400.0::DOUBLE / (max_age_days * 2.0::DOUBLE)) END",
        points("max_age_days IS NOT NULL AND posted_at IS NOT NULL", 10),
    ),
    (points("followed", 8), "8::DOUBLE"),
]
_CAPS = [
    "CASE WHEN len(domains) > 0 AND w_domain >= 2 AND domain IS NOT NULL AND NOT list_contains(domains, domain) THEN 69 ELSE 100 END",
    "CASE WHEN len(remote_types) > 0 AND w_remote >= 2 AND remote_type IS NOT NULL AND NOT list_contains(remote_types, remote_type) THEN 69 ELSE 100 END",
]
_PAIR_SCORE = f"CAST(least(100, {', '.join(_CAPS)}, greatest(0, coalesce(round(({' + '.join(f'({e})' for e, _ in _PARTS)}) * 100.0::DOUBLE / nullif({' + '.join(f'({m})' for _, m in _PARTS)}, 0)), 0))) AS INTEGER)"
SCORED = f"SELECT user_id, email, id, title, company_name, created_at, {_PAIR_SCORE} AS match_score FROM pairs"


def recent(d: Domain) -> DataFrame:
    return d.postings.filter(F.col("closed_at").isNull() & (F.col("created_at") > at(POSTINGS_AT) - F.make_dt_interval(F.lit(40))))


@query("score_all_since_mark", f"WITH docs AS ({DOCS}), pairs AS ({PAIRS}) SELECT user_id, id, match_score FROM ({SCORED})")
def score_all_since_mark(d: Domain) -> DataFrame:
    """What the digest scores: open recent postings that are newer than the user's mark."""
    prefs = d.preferences.filter("notify_matches").join(d.users.filter("email IS NOT NULL").select("user_id"), "user_id", "left_semi")
    pairs = dg.score_all(recent(d), d.companies, d.places, prefs, d.watches, at(POSTINGS_AT), pairs_per_task=20_000)
    since = F.coalesce("last_notified_at", at(POSTINGS_AT) - F.make_dt_interval(F.lit(3)))
    return pairs.filter(F.col("created_at") > since).select("user_id", "id", "match_score")


EVERY_SCORE = f"WITH docs AS ({EVERY_DOC}), pairs AS ({EVERY_PAIR}) SELECT user_id, id, match_score FROM ({SCORED})"


@query("score_all", EVERY_SCORE)
@query("score_all_postings")
def score_all(d: Domain) -> DataFrame:
    """Every configured user against every posting, closed and old ones too.

    The SQL is nested loops over all of them: too slow for large tables.
    """
    pairs = dg.score_all(d.postings, d.companies, d.places, d.preferences, d.watches, at(POSTINGS_AT), pairs_per_task=20_000)
    return pairs.select("user_id", "id", "match_score")


DIGEST = f"""WITH docs AS ({DOCS}), pairs AS ({PAIRS}) SELECT user_id, email, id, title, company_name, match_score,
  row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC, created_at DESC, id) AS place FROM ({SCORED}) s WHERE match_score >= 70
  AND NOT EXISTS (SELECT 1 FROM interaction i WHERE i.user_id = s.user_id AND i.posting_id = s.id) QUALIFY place <= 10"""


def digests(d: Domain) -> DataFrame:
    return dg.digest(d.postings, d.companies, d.places, d.preferences, d.users, d.interactions, d.watches, at(POSTINGS_AT))


@query("digest", DIGEST)
def digest(d: Domain) -> DataFrame:
    return digests(d).select("user_id", "email", "id", "title", "company_name", "match_score", "place")


@query(
    "digest_marks",
    f"WITH sent AS (SELECT DISTINCT user_id FROM ({DIGEST})) SELECT p.user_id, CASE WHEN s.user_id IS NOT NULL THEN {NOW} ELSE last_notified_at END AS last_notified_at FROM preference p LEFT JOIN sent s ON s.user_id = p.user_id",
)
def digest_marks(d: Domain) -> DataFrame:
    return dg.advance_marks(d.preferences, digests(d), at(POSTINGS_AT)).select("user_id", "last_notified_at")


# --- streams, drained to a table ------------------------------------------------------------


def event_stream(d: Domain) -> DataFrame:
    """The events file read as a stream, in the log's shape."""
    raw = d.raw("events")
    stream = d.spark.readStream.schema(raw.schema).parquet(f"{d.folder}/events.parquet*")
    return Domain.events_of(stream)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run the stream over what is there and read back the sink."""
    spark = stream.sparkSession
    folder = run_folder(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id:06d}")

    run = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_event_dedupe", "SELECT event_id, type, user_id FROM job_event")
def stream_event_dedupe(d: Domain) -> DataFrame:
    # Every event arrives three times.
    sent = event_stream(d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withColumn("copy", F.explode(F.array(*map(F.lit, range(3)))))
    once = se.stream_event_dedupe(sent.drop("copy"))
    return drain(once, "event-dedupe", "append").select("event_id", "type", "user_id")


@query("stream_daily_activity", "SELECT user_id, strftime(occurred_at, '%Y-%m-%d') AS date, count(*) AS sent FROM job_event WHERE type = 'APPLICATION_SENT' GROUP BY 1, 2")
def stream_daily_activity(d: Domain) -> DataFrame:
    rows = drain(se.stream_daily_activity(event_stream(d)), "daily-activity", "update")
    # The last version of each count stands.
    return rows.groupBy("user_id", "date").agg(F.max("sent").alias("sent"))


@query("stream_status_fold", STATUS_NOW)
def stream_status_fold(d: Domain) -> DataFrame:
    rows = drain(se.stream_status_fold(event_stream(d)), "status-fold", "update")
    return rows.groupBy("application_id").agg(F.max_by(F.struct("status", "since"), "batch").alias("s")).select("application_id", "s.status", "s.since")


@query(
    "stream_source_state",
    """WITH r AS (SELECT 'https://jobs.lever.co/team' || (user_id % 60) AS url, ts, event_type = 'error' AS failed, event_type FROM events), ok AS (SELECT url, max(ts) AS ok_at FROM r WHERE NOT failed GROUP BY 1)
    SELECT r.url, CAST(count(*) FILTER (WHERE failed AND (ok_at IS NULL OR ts > ok_at)) AS INTEGER) AS failure_count, max(ts) AS last_checked_at, max(ts) FILTER (WHERE event_type = 'purchase') AS last_changed_at FROM r LEFT JOIN ok USING (url) GROUP BY 1""",
)
def stream_source_state(d: Domain) -> DataFrame:
    raw = d.raw("events")
    stream = d.spark.readStream.schema(raw.schema).parquet(f"{d.folder}/events.parquet*")
    kind = F.col("event_type")
    runs = stream.select(
        F.concat(F.lit("https://JOBS.lever.co/team"), (F.col("user_id") % 60).cast("string"), F.lit("/")).alias("url"), F.col("ts").alias("at"),
        F.when(kind == "error", "HTTP 500").alias("error"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("int").alias("job_count"),
        (kind == "purchase").alias("changed"), (kind == "view").alias("synced"),
    )
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = d.spark.conf.get(provider, None)
    d.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = drain(ss.stream_source_state(runs), "source-state", "update")
    finally:
        d.spark.conf.set(provider, before) if before else d.spark.conf.unset(provider)
    latest = rows.groupBy("url").agg(F.max_by(F.struct("failure_count", "last_checked_at", "last_changed_at"), "batch").alias("s"))
    ntz = lambda c: F.col(f"s.{c}").cast("timestamp_ntz").alias(c)
    return latest.select("url", F.col("s.failure_count").alias("failure_count"), ntz("last_checked_at"), ntz("last_changed_at"))
