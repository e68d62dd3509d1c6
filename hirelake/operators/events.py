"""The append-only log: status changes to events, snapshots, timelines, backfill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.operators.rows import top_per_key
from hirelake.schema import USER_RECORDABLE_EVENTS

# --- fixed values -----------------------------------------------------------------
EVENT_FOR_STATUS = {
    "APPLIED": "APPLICATION_SENT", "INTERVIEW": "INTERVIEW_SCHEDULED", "OFFER": "OFFER_RECEIVED",
    "REJECTED": "REJECTION_RECEIVED", "GHOSTED": "MARKED_GHOSTED",
}
EVENT_FOR_POSTING_STATUS = {"SEEN": "POSTING_VIEWED", "DISMISSED": "POSTING_DISMISSED"}
EVENT_COLUMNS = ["type", "occurred_at", "user_id", "posting_id", "application_id", "payload"]
SNAPSHOT_FIELDS = [
    "title", "url", "description", "description_html", "location", "department", "employment_type",
    "remote_type", "salary_min", "salary_max", "salary_currency", "posted_at", "valid_through",
]


def _mapped(table: dict[str, str], c: Column) -> Column:
    return reduce(lambda case, kv: F.when(c == kv[0], kv[1]).otherwise(case), table.items(), F.lit(None).cast("string"))


def append_event(log: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The log with new rows; a missing time is now."""
    new = events.withColumn("occurred_at", F.coalesce("occurred_at", now)).withColumn("created_at", now)
    return log.unionByName(new, allowMissingColumns=True)


def status_to_event(changes: DataFrame) -> DataFrame:
    """Application status feed (application_id, user_id, status, at) to events.

    A status repeated, or one that is no news, gives none; a new application counts as WISHLIST
    before its first status.
    """
    before = F.lag("status").over(W.partitionBy("application_id").orderBy("at", "seq"))
    kind = _mapped(EVENT_FOR_STATUS, F.col("status"))
    return (
        changes.withColumn("_before", F.coalesce(before, F.lit("WISHLIST")))
        .withColumn("type", kind)
        .filter((F.col("status") != F.col("_before")) & F.col("type").isNotNull())
        .select("type", F.col("at").alias("occurred_at"), "user_id", "application_id")
    )


def posting_status_to_event(marks: DataFrame) -> DataFrame:
    """Marks on postings (user_id, posting_id, status?, saved?, at) to events; one per mark."""
    status = _mapped(EVENT_FOR_POSTING_STATUS, F.col("status"))
    saved = F.when(F.col("saved"), "POSTING_SAVED").when(~F.col("saved"), "POSTING_UNSAVED")
    return marks.select(
        F.explode(F.array_compact(F.array(status, saved))).alias("type"),
        F.col("at").alias("occurred_at"), "user_id", "posting_id",
    )


def stamp_applied_at(applications: DataFrame, events: DataFrame) -> DataFrame:
    """The first APPLICATION_SENT dates an application that carries no date."""
    sent = (
        events.filter(F.col("type") == "APPLICATION_SENT")
        .groupBy(F.col("application_id").alias("id"))
        .agg(F.min("occurred_at").alias("_sent"))
    )
    return (
        applications.join(sent, "id", "left")
        .withColumn("applied_at", F.coalesce("applied_at", "_sent"))
        .drop("_sent")
    )


def sent_snapshot(events: DataFrame, interactions: DataFrame, versions: DataFrame, companies: DataFrame, places: DataFrame) -> DataFrame:
    """The first APPLICATION_SENT of each application with the posting as it read then.

    `versions` holds posting rows with `version_at`; the latest at or before the event counts. The
    as-of lookup is an equi-join on posting reduced by a maximum, so nothing is ranked in one place.
    Applications typed by hand have no posting and no snapshot.
    """
    first = (
        events.filter(F.col("type") == "APPLICATION_SENT")
        .groupBy("application_id")
        .agg(F.min(F.struct("occurred_at", "event_id", "user_id")).alias("e"))
        .select("application_id", F.col("e.occurred_at").alias("occurred_at"), F.col("e.user_id").alias("user_id"))
    )
    link = (
        interactions.dropna(subset=["application_id"])
        .groupBy("application_id", "user_id")
        .agg(F.min("posting_id").alias("posting_id"))
    )
    sent = first.join(link, ["application_id", "user_id"])
    v = versions.select(F.col("id").alias("posting_id"), "company_id", "version_at", *SNAPSHOT_FIELDS)
    keys = ["application_id", "user_id", "posting_id", "occurred_at"]
    # The version is chosen by its time alone; only the columns that are read later meet the chosen ones.
    latest = (
        sent.join(v.select("posting_id", "version_at"), "posting_id")
        .filter(F.col("version_at") <= F.col("occurred_at"))
        .groupBy(*keys)
        .agg(F.max("version_at").alias("version_at"))
    )
    frozen = (
        latest.join(v, ["posting_id", "version_at"])
        .dropDuplicates(keys)
        .select("application_id", "user_id", "posting_id", F.col("occurred_at").alias("captured_at"), "company_id", *SNAPSHOT_FIELDS)
    )
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    where = places.groupBy("posting_id").agg(
        F.array_sort(F.collect_set(F.struct("city", "region", "country"))).alias("locations")
    )
    return frozen.join(names, "company_id", "left").join(where, "posting_id", "left").drop("company_id")


def timeline(events: DataFrame, user_id, application_id) -> DataFrame:
    return events.filter(
        (F.col("user_id") == F.lit(user_id)) & (F.col("application_id") == F.lit(application_id))
    ).orderBy("occurred_at", "created_at", "event_id")


def snapshot_of(events: DataFrame) -> DataFrame:
    """(user_id, application_id, payload) of each application's first APPLICATION_SENT."""
    return (
        events.filter(F.col("type") == "APPLICATION_SENT")
        .groupBy("user_id", "application_id")
        .agg(F.min_by("payload", F.struct("occurred_at", "event_id")).alias("payload"))
    )


def validate_user_event(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): only five kinds may be stated by a user."""
    ok = F.coalesce(F.col("type").isin(USER_RECORDABLE_EVENTS), F.lit(False))
    return events.filter(ok), events.filter(~ok).withColumn(
        "message", F.concat(F.lit("Event "), F.col("type"), F.lit(" cannot be recorded by hand"))
    )


SENT_STATUSES = ["APPLIED", "INTERVIEW", "OFFER", "REJECTED", "GHOSTED", "NOT_ELIGIBLE"]


def backfill_events(interactions: DataFrame, applications: DataFrame, sent_statuses: list[str] = SENT_STATUSES) -> DataFrame:
    """The log current rows imply. Each row lists its own events: two scans, no shuffle."""
    none = F.lit(None).cast("string")

    def item(kind: Column, at: str, flagged: bool = False) -> Column:
        return F.struct(
            kind.alias("type"), F.col(at).alias("occurred_at"),
            (F.lit('{"backfilled": true}') if flagged else none).alias("payload"),
        )

    i = interactions.withColumn("_saved_at", F.coalesce("saved_at", "created_at"))
    marks = F.array(
        item(F.lit("POSTING_VIEWED"), "created_at"),
        F.when(F.col("saved"), item(F.lit("POSTING_SAVED"), "_saved_at")),
        F.when(F.col("status") == "DISMISSED", item(F.lit("POSTING_DISMISSED"), "updated_at")),
    )
    from_marks = i.select(
        F.explode(F.array_compact(marks)).alias("e"), "user_id", "posting_id",
        F.lit(None).cast(applications.schema["id"].dataType).alias("application_id"),
    )
    a = applications.filter(F.col("deleted_at").isNull() & F.col("user_id").isNotNull()).withColumn(
        "_sent_at", F.coalesce("applied_at", "created_at")
    )
    terminal = {s: e for s, e in EVENT_FOR_STATUS.items() if s != "APPLIED"}
    steps = F.array(
        item(F.lit("APPLICATION_CREATED"), "created_at"),
        F.when(F.col("status").isin(sent_statuses), item(F.lit("APPLICATION_SENT"), "_sent_at")),
        F.when(F.col("status").isin(list(terminal)), item(_mapped(terminal, F.col("status")), "updated_at", True)),
    )
    from_steps = a.select(
        F.explode(F.array_compact(steps)).alias("e"), "user_id",
        F.lit(None).cast(interactions.schema["posting_id"].dataType).alias("posting_id"),
        F.col("id").alias("application_id"),
    )
    both = from_marks.unionByName(from_steps)
    return both.select("e.type", "e.occurred_at", "user_id", "posting_id", "application_id", "e.payload")


def status_fold(events: DataFrame) -> DataFrame:
    """Current status of each application: its last status-bearing event."""
    by_event = {e: s for s, e in EVENT_FOR_STATUS.items()} | {"APPLICATION_CREATED": "WISHLIST"}
    return (
        events.withColumn("status", _mapped(by_event, F.col("type")))
        .filter(F.col("status").isNotNull() & F.col("application_id").isNotNull())
        .groupBy("application_id")
        .agg(F.max_by("status", F.struct("occurred_at", "event_id")).alias("status"), F.max("occurred_at").alias("since"))
    )


def upsert_interaction(interactions: DataFrame, patches: DataFrame, postings: DataFrame) -> DataFrame:
    """State after patches (user_id, posting_id, status?, saved?, application_id?, at).

    Later patches win field by field; a new row starts as SEEN; patches for unknown postings are
    dropped. Saving stamps saved_at, un-saving clears it.
    """
    keys = ["user_id", "posting_id"]
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at")))
    p = (
        patches.join(postings.select(F.col("id").alias("posting_id")), "posting_id", "left_semi")
        .groupBy(*keys)
        .agg(
            last("status").alias("_status"), last("saved").alias("_saved"), last("application_id").alias("_application"),
            F.max(F.when(F.col("saved").isNotNull(), F.col("at"))).alias("_saved_at"), F.min("at").alias("_at"),
        )
    )
    j = interactions.join(p, keys, "full")
    values = {
        "status": F.coalesce("_status", "status", F.lit("SEEN")),
        "saved": F.coalesce("_saved", "saved", F.lit(False)),
        "saved_at": F.when(F.col("_saved"), F.col("_saved_at")).when(~F.col("_saved"), None).otherwise(F.col("saved_at")),
        "application_id": F.coalesce("_application", "application_id"),
        "created_at": F.coalesce("created_at", "_at"),
    }
    return j.select(*[values.get(c, F.col(c)).alias(c) for c in interactions.columns])


def track_as_application(requests: DataFrame, interactions: DataFrame, postings: DataFrame, applications: DataFrame, new_id: Column | None = None):
    """Turn (user_id, posting_id, status, at) requests into applications.

    Returns (applications, patches, events): new application rows, the interaction patches that link
    them, and the events, creation before sending. A posting already linked to an application that
    exists is left alone.
    """
    if new_id is None:
        new_id = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.col("posting_id").cast("string")), 256)
    linked = (
        interactions.dropna(subset=["application_id"])
        .join(applications.select(F.col("id").alias("application_id")), "application_id", "left_semi")
        .select("user_id", "posting_id")
    )
    wanted = top_per_key(requests, ["user_id", "posting_id"], [F.col("at")]).join(linked, ["user_id", "posting_id"], "left_anti")
    p = postings.select(
        F.col("id").alias("posting_id"), "title", "url", "company_id", "salary_min", "salary_max", "location"
    )
    sent = F.col("status") == "APPLIED"
    rows = wanted.join(p, "posting_id").withColumn("new_id", new_id)
    new = rows.select(
        F.col("new_id").alias("id"), "user_id", F.col("title").alias("position"), "company_id", "url", "salary_min",
        "salary_max", "status", F.when(F.col("location").isNotNull(), F.concat(F.lit("Location: "), "location")).alias("notes"),
        F.when(sent, F.col("at")).alias("applied_at"), F.col("at").alias("created_at"),
    )
    patches = rows.select(
        "user_id", "posting_id", F.when(sent, "APPLIED").alias("status"), F.lit(None).cast("boolean").alias("saved"),
        F.col("new_id").alias("application_id"), "at",
    )
    kinds = F.when(sent, F.array(F.lit("APPLICATION_CREATED"), F.lit("APPLICATION_SENT"))).otherwise(
        F.array(F.lit("APPLICATION_CREATED"))
    )
    log = rows.select(
        F.explode(kinds).alias("type"), F.col("at").alias("occurred_at"), "user_id", "posting_id",
        F.col("new_id").alias("application_id"),
    )
    return new, patches, log
