"""Entity resolution over stored tables: collapse copies, re-point children, merge companies."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.roles import capitalise_slug
from hirelake.functions.text import fold_key
from hirelake.operators.rows import top_per_key
from hirelake.session import cut_lineage

# How strongly a user engaged with a posting; lower is stronger.
ENGAGEMENT = {"APPLIED": 0, "DISMISSED": 1, "SEEN": 2}


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def collapse_mapping(df: DataFrame, keys: list[str], created: str = "created_at") -> DataFrame:
    """(dup_id, canonical_id) for every row that is not the oldest of its non-null key.

    The oldest id per key is a map-side-combined minimum joined back: a key that holds a third of the
    rows is never sorted in one place. Keys are read twice, so ids and keys are written once.
    """
    return _mapping(cut_lineage(df.dropna(subset=keys).select(*keys, created, "id")), keys, created)


def _mapping(df: DataFrame, keys: list[str], created: str = "created_at") -> DataFrame:
    """`collapse_mapping` of rows that are narrow and read from files as they are."""
    keyed = df.dropna(subset=keys)
    oldest = keyed.groupBy(*keys).agg(F.min(F.struct(created, "id")).alias("_oldest"))
    return (
        keyed.join(oldest, keys)
        .filter(F.col("id") != F.col("_oldest.id"))
        .select(F.col("id").alias("dup_id"), F.col("_oldest.id").alias("canonical_id"))
    )


def collapse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows left when only the oldest of each (non-null) key stays."""
    gone = collapse_mapping(df, keys).select(F.col("dup_id").alias("id"))
    return df.join(gone, "id", "left_anti")


def repoint_interactions(interactions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Interactions after `mapping` moved: the strongest copy follows, an existing row stays as it is."""
    m = mapping.select(F.col("dup_id").alias("posting_id"), "canonical_id")
    moved = interactions.join(m, "posting_id")
    rank = F.lit(3)
    for status, n in ENGAGEMENT.items():
        rank = F.when(F.col("status") == status, n).otherwise(rank)
    best = top_per_key(
        moved,
        ["user_id", "canonical_id"],
        [rank, F.col("application_id").asc_nulls_last(), F.col("saved").desc(), F.col("posting_id")],
    )
    best = best.drop("posting_id").withColumnRenamed("canonical_id", "posting_id")
    stay = interactions.join(m.select("posting_id"), "posting_id", "left_anti")
    new = best.join(stay.select("user_id", "posting_id"), ["user_id", "posting_id"], "left_anti")
    return stay.select(*interactions.columns).unionByName(new.select(*interactions.columns))


def company_mapping(companies: DataFrame) -> DataFrame:
    """(dup_id, canonical_id): the oldest spelling of each case-folded name survives."""
    return collapse_mapping(companies.withColumn("_name", name_key(F.col("name"))), ["_name"])


class Merged:
    """The five tables after `merge_companies`; each is worked out when it is first asked for, from what it needs.

    Intermediate files go with `clear_scratch`.
    """

    KEYS = ("dedup_key", "url", "external_id")

    def __init__(self, companies: DataFrame, postings: DataFrame, interactions: DataFrame, applications: DataFrame, watches: DataFrame):
        self._companies, self._postings, self._interactions = companies, postings, interactions
        self._applications, self._watches = applications, watches
        self._mapping = cut_lineage(company_mapping(companies))

    @cached_property
    def _passes(self) -> tuple[list[DataFrame], DataFrame]:
        """The copies that each pass takes out, and the ids that are left.

        The passes run on ids and keys alone, each from files; wide rows are touched once, at the end.
        """
        slim = cut_lineage(_moved(self._postings.select("id", "company_id", *self.KEYS, "created_at"), self._mapping))
        gone = []
        for key in self.KEYS:
            gone.append(cut_lineage(_mapping(slim, ["company_id", key])))
            slim = cut_lineage(slim.join(gone[-1].select(F.col("dup_id").alias("id")), "id", "left_anti"))
        return gone, slim

    @cached_property
    def postings(self) -> DataFrame:
        return _moved(self._postings.join(self._passes[1].select("id"), "id", "left_semi"), self._mapping)

    @cached_property
    def interactions(self) -> DataFrame:
        moved = self._interactions
        for dup in self._passes[0]:
            moved = cut_lineage(repoint_interactions(moved, dup))
        return moved

    @cached_property
    def applications(self) -> DataFrame:
        return _moved(self._applications, self._mapping)

    @cached_property
    def watches(self) -> DataFrame:
        watches = self._watches
        followed = _moved(watches, self._mapping)
        original = watches.withColumn("_own", F.lit(1)).select("user_id", "company_id", "_own")
        followed = followed.join(original, ["user_id", "company_id"], "left").withColumn("_kept", F.coalesce("_own", F.lit(0)))
        return top_per_key(followed, ["user_id", "company_id"], _watch_order(watches)).select(*watches.columns)

    @cached_property
    def companies(self) -> DataFrame:
        companies, mapping = self._companies, self._mapping
        group = companies.join(mapping.withColumnRenamed("dup_id", "id"), "id").groupBy("canonical_id").agg(
            F.min_by("careers_url", F.when(F.col("careers_url").isNotNull(), F.struct("created_at", "id"))).alias("_careers"),
            F.min_by("website", F.when(F.col("website").isNotNull(), F.struct("created_at", "id"))).alias("_website"),
            F.max("is_monitored").alias("_monitored"),
        )
        survivors = companies.join(mapping.select(F.col("dup_id").alias("id")), "id", "left_anti")
        return (
            survivors.join(group.withColumnRenamed("canonical_id", "id"), "id", "left")
            .withColumns(
                {
                    "careers_url": F.coalesce("careers_url", "_careers"),
                    "website": F.coalesce("website", "_website"),
                    "is_monitored": F.coalesce("is_monitored", F.lit(False)) | F.coalesce("_monitored", F.lit(False)),
                }
            )
            .select(*companies.columns)
        )


def _moved(df: DataFrame, mapping: DataFrame, column: str = "company_id") -> DataFrame:
    m = mapping.select(F.col("dup_id").alias(column), "canonical_id")
    return df.join(m, column, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id").select(*df.columns)


def merge_companies(
    companies: DataFrame, postings: DataFrame, interactions: DataFrame, applications: DataFrame, watches: DataFrame
) -> Merged:
    """Companies whose names differ only in case become one, with everything that hangs on them.

    Postings are collapsed where they are about to live: by key, then url, then external id, each
    pass reading what the one before left.
    """
    return Merged(companies, postings, interactions, applications, watches)


def _watch_order(watches: DataFrame) -> list[Column]:
    # The row already on the survivor wins; among moved copies any one will do, so the order is total.
    rest = [F.col(c).asc_nulls_last() for c in watches.columns if c not in ("user_id", "company_id")]
    return [F.col("_kept").desc(), *rest]


def backfill_dedup_key(postings: DataFrame, places: DataFrame) -> DataFrame:
    """Recompute every key from the title and the posting's first place by place id."""
    first = places.groupBy("posting_id").agg(F.min_by("city", F.when(F.col("city").isNotNull(), F.col("id"))).alias("_city"))
    joined = postings.join(first.withColumnRenamed("posting_id", "id"), "id", "left")
    place = F.coalesce("_city", F.substring_index("location", ",", 1), F.lit(""))
    return joined.withColumn(
        "dedup_key", F.concat(fold_key(F.col("title")), F.lit("|"), fold_key(place))
    ).drop("_city")


def seed_companies(companies: DataFrame, entries: DataFrame) -> DataFrame:
    """Outcome of registering discovered companies, one row per distinct entry.

    Columns: name, id (NULL when created), careers_url, website, status, is_monitored, outcome. A
    careers URL set by hand is kept. Several entries of one name act in turn; as the first sets what
    is empty, the later ones find it set.
    """
    named = entries.withColumn("name", capitalise_slug(F.trim("name"))).filter(F.col("name") != "")
    named = named.withColumn("_key", name_key(F.col("name")))
    first = top_per_key(named, ["_key"], [F.col("pos")])
    old = companies.select(
        F.col("id"), name_key(F.col("name")).alias("_key"), F.col("name").alias("_name"),
        F.col("careers_url").alias("_careers"), F.col("website").alias("_website"),
        F.col("status").alias("_status"), F.col("is_monitored").alias("_monitored"),
    )
    old = top_per_key(old, ["_key"], [F.col("id")])
    j = first.join(old, "_key", "left")
    known = F.col("id").isNotNull()
    renamed = (F.col("_name") == F.lower("_name")) & (F.col("_name") != F.col("name"))
    keeps = F.coalesce(F.length("_careers") > 0, F.lit(False)) | F.col("_careers").eqNullSafe(F.col("careers_url"))
    return j.select(
        "id",
        F.when(~known | renamed, F.col("name")).otherwise(F.col("_name")).alias("name"),
        F.when(known & keeps, F.col("_careers")).otherwise(F.col("careers_url")).alias("careers_url"),
        F.when(known & keeps, F.col("_website")).otherwise(F.coalesce("_website", "website")).alias("website"),
        F.coalesce("_status", F.lit("APPROVED")).alias("status"),
        F.when(known & keeps, F.col("_monitored")).otherwise(F.lit(True)).alias("is_monitored"),
        F.when(~known, "created").when(keeps & ~renamed, "unchanged").otherwise("updated").alias("outcome"),
    )


def find_or_create_company(companies: DataFrame, names: DataFrame, new_id: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """(name, id, created) per distinct requested name; an unknown one becomes a PENDING company.

    Ids are made from the name and `as_of`, the time of the call: a company that was renamed keeps its id, and another one
    may then ask for its first name.
    """
    if new_id is None:
        made = F.col("_key") if as_of is None else F.concat_ws("|", F.col("_key"), as_of.cast("string"))
        taken = companies.select(F.col("id").cast("string").alias("_made"), F.lit(True).alias("_taken")).distinct()
        new_id = F.sha2(made, 256)
    else:
        taken = None
    asked = names.select(F.trim("name").alias("name")).withColumn("_key", name_key(F.col("name")))
    asked = top_per_key(asked, ["_key"], [F.col("name")])
    asked = asked.withColumn("_made", new_id.cast("string"))
    if taken is not None:
        again = F.sha2(F.concat("_made", F.lit("|"), "_key"), 256)
        asked = asked.join(taken, "_made", "left").withColumn("_made", F.when(F.col("_taken"), again).otherwise(F.col("_made")))
    known = companies.groupBy(name_key(F.col("name")).alias("_key")).agg(F.min_by("name", "id").alias("_name"), F.min("id").alias("_id"))
    return asked.join(known, "_key", "left").select(
        F.coalesce("_name", "name").alias("name"),
        F.coalesce(F.col("_id").cast("string"), "_made").alias("id"),
        F.col("_id").isNull().alias("created"),
    )


def capitalise_seeded(companies: DataFrame) -> DataFrame:
    seeded = (F.col("status") == "APPROVED") & F.col("is_monitored") & (F.col("name") != "")
    return companies.withColumn("name", F.when(seeded, capitalise_slug(F.col("name"))).otherwise(F.col("name")))


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], soft_delete: str | None = None) -> DataFrame:
    """Batch form of single-row writes: the latest change per key wins.

    `changes` has the key columns, any table columns (NULL leaves a value), `op` ('upsert' |
    'delete') and `at`. With `soft_delete` a delete stamps that column instead of removing the row.
    """
    latest = top_per_key(changes, keys, [F.col("at").desc()])
    fields = [c for c in table.columns if c not in keys and c in changes.columns]
    latest = latest.select(*keys, F.col("op").alias("_op"), F.col("at").alias("_at"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = table.withColumn("_old", F.lit(True)).join(latest, keys, "full")
    gone = F.coalesce(F.col("_op") == "delete", F.lit(False))
    if soft_delete is None:
        joined = joined.filter(~gone)
    else:
        # A delete of a row that never was leaves nothing behind.
        joined = joined.filter(F.col("_old") | ~gone)
    columns = []
    for c in table.columns:
        if c == soft_delete:
            columns.append(F.when(gone, F.col("_at")).otherwise(F.col(c)).alias(c))
        elif c in fields:
            columns.append(F.when(~gone, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def active(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def remove_companies(companies: DataFrame, applications: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies and applications after a removal; an application goes with its company."""
    return (
        companies.join(removed.select("id").distinct(), "id", "left_anti"),
        applications.join(removed.select(F.col("id").alias("company_id")).distinct(), "company_id", "left_anti"),
    )
