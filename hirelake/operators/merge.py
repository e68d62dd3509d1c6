"""Snapshot merge of incoming postings: identity, near duplicates, guarded upsert, child places.

Plain files have no row-level update, so each operator returns the new snapshot. Every join is an
equi-join on a key that is unique on one side; nothing pairs the rows of a company with each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.similarity import jaccard, trigrams
from hirelake.functions.text import fold_key
from hirelake.operators.rows import first_wins
from hirelake.schema import CONTENT_COLUMNS
from hirelake.session import cut_lineage

# --- fixed values -----------------------------------------------------------------
TITLE_SIMILARITY = 0.9

# Orders the batch and identifies one row of it. `tie` parts rows of one company, place and URL (two spellings of a board);
# rows alike in all four are exact repeats.
ORDER = ["company_id", "pos", "url", "tie"]


def dedup_key(title: Column, places: Column, location: Column, unicode_fold: bool = False) -> Column:
    """`folded title|folded first city`, the location's first comma part where no city is known."""
    city = F.get(F.filter(places, lambda p: F.length(p["city"]) > 0), F.lit(0))["city"]
    place = F.coalesce(city, F.substring_index(location, ",", 1), F.lit(""))
    return F.concat(fold_key(title, unicode_fold), F.lit("|"), fold_key(place, unicode_fold))


def content_hash(places: Column, columns: list[str] = CONTENT_COLUMNS) -> Column:
    """Digest of what a re-read could change; the order of the places does not matter."""
    place = F.transform(
        F.coalesce(places, F.array().cast("array<struct<city:string,region:string,country:string,raw:string>>")),
        lambda p: F.concat_ws("~", *[F.coalesce(p[f], F.lit("")) for f in ("city", "region", "country", "raw")]),
    )
    fields = F.array(*[F.col(c).cast("string") for c in columns])
    return F.sha2(F.array_join(F.concat(fields, F.array_sort(place)), "\0", ""), 256)


def with_identity(incoming: DataFrame, unicode_fold: bool = False) -> DataFrame:
    return with_tie(
        incoming.withColumns(
            {
                "dedup_key": dedup_key(F.col("title"), F.col("places"), F.col("location"), unicode_fold),
                "content_hash": content_hash(F.col("places")),
            }
        )
    )


def with_tie(incoming: DataFrame) -> DataFrame:
    """The last part of ORDER: board, external id and content, never null."""
    if "tie" in incoming.columns:
        return incoming
    parts = [c for c in ("source", "external_id", "content_hash") if c in incoming.columns]
    return incoming.withColumn("tie", F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in parts]))


LONG_TEXTS = ["description", "description_html"]


def set_texts_aside(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` with a digest, `_texts`, in place of their long texts, and the texts by that digest.

    Only the digest is moved and written from here on. Texts are joined back by `with_texts`, which costs nothing where no
    text is read: the join is then left out of the plan, as the digest is unique among them.
    """
    each = [F.coalesce(F.sha2(c, 256), F.lit("")) for c in LONG_TEXTS]
    rows = rows.withColumn("_texts", F.unhex(F.sha2(F.concat_ws(",", *each), 256)))
    texts = rows.groupBy("_texts").agg(*[F.first(c).alias(c) for c in LONG_TEXTS])
    return rows.drop(*LONG_TEXTS), texts


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts, "_texts", "left").drop("_texts")


# --- near duplicates ----------------------------------------------------------------


def _keys_of(df: DataFrame) -> DataFrame:
    """Distinct (company, title part, city part); exact copies fold here."""
    return df.select(
        "company_id",
        F.split_part("dedup_key", F.lit("|"), F.lit(1)).alias("title_part"),
        F.split_part("dedup_key", F.lit("|"), F.lit(2)).alias("city_part"),
    ).distinct()


def _with_grams(keys: DataFrame) -> DataFrame:
    return keys.withColumn("grams", trigrams(F.col("title_part"))).filter(F.size("grams") > 0)


# Grams are counted under so many hashes: a fixed number of counts whatever the letters. Grams that share a hash share a
# count, which still puts all grams into one order.
GRAM_BUCKETS = 1 << 16


def _gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def _gram_counts(keys: DataFrame) -> Column:
    """How many titles hold the grams of each bucket, as one constant list."""
    counts = [0] * GRAM_BUCKETS
    grams = keys.select(F.explode("grams").alias("gram"))
    for row in grams.groupBy(_gram_bucket(F.col("gram")).alias("b")).count().collect():
        counts[row["b"]] = row["count"]
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")


def _rarest_grams(keys: DataFrame, counts: Column, threshold: float) -> DataFrame:
    """Each title under its rarest grams, enough of them that two similar titles must share one.

    Jaccard >= t needs a shared gram among the first |A| - ceil(t|A|) + 1 of both sides in any one
    global order. Rarest first keeps the groups small when titles differ only in a few characters.
    The grams are ranked inside their row: nothing is shuffled for it.
    """
    size = F.size("grams")
    # The tiny allowance keeps 0.9 * 10 from rounding up past 9.
    wanted = (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int")
    # `sort_array` compares natively; `array_sort` would read its comparison as an expression, once per two grams.
    ranked = F.sort_array(
        F.transform("grams", lambda g: F.struct(F.get(counts, _gram_bucket(g)).alias("n"), g.alias("gram")))
    )
    return keys.withColumn("gram", F.explode(F.transform(F.slice(ranked, 1, wanted), lambda x: x["gram"])))


LEVEL_TOKEN = r"\A([ivx]+|\d+)\z"


def _level_tokens(c: Column) -> Column:
    return F.array_sort(F.filter(F.split(c, " "), lambda w: w.rlike(LEVEL_TOKEN)))


def near_duplicate_keys(
    incoming: DataFrame,
    stored: DataFrame,
    threshold: float = TITLE_SIMILARITY,
    guard_level_tokens: bool = False,
    unicode_fold: bool = False,
) -> DataFrame:
    """(company_id, dedup_key, existing): the stored key each incoming key reads the same as.

    Same company, same city part exactly, title trigram similarity >= threshold; the most similar
    wins, then the oldest stored row. `guard_level_tokens` refuses pairs whose roman numerals or
    digits differ ("engineer ii" / "engineer iii").
    """
    new = cut_lineage(_keys_of(incoming))
    blocks = new.select("company_id", "city_part").distinct()
    old = cut_lineage(_keys_of(stored).join(blocks, ["company_id", "city_part"], "left_semi"))
    # A fixed number of partitions: the keys are small, but each is met with many and compared gram by gram.
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    new, old = (_with_grams(k.repartition(tasks, "company_id", "title_part")) for k in (new, old))
    counts = _gram_counts(new.select("grams").unionByName(old.select("grams")))
    a = _rarest_grams(new, counts, threshold).withColumnsRenamed({"title_part": "a_title", "grams": "a_grams"})
    b = _rarest_grams(old, counts, threshold).withColumnsRenamed({"title_part": "b_title", "grams": "b_grams"})
    sizes = F.least(F.size("a_grams"), F.size("b_grams")) >= F.lit(threshold) * F.greatest(
        F.size("a_grams"), F.size("b_grams")
    ) - 1e-9
    pairs = (
        # Spark judges a side by its file of keys, where titles repeat and pack well; under its grams a title is a hundred times
        # as large, which the driver must not gather for a broadcast.
        a.join(b.hint("merge"), ["company_id", "city_part", "gram"])
        .filter(sizes)
        .withColumn("sim", F.when(F.col("a_title") == F.col("b_title"), 1.0).otherwise(jaccard(F.col("a_grams"), F.col("b_grams"))))
        .filter(F.col("sim") >= threshold)
    )
    if guard_level_tokens:
        pairs = pairs.filter(_level_tokens(F.col("a_title")) == _level_tokens(F.col("b_title")))
    oldest = stored.groupBy("company_id", "dedup_key").agg(F.min("created_at").alias("created_at"))
    return (
        pairs.select(
            "company_id",
            F.concat("a_title", F.lit("|"), "city_part").alias("incoming_key"),
            F.concat("b_title", F.lit("|"), "city_part").alias("dedup_key"),
            "sim",
        )
        .join(oldest, ["company_id", "dedup_key"])
        .groupBy("company_id", "incoming_key")
        .agg(F.min(F.struct(-F.col("sim"), F.col("created_at"), F.col("dedup_key"))).alias("best"))
        .select("company_id", F.col("incoming_key").alias("dedup_key"), F.col("best.dedup_key").alias("existing"))
    )


def resolve_near_duplicates(
    incoming: DataFrame,
    stored: DataFrame,
    threshold: float = TITLE_SIMILARITY,
    guard_level_tokens: bool = False,
    unicode_fold: bool = False,
) -> DataFrame:
    """Incoming rows with their key rewritten to the stored one it nearly equals.

    Compares with stored rows only: two near duplicates inside one batch both go in.
    """
    found = near_duplicate_keys(incoming, stored, threshold, guard_level_tokens, unicode_fold)
    return (
        incoming.join(found, ["company_id", "dedup_key"], "left")
        .withColumn("dedup_key", F.coalesce("existing", "dedup_key"))
        .drop("existing")
        .select(*incoming.columns)
    )


# --- match, insert, merge, touch ------------------------------------------------------

MATCH_KEYS = ["url", "external_id", "dedup_key"]  # in order of preference


def match_incoming(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, company_id, pos, url): for each stored row the incoming row that is the same offer.

    Same company and equal url, or equal non-null external id, or equal key: three equi-joins, not
    one join on company with an OR behind it, which would test every pair inside a company. Several
    matches: url before id before key, then first in the batch.
    """
    incoming = with_tie(incoming)
    sides = []
    for rank, key in enumerate(MATCH_KEYS):
        s = stored.select("id", "company_id", F.col(key).alias("_k")).dropna(subset=["_k"])
        v = (
            incoming.select(*ORDER, F.col(key).alias("_k"))
            .dropna(subset=["_k"])
            .groupBy("company_id", "_k")
            .agg(F.min(F.struct(*ORDER)).alias("row"))
        )
        sides.append(s.join(v, ["company_id", "_k"]).select("id", F.lit(rank).alias("rank"), "row"))
    return (
        reduce(DataFrame.unionByName, sides)
        .groupBy("id")
        .agg(F.min(F.struct("rank", "row")).alias("best"))
        .select("id", "best.row.*")
    )


def insert_new(incoming: DataFrame, stored: DataFrame, seen_at: Column, new_id: Column) -> DataFrame:
    """Rows of the batch that collide with no stored row and no earlier row of the batch.

    One board may stand under several companies: the order of the batch starts with the company, so the rows of one never
    shut out those of another. Exact repeats count once.
    """
    keys = [["company_id", k] for k in MATCH_KEYS]
    fresh = first_wins(with_tie(incoming), keys, F.struct(*ORDER), cut_lineage, stored.select("company_id", *MATCH_KEYS))
    return fresh.select(*incoming.columns).withColumns({"id": new_id, "created_at": seen_at})


def merge_changed(stored: DataFrame, incoming: DataFrame, matches: DataFrame, seen_at: Column) -> DataFrame:
    """New snapshot with `changed` and `seen` flags.

    Where the digest differs, each content column takes the incoming value if there is one. Every
    matched row is marked as seen and re-opened, changed or not.
    """
    content = with_tie(incoming).dropDuplicates(ORDER).select(
        *ORDER, *[F.col(c).alias(f"v_{c}") for c in CONTENT_COLUMNS], F.col("content_hash").alias("v_content_hash")
    )
    # Unmatched stored rows carry no incoming row to look up.
    v = matches.join(content, ORDER).drop(*ORDER)
    joined = stored.join(v.withColumn("seen", F.lit(True)), "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    moved = F.col("seen") & ~F.col("content_hash").eqNullSafe(F.col("v_content_hash"))
    joined = joined.withColumn("changed", moved)
    changed, seen = F.col("changed"), F.col("seen")
    columns = []
    for c in stored.columns:
        kind = stored.schema[c].dataType
        if c in CONTENT_COLUMNS:
            value = F.when(changed, F.coalesce(F.col(f"v_{c}").cast(kind), F.col(c))).otherwise(F.col(c))
        elif c == "content_hash":
            value = F.when(changed, F.col("v_content_hash")).otherwise(F.col(c))
        elif c == "updated_at":
            value = F.when(changed, seen_at).otherwise(F.col(c))
        elif c == "detail_fetched_at":
            value = F.when(changed & F.col("v_description").isNotNull(), seen_at).otherwise(F.col(c))
        elif c == "last_seen_at":
            value = F.when(seen, seen_at).otherwise(F.col(c))
        elif c in ("closed_at", "closed_reason"):
            value = F.when(~seen, F.col(c))
        else:
            value = F.col(c)
        columns.append(value.cast(kind).alias(c))
    return joined.select(*columns, "changed", "seen")


def touch_seen(stored: DataFrame, matches: DataFrame, seen_at: Column) -> DataFrame:
    """Being listed keeps a posting open: last-seen moves, a closed posting re-opens."""
    hit = matches.select("id").distinct().withColumn("_seen", F.lit(True))
    seen = F.col("_seen").isNotNull()
    return (
        stored.join(hit, "id", "left")
        .withColumns(
            {
                "last_seen_at": F.when(seen, seen_at).otherwise(F.col("last_seen_at")),
                "closed_at": F.when(~seen, F.col("closed_at")),
                "closed_reason": F.when(~seen, F.col("closed_reason")),
            }
        )
        .drop("_seen")
    )


def place_rows(places: DataFrame) -> DataFrame:
    """(posting_id, places) to child rows, one per (posting, city, region, country)."""
    p = F.col("p")
    given = lambda field: F.coalesce(p[field], F.lit(""))
    rows = places.select("posting_id", F.posexplode("places").alias("at", "p")).select(
        "posting_id",
        given("city").alias("city"),
        given("region").alias("region"),
        F.upper(given("country")).alias("country"),
        F.struct("at", given("raw").alias("raw")).alias("first"),
    )
    return (
        rows.groupBy("posting_id", "city", "region", "country")
        .agg(F.min("first").alias("first"))
        .select("posting_id", "city", "region", "country", F.col("first.raw").alias("raw"))
    )


def sync_places(stored_places: DataFrame, sent: DataFrame) -> DataFrame:
    """Child rows after a merge; `sent` is (posting_id, places) of the changed postings.

    A posting that sent places gets exactly those (a kept place keeps its stored raw text); one that
    sent none, or did not change, is left alone.
    """
    keys = ["posting_id", "city", "region", "country"]
    sent = sent.filter(F.size("places") > 0)
    new = place_rows(sent)
    kept = stored_places.join(sent.select("posting_id").distinct(), "posting_id", "left_anti").select(*keys, "raw")
    old = stored_places.select(*keys, F.col("raw").alias("_raw"))
    return kept.unionByName(
        new.join(old, keys, "left").select(*keys, F.coalesce("_raw", "raw").alias("raw"))
    )


def offer_id(seen_at: Column) -> Column:
    """Id of a new posting: all its keys and the time of its batch. A stored row keeps its id while its url, title and key
    may change, so no single key of a new row tells that no stored row was once made from it."""
    keys = F.struct("company_id", *MATCH_KEYS, seen_at.cast("string").alias("seen_at"))
    return F.sha2(F.to_json(keys, {"ignoreNullFields": "false"}), 256)


def with_free_ids(rows: DataFrame, stored: DataFrame, given: bool) -> DataFrame:
    """New rows whose id no stored row has: a made id that is taken is digested once more, a given one is refused."""
    taken = stored.select("id").join(rows.select("id"), "id", "left_semi").distinct().withColumn("_taken", F.lit(True))
    if given:
        other = F.raise_error(F.concat(F.lit("a stored posting has the id "), F.col("id").cast("string"))).cast(rows.schema["id"].dataType)
    else:
        other = F.sha2(F.concat("id", F.lit("|"), "url"), 256)
    names = rows.columns
    return rows.join(taken, "id", "left").withColumn("id", F.when(F.col("_taken"), other).otherwise(F.col("id"))).select(*names)


@dataclass
class IngestResult:
    postings: DataFrame  # the new snapshot
    places: DataFrame  # the new child table
    inserted: DataFrame  # id, title, url, location of the new rows
    changed: DataFrame  # ids of the rows whose content moved, new ones included


def ingest_batch(
    stored: DataFrame,
    stored_places: DataFrame,
    incoming: DataFrame,
    seen_at: Column,
    new_id: Column | None = None,
    threshold: float = TITLE_SIMILARITY,
    guard_level_tokens: bool = False,
    unicode_fold: bool = False,
) -> IngestResult:
    """The whole write: identity, near duplicates, insert, merge, touch, places.

    `new_id` names the ids of new rows; without it they are made by `offer_id`. No new row takes the id of a stored one.
    The new snapshot is lazy: only the columns that are read of it are worked out, and long texts move once.
    """
    given = new_id is not None
    new_id = new_id if given else offer_id(seen_at)
    identified, texts = set_texts_aside(with_identity(incoming, unicode_fold))
    prepared = resolve_near_duplicates(identified, stored, threshold, guard_level_tokens, unicode_fold)
    # Read by the insert, the three matches and the merge: computed once.
    prepared = cut_lineage(prepared.dropDuplicates(ORDER))
    new = insert_new(prepared, stored, seen_at, new_id)
    new = new.withColumn("id", F.col("id").cast(stored.schema["id"].dataType))
    # Read by the table and by the result; few and settled from here on.
    new = with_texts(cut_lineage(with_free_ids(new, stored, given)), texts)
    blank = {
        # A new row goes in without a digest, so the merge below writes its places as well.
        "content_hash": F.lit(None).cast("string"),
        "last_seen_at": seen_at,
        "updated_at": seen_at,
        "detail_fetched_at": F.when(F.col("description").isNotNull(), seen_at),
        "closed_at": F.lit(None),
        "closed_reason": F.lit(None),
        "last_validated_at": F.lit(None),
    }
    rows = new.withColumns({c: v for c, v in blank.items() if c in stored.columns})
    rows = rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stored.schema.fields
        ]
    )
    table = stored.unionByName(rows)
    matches = cut_lineage(match_incoming(table, prepared))
    merged = merge_changed(table, with_texts(prepared, texts), matches, seen_at)
    changed = merged.filter("changed").select("id")
    sent = (
        matches.join(changed, "id", "left_semi")
        .join(prepared.select(*ORDER, "places"), ORDER)
        .select(F.col("id").alias("posting_id"), "places")
    )
    return IngestResult(
        postings=merged.drop("changed", "seen"),
        places=sync_places(stored_places, sent),
        inserted=rows.select("id", "title", "url", "location"),
        changed=changed,
    )
