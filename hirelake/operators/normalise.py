"""Raw listings to one posting shape, as one narrow job plus one dedupe shuffle."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import schema
from hirelake.functions import roles, urls
from hirelake.functions.markup import sanitize_html
from hirelake.functions.places import clean_location, format_places, with_places
from hirelake.functions.text import clip, looks_like_html, strip_html
from hirelake.operators.rows import Steps, top_per_key

RICHNESS_FIELDS = [
    "description", "description_html", "location", "department", "posted_at", "valid_through",
    "salary_min", "employment_type", "remote_type", "external_id",
]


def pick_description(df: DataFrame | Steps, max_text: int | None = None, max_html: int | None = None) -> DataFrame | Steps:
    """Replace description / description_html by cleaned text and safe markup, whole unless a length is given."""
    html = F.coalesce(
        F.col("description_html"), F.when(looks_like_html(F.col("description")), F.col("description"))
    )
    text = F.coalesce(F.col("description"), html)
    return df.withColumns(
        {
            "description_html": clip(sanitize_html(html), max_html),
            "description": clip(strip_html(text), max_text),
        }
    )


def normalise_postings(
    listings: DataFrame, as_of: Column, max_text: int | None = None, max_html: int | None = None
) -> DataFrame:
    """Every usable raw job in normal form; unusable titles and URLs are dropped first.

    Texts are kept and searched whole; the two lengths cut what is stored, for callers that want that.
    """
    steps = _normal_form(listings.sparkSession._jvm, max_text, max_html)
    return steps.on(listings.withColumn("_as_of", as_of))


@lru_cache(maxsize=8)
def _normal_form(jvm, max_text: int | None, max_html: int | None) -> Steps:
    """What `normalise_postings` does to listings with their time in `_as_of`; `jvm` holds the columns."""
    df = Steps().withColumns(
        {"title": roles.clean_title(F.col("title")), "url": urls.normalise_url(F.col("url"))}
    ).filter(roles.is_plausible_title(F.col("title")) & F.col("url").rlike(r"(?i)\Ahttps?://"))
    df = pick_description(df, max_text, max_html)
    df = with_places(
        df,
        F.concat(F.coalesce(F.col("locations"), F.array().cast("array<string>")), F.array("location")),
    )
    stated_min, stated_max = (roles.as_salary(F.col(c)) for c in ("salary_min", "salary_max"))
    stated = F.coalesce(stated_min, stated_max).isNotNull()
    df = df.withColumns(
        {
            "location": F.coalesce(format_places(F.col("places")), clean_location(F.col("location"))),
            "department": clean_location(F.col("department")),
            "_pay": F.when(
                stated,
                F.struct(
                    stated_min.alias("min"), stated_max.alias("max"),
                    F.col("salary_currency").alias("currency"),
                ),
            ).otherwise(roles.parse_salary(F.col("description"))),
        }
    )
    place_model = F.get(F.filter("places", lambda p: p["remote"].isNotNull()), F.lit(0))["remote"]
    labels = [F.col("title"), F.col("location"), F.col("employment_type")]
    return df.select(
        "platform",
        "board_url",
        "pos",
        "external_id",
        "title",
        "url",
        "description",
        "description_html",
        "location",
        "places",
        "department",
        F.coalesce("domain", roles.classify_domain(F.col("title"), F.col("department"))).alias("domain"),
        F.coalesce("seniority", roles.classify_seniority(F.col("title"))).alias("seniority"),
        roles.normalise_employment(F.col("employment_type"), F.col("title"), F.col("description")).alias("employment_type"),
        F.coalesce("remote", roles.is_remote(*labels)).alias("remote"),
        F.coalesce("remote_type", place_model, roles.normalise_remote(F.col("remote"), *labels)).alias("remote_type"),
        F.col("_pay.min").alias("salary_min"),
        F.col("_pay.max").alias("salary_max"),
        F.col("_pay.currency").alias("salary_currency"),
        roles.coerce_date(F.col("posted_at"), F.col("_as_of")).alias("posted_at"),
        roles.coerce_date(F.col("valid_through"), F.col("_as_of")).alias("valid_through"),
        "partial",
    )


def richness(df: DataFrame) -> Column:
    """How many of the optional fields a row fills."""

    def filled(name: str) -> Column:
        c = F.col(name)
        kind = dict(df.dtypes)[name]
        known = (F.length(c) > 0) if kind == "string" else (c != 0) if kind in ("int", "bigint", "double") else c.isNotNull()
        return F.coalesce(known, F.lit(False)).cast("int")

    places = F.coalesce(F.size("places") > 0, F.lit(False)).cast("int")
    return sum((filled(f) for f in RICHNESS_FIELDS), places)


def dedupe_listing(postings: DataFrame) -> DataFrame:
    """One row per job key and board: the fullest, the first on ties."""
    keyed = postings.withColumns(
        {
            "job_key": urls.job_key(F.col("platform"), F.col("external_id"), F.col("url")),
            "_richness": richness(postings),
        }
    )
    return top_per_key(keyed, ["board_url", "job_key"], [F.col("_richness").desc(), F.col("pos")]).drop("_richness")


def board_fingerprint(postings: DataFrame) -> DataFrame:
    """(board_url, content_hash, job_count): equal when a board lists the same job keys.

    A sum of key digests instead of a digest of the joined key list: it does not depend on order
    either, but combines map-side, so no board is ever gathered into one row.
    """

    def part(at: int) -> Column:
        # 60 bits of the key's digest; sums of them stay far inside decimal(38).
        digits = F.substring(F.sha1(F.col("job_key")), at, 15)
        return F.sum(F.conv(digits, 16, 10).cast("decimal(20,0)"))

    return postings.groupBy("board_url").agg(
        part(1).alias("_low"), part(16).alias("_high"), F.count("*").alias("job_count")
    ).select(
        "board_url",
        F.sha1(F.concat_ws(":", "job_count", "_low", "_high")).alias("content_hash"),
        "job_count",
    )


def diff_listings(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Boards whose fingerprint moved (or that are new): the ones worth a full read."""
    before = previous.select("board_url", F.col("content_hash").alias("_before"))
    return (
        current.join(before, "board_url", "left")
        .filter(~F.col("content_hash").eqNullSafe(F.col("_before")))
        .drop("_before")
    )


def to_posting_rows(postings: DataFrame, source: Column) -> DataFrame:
    """Ingest rows: unknown enum members become NULL, places lose the work-model mark."""

    def member(name: str, allowed: list[str]) -> Column:
        return F.when(F.col(name).isin(allowed), F.col(name)).alias(name)

    return postings.select(
        "company_id",
        "pos",
        "title",
        "url",
        "external_id",
        "description",
        "description_html",
        "location",
        F.transform(
            F.coalesce("places", F.array().cast("array<struct<city:string,region:string,country:string,raw:string,remote:string>>")),
            lambda p: p.dropFields("remote"),
        ).alias("places"),
        "department",
        member("domain", schema.WORK_DOMAINS),
        member("seniority", schema.SENIORITY_LEVELS),
        member("employment_type", schema.EMPLOYMENT_TYPES),
        member("remote_type", schema.REMOTE_TYPES),
        roles.round_int(F.col("salary_min").cast("double")).alias("salary_min"),
        roles.round_int(F.col("salary_max").cast("double")).alias("salary_max"),
        "salary_currency",
        source.alias("source"),
        "posted_at",
        "valid_through",
    )
