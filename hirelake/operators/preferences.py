"""Wish lists: cleaning, partial updates, filling from a CV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import clean_list, trim_ws
from hirelake.operators.resume import extract_keywords, normalise_resume_text

CLEANED_LISTS = ["countries", "cities", "motivations", "keywords", "titles", "required_keywords", "excluded_keywords"]
PLAIN_LISTS = ["employment_types", "remote_types", "domains", "seniorities", "industries", "excluded_company_ids"]
# Profile field, label shown to the user.
FILLED_FROM_CV = [
    ("titles", "titles"), ("domains", "domains"), ("seniorities", "seniority"),
    ("employment_types", "contract types"), ("cities", "cities"), ("countries", "countries"),
]


def cleaned(name: str, cap: int | None = None) -> Column:
    """A wish list without blanks and repeats, all of it or at most `cap` items."""
    c = F.col(name)
    if name == "countries":
        c = F.transform(c, F.upper)
    return clean_list(c, cap) if name in CLEANED_LISTS else F.array_distinct(c)


def update_profile(preferences: DataFrame, patches: DataFrame, as_of: Column, caps: dict[str, int] | None = None) -> DataFrame:
    """Preferences after partial updates, one patch per user; a NULL field leaves the stored value.

    Lists are cleaned on the way in, and cut where `caps` names a length; a new CV text re-derives the resume keywords; zero clears a
    number and an empty text clears a text.
    """
    have = set(patches.columns)
    new: dict[str, Column] = {n: cleaned(n, (caps or {}).get(n)) for n in [*CLEANED_LISTS, *PLAIN_LISTS] if n in have}
    if "salary_currency" in have:
        new["salary_currency"] = F.upper(trim_ws(F.col("salary_currency")))
    for n in ("min_salary", "max_age_days", "open_to_relocation", "weights", "notify_matches"):
        if n in have:
            new[n] = F.col(n)
    if "resume_text" in have:
        text = normalise_resume_text(F.col("resume_text"))
        new["resume_text"] = text
        new["resume_keywords"] = F.when(text.isNotNull(), extract_keywords(text))
    p = patches.select("user_id", *[F.when(_given(n, have), v).alias(f"_{n}") for n, v in new.items()], F.lit(True).alias("_patched"))
    j = preferences.join(p, "user_id", "full")
    cleared = {"min_salary": F.lit(0), "max_age_days": F.lit(0), "salary_currency": F.lit(""), "resume_text": F.lit("")}
    out = []
    for f in preferences.schema.fields:
        c = F.col(f.name)
        if f.name in new:
            value = F.coalesce(F.col(f"_{f.name}"), c)
            if f.name in cleared:
                value = F.nullif(value, cleared[f.name])
        elif f.name == "resume_updated_at" and "resume_text" in new:
            text = F.col("_resume_text")
            value = F.when(text.isNull(), c).when(text != "", as_of)
        else:
            value = c
        if f.dataType.typeName() == "array":
            value = F.coalesce(value, F.array().cast(f.dataType))
        out.append(value.cast(f.dataType).alias(f.name))
    return j.select(*out)


def _given(name: str, have: set[str]) -> Column:
    source = "resume_text" if name == "resume_keywords" else name
    return F.col(source).isNotNull()


def apply_profile(preferences: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fill empty wishes from a CV reading; never overwrite.

    Adds `filled` and `skipped`: the labels taken over, and those found but already set.
    """
    read = extracted.select("user_id", *[F.col(f).alias(f"_{f}") for f, _ in FILLED_FROM_CV])
    j = preferences.join(read, "user_id")
    found = {f: F.coalesce(F.size(f"_{f}") > 0, F.lit(False)) for f, _ in FILLED_FROM_CV}
    empty = {f: F.coalesce(F.size(f) == 0, F.lit(True)) for f, _ in FILLED_FROM_CV}
    j = j.withColumns(
        {
            "filled": F.array_compact(F.array(*[F.when(found[f] & empty[f], label) for f, label in FILLED_FROM_CV])),
            "skipped": F.array_compact(F.array(*[F.when(found[f] & ~empty[f], label) for f, label in FILLED_FROM_CV])),
        }
    )
    return j.withColumns({f: F.when(found[f] & empty[f], F.col(f"_{f}")).otherwise(F.col(f)) for f, _ in FILLED_FROM_CV}).drop(
        *[f"_{f}" for f, _ in FILLED_FROM_CV]
    )


def excluded_company_names(preferences: DataFrame, companies: DataFrame) -> DataFrame:
    """(user_id, company_id, company_name); ids that name no company are dropped."""
    ids = preferences.select("user_id", F.explode("excluded_company_ids").alias("company_id"))
    return ids.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")
