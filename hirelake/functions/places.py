"""Free-text places to (city, region, country), all inside one projection.

A posting lists a handful of places, so the split-and-resolve steps work on small arrays in the
row: no explode, no shuffle. Each step is its own column, which keeps the expressions linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dictionaries import CITIES, COUNTRIES, STATES
from hirelake.functions.text import WS, bind, clean_value, decode_entities, first_of, fold_place, matches, squeeze, trim_edges, trim_ws, words

# --- fixed values: patterns and limits ----------------------------------------------
SEPARATORS = r"\s*(?:;|\||/|\bor\b|\bou\b|\band\b|\bet\b|•|·)\s*"
REMOTE_ONLY = (
    r"^(fully\s+)?(remote|télétravail|teletravail|anywhere|work from home|wfh|distributed)\b"
)
HYBRID_ONLY = r"^hybrid(e)?\b"
SEVERAL_PLACES = (
    r"^(multiple locations|various locations|several locations|other|n\/?a|tbd|flexible|worldwide"
    r"|global|emea|apac|amer|latam|europe|international)$"
)
FIELD_LABELS = r"^(location|lieu|standort|ubicación)$"

_PLACE_TYPE = "array<struct<city:string,region:string,country:string,raw:string,remote:string>>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    # A map is read entry by entry, a set is not, and few words are in the table.
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return bind(key, lambda k: F.when(k.isin(*table), F.try_element_at(literal, k)))


def country_of(c: Column) -> Column:
    return _lookup(COUNTRIES, fold_place(c))


def _qualifier(c: Column) -> Column:
    """True when a trailing part names a country, state or province."""
    return bind(fold_place(c), lambda v: v.isin(*COUNTRIES, *STATES))


def _comma_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), clean_value), lambda p: F.length(p) > 0)


def _after_model(c: Column) -> Column:
    """What is left once a leading work-model word is gone."""
    hybrid, remote = words(HYBRID_ONLY), words(REMOTE_ONLY)
    rest = F.when(c.rlike(hybrid), F.regexp_replace(c, hybrid, "")).otherwise(
        F.regexp_replace(F.regexp_replace(c, remote, ""), r"\)\z", "")
    )
    return clean_value(F.regexp_replace(rest, rf"\A(?:{WS}|[\-–—(,])+", ""))


def _model_of(c: Column) -> Column:
    return F.when(matches(c, HYBRID_ONLY), "HYBRID").when(matches(c, REMOTE_ONLY), "REMOTE")


def _names_a_place(c: Column) -> Column:
    return (F.length(c) > 0) & ~matches(c, SEVERAL_PLACES)


def with_places(df: DataFrame, values: Column, out: str = "places") -> DataFrame:
    """Add `out`: the distinct places named by an array of raw strings, in order."""
    s = "_place_step"
    chunks = F.flatten(
        F.transform(
            F.filter(values, lambda v: F.length(v) > 0),
            lambda v: F.filter(F.split(clean_value(v), words(SEPARATORS)), lambda p: F.length(p) > 0),
        )
    )
    df = df.withColumn(s, F.coalesce(chunks, F.array().cast("array<string>")))
    # "A, B" is two places unless its last part qualifies the first.
    df = df.withColumn(
        s, F.transform(s, lambda v: F.struct(v.alias("whole"), _comma_parts(v).alias("parts")))
    )
    df = df.withColumn(
        s,
        F.flatten(
            F.transform(
                s,
                lambda v: F.when(
                    (F.size(v["parts"]) < 2) | _qualifier(F.try_element_at(v["parts"], F.lit(-1))),
                    F.array(v["whole"]),
                ).otherwise(v["parts"]),
            )
        ),
    )
    df = df.withColumn(s, F.filter(F.transform(s, clean_value), _names_a_place))
    df = df.withColumn(
        s, F.transform(s, lambda v: F.struct(v.alias("raw"), _model_of(v).alias("remote")))
    )
    # A work model in front of a place: strip it, twice at most.
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "body", F.when(v["remote"].isNotNull(), _after_model(v["raw"])).otherwise(v["raw"])
            ),
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "body",
                F.when(_model_of(v["body"]).isNotNull(), _after_model(v["body"])).otherwise(v["body"]),
            ),
        ),
    )
    # A closing parenthesis counts only when it names a country.
    tail = rf"\(([^)]+)\){WS}*\z"
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField("hint", F.regexp_extract(v["body"], tail, 1)).withField(
                "parts",
                F.when(
                    _names_a_place(v["body"]), _comma_parts(F.regexp_replace(v["body"], tail, ""))
                ).otherwise(F.array().cast("array<string>")),
            ),
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "parts",
                F.when(
                    country_of(v["hint"]).isNotNull(),
                    F.concat(v["parts"], F.array(clean_value(v["hint"]))),
                ).otherwise(v["parts"]),
            ),
        ),
    )
    # Right to left: country, then region, the rest is the city.
    df = df.withColumn(
        s,
        F.transform(
            s, lambda v: v.withField("country", country_of(F.try_element_at(v["parts"], F.lit(-1))))
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "parts",
                F.when(
                    v["country"].isNotNull(), F.slice(v["parts"], 1, F.size(v["parts"]) - 1)
                ).otherwise(v["parts"]),
            ),
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "implied",
                F.when(
                    F.size(v["parts"]) > 1,
                    _lookup(STATES, fold_place(F.element_at(v["parts"], -1))),
                ),
            ),
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "region",
                F.when(
                    (F.size(v["parts"]) > 1) & (v["implied"].isNotNull() | v["country"].isNotNull()),
                    F.element_at(v["parts"], -1),
                ),
            ),
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: v.withField(
                "city",
                F.nullif(
                    F.array_join(
                        F.when(
                            v["region"].isNotNull(), F.slice(v["parts"], 1, F.size(v["parts"]) - 1)
                        ).otherwise(v["parts"]),
                        ", ",
                    ),
                    F.lit(""),
                ),
            ),
        ),
    )
    df = df.withColumn(
        s,
        F.transform(
            s,
            lambda v: F.struct(
                v["city"].alias("city"),
                v["region"].alias("region"),
                F.coalesce(
                    v["country"], v["implied"], _lookup(CITIES, fold_place(v["city"]))
                ).alias("country"),
                v["raw"].alias("raw"),
                v["remote"].alias("remote"),
            ),
        ).cast(_PLACE_TYPE),
    )
    known = F.filter(
        s, lambda v: F.coalesce(v["city"], v["region"], v["country"], v["remote"]).isNotNull()
    )
    df = df.withColumn(s, known)
    key = "_place_keys"
    df = df.withColumn(
        key,
        F.transform(
            s,
            lambda v: F.concat_ws(
                "|", *[F.coalesce(v[f], F.lit("")) for f in ("city", "region", "country", "remote")]
            ),
        ),
    )
    first = F.filter(
        s,
        lambda v, i: F.array_position(F.col(key), F.element_at(F.col(key), i + 1)) == i + 1,
    )
    return df.withColumn(out, first).drop(s, key)


def format_places(places: Column, most: int | None = None) -> Column:
    """One display line: at most four distinct labels."""
    labels = F.transform(
        places,
        lambda v: F.when(
            v["city"].isNotNull(),
            F.when(
                v["country"] != "US", F.concat_ws(", ", v["city"], v["country"])
            ).otherwise(F.concat_ws(", ", v["city"], v["region"])),
        )
        .when(v["remote"] == "REMOTE", "Remote")
        .when(v["remote"].isNotNull(), "Hybrid")
        .otherwise(F.coalesce(v["region"], v["country"], v["raw"])),
    )
    joined = F.array_join(first_of(F.array_distinct(labels), most), " · ")
    return F.nullif(joined, F.lit(""))


def clean_location(c: Column) -> Column:
    """A display location: squeezed, trimmed, not too long, not a field label."""
    return bind(trim_ws(trim_edges(squeeze(decode_entities(c)))), lambda v: F.when(_fits(v), v))


def _fits(value: Column) -> Column:
    return (F.length(value) > 0) & ~matches(value, FIELD_LABELS)
