"""URL identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.text import bind, trim_ws

# --- fixed values -----------------------------------------------------------------
TRACKING_PARAMS = [
    r"^utm_", r"^_hs", r"^mc_", r"^pk_", r"^vero_", r"^ga_", r"^hsa_",
    r"^(gh_src|gclid|fbclid|msclkid|dclid|igshid|ttclid|twclid)$",
    r"^(ref|referrer|referer|origin_referrer|originalreferer)$",
    r"^(source|src|from|campaign|medium)$",
    r"^(trk|trackingid|trackingtoken|refid|rid|sid|session|sessionid)$",
    r"^(lever-source|lever-origin|lever-via)$",
]
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "co.nz", "co.za", "co.in", "com.au", "com.br",
    "com.mx", "com.tr", "com.sg", "com.es", "com.pl", "com.pt", "com.ua",
]

_TRACKING = "(?i)" + "|".join(TRACKING_PARAMS)
_HTTP = r"(?i)\A(https?)://([^/?#:\s]+)(:\d*)?(/[^?#]*)?(\?[^#]*)?(#[\s\S]*)?\z"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _HTTP, group)


def is_http_url(c: Column) -> Column:
    return F.trim(c).rlike(_HTTP)


def _form_decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _kept_query(query: Column) -> Column:
    """Parameters without tracking keys, sorted by key, re-encoded; '' when none is left."""
    pairs = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: F.length(p) > 0)
    keyed = F.transform(
        pairs,
        lambda p, i: F.struct(
            _form_decoded(F.substring_index(p, "=", 1)).alias("key"),
            i.alias("at"),
            F.when(p.contains("="), _form_decoded(F.regexp_replace(p, r"\A[^=]*=", "")))
            .otherwise(F.lit(""))
            .alias("value"),
        ),
    )
    wanted = F.filter(keyed, lambda p: ~p["key"].rlike(_TRACKING))
    ordered = F.array_sort(
        F.transform(wanted, lambda p: F.struct(F.lower(p["key"]), p["key"], p["at"], p["value"]))
    )
    encoded = F.transform(ordered, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])))
    return bind(
        F.array_join(encoded, "&"),
        lambda t: F.when(F.length(t) > 0, F.concat(F.lit("?"), t)).otherwise(F.lit("")),
    )


def _split(c: Column) -> Column:
    """The parts of an http(s) URL, found once; `ok` is false for anything else."""
    raw = F.trim(c)
    return F.struct(
        raw.alias("raw"),
        raw.rlike(_HTTP).alias("ok"),
        F.lower(_part(raw, 1)).alias("scheme"),
        F.lower(_part(raw, 2)).alias("host"),
        _part(raw, 3).alias("port"),
        F.regexp_replace(_part(raw, 4), r"/+\z", "").alias("path"),
        _part(raw, 5).alias("query"),
    )


def _path(u: Column) -> Column:
    return F.when(u["path"] == "", "/").otherwise(u["path"])


def normalise_url(c: Column) -> Column:
    """One spelling per page: https, lower host without www, no default port, hash or tracking."""

    def rebuild(u: Column) -> Column:
        drop = u["port"].isin("", ":", ":443") | ((u["scheme"] == "http") & (u["port"] == ":80"))
        return F.when(
            u["ok"],
            F.concat(
                F.lit("https://"), F.regexp_replace(u["host"], r"\Awww\.", ""),
                F.when(drop, "").otherwise(u["port"]), _path(u),
                F.when(F.length(u["query"]) > 1, _kept_query(u["query"])).otherwise(F.lit("")),
            ),
        ).otherwise(trim_ws(u["raw"]))

    return F.when(c.isNotNull(), bind(_split(c), rebuild))


def normalise_source_url(c: Column) -> Column:
    """Lighter form for crawl sources: no hash, lower host, no trailing slash; query kept."""

    def rebuild(u: Column) -> Column:
        drop = (
            u["port"].isin("", ":")
            | ((u["scheme"] == "http") & (u["port"] == ":80"))
            | ((u["scheme"] == "https") & (u["port"] == ":443"))
        )
        return F.when(
            u["ok"],
            F.concat(
                u["scheme"], F.lit("://"), u["host"], F.when(drop, "").otherwise(u["port"]), _path(u),
                F.when(u["query"] == "?", "").otherwise(u["query"]),
            ),
        ).otherwise(F.regexp_replace(u["raw"], r"/+\z", ""))

    return F.when(c.isNotNull(), bind(_split(c), rebuild))


def host_of(c: Column) -> Column:
    raw = F.trim(c)
    return F.lower(F.when(raw.rlike(_HTTP), _part(raw, 2)).otherwise(raw))


def registrable_domain(c: Column) -> Column:
    """Last two host labels, or three under a two-label suffix; addresses stay whole."""
    host = F.regexp_replace(host_of(c), r"\.\z", "")
    labels = F.split(host, r"\.")
    last_two = F.substring_index(host, ".", -2)
    return (
        F.when(~host.contains(".") | host.rlike(r"\A\d+(\.\d+){3}\z"), host)
        .when((F.size(labels) > 2) & last_two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(last_two)
    )


def job_key(platform: Column, external_id: Column, url: Column) -> Column:
    """`platform:id` where the board gives an id, else the normalised URL."""
    return F.when(
        F.length(external_id) > 0,
        F.concat(F.coalesce(platform, F.lit("ats")), F.lit(":"), external_id),
    ).otherwise(normalise_url(url))
