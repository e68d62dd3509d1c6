"""Careers URLs to (platform, board): which vendor runs a board and under which name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.text import trim_ws
from hirelake.functions.urls import host_of, is_http_url

# --- fixed values: hosts, board-name patterns, names that are no boards -----------------
GREENHOUSE_PATTERNS = [
    r"boards\.greenhouse\.io/embed/job_board\?(?:[^\"'&]*&)?for=([a-z0-9_-]+)",
    r"(?:job-)?boards\.greenhouse\.io/(?:embed/job_board/js\?for=)?([a-z0-9_-]+)",
    r"boards-api\.greenhouse\.io/v1/boards/([a-z0-9_-]+)",
    r"grnhse\.io/([a-z0-9_-]+)",
]
GREENHOUSE_RESERVED = ["embed", "job_board", "js", "v1", "boards"]
LEVER_PATTERNS = [
    r"jobs\.(?:eu\.)?lever\.co/([a-z0-9._-]+)",
    r"api\.(?:eu\.)?lever\.co/v0/postings/([a-z0-9._-]+)",
]
LEVER_RESERVED = ["v0", "postings"]
ASHBY_PATTERNS = [
    r"jobs\.ashbyhq\.com/([a-z0-9._-]+)",
    r"api\.ashbyhq\.com/posting-api/job-board/([a-z0-9._-]+)",
    r"ashbyhq\.com/embed\?[^\"']*jobBoardName=([a-z0-9._-]+)",
]
SMARTRECRUITERS_PATTERNS = [
    r"(?:careers|jobs)\.smartrecruiters\.com/([A-Za-z0-9._-]+)",
    r"api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9._-]+)",
    r"smartrecruiters\.com/embed[^\"']*company=([A-Za-z0-9._-]+)",
]
TEAMTAILOR_PATTERNS = [
    r"([a-z0-9][a-z0-9-]*)\.teamtailor\.com",
    r"teamtailor\.com/widget/[^\"']*[?&]company=([a-z0-9-]+)",
]
TEAMTAILOR_RESERVED = ["www", "app", "api", "assets", "cdn", "support"]
PERSONIO_PATTERN = r"([a-z0-9][a-z0-9-]*)\.jobs\.personio\.(de|com|eu)"
PERSONIO_RESERVED = ["www", "api", "app", "assets", "cdn"]
WORKDAY_HOST = r"\A([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com\z"

SEED_PATTERNS = [
    r"jobs\.ashbyhq\.com/([A-Za-z0-9._-]+)",
    r"job-board/([A-Za-z0-9._-]+)",
    r"boards\.greenhouse\.io/([A-Za-z0-9._-]+)",
    r"job-boards\.greenhouse\.io/([A-Za-z0-9._-]+)",
    r"jobs\.lever\.co/([A-Za-z0-9._-]+)",
    r"careers\.smartrecruiters\.com/([A-Za-z0-9._-]+)",
]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[_found(text, p) for p in patterns])


def _unless(token: Column, reserved: list[str]) -> Column:
    return F.when(~token.isin(reserved), token)


def route_platform(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds platform, token, region, tld, tenant, datacenter, site (all NULL when no vendor claims it)."""
    u = F.trim(F.col(url))
    host = host_of(u)
    on = lambda pattern: host.rlike(rf"(?:^|\.){pattern}\z")

    asked = F.nullif(F.regexp_extract(u, r"\?(?:[^#]*&)?for=([^&#]+)", 1), F.lit(""))
    greenhouse = F.when(
        on(r"(greenhouse\.io|grnhse\.io)"),
        F.coalesce(F.try_url_decode(asked), _unless(_first(u, GREENHOUSE_PATTERNS), GREENHOUSE_RESERVED)),
    )
    lever = F.when(on(r"lever\.co"), _unless(_first(u, LEVER_PATTERNS), LEVER_RESERVED))
    ashby = F.when(on(r"ashbyhq\.com"), _first(u, ASHBY_PATTERNS))
    smart = F.when(on(r"smartrecruiters\.com"), _first(u, SMARTRECRUITERS_PATTERNS))
    team = F.when(
        on(r"teamtailor\.com"),
        F.coalesce(*[_unless(F.lower(_found(u, p)), TEAMTAILOR_RESERVED) for p in TEAMTAILOR_PATTERNS]),
    )
    personio = F.when(on(r"personio\.(de|com|eu)"), _unless(F.lower(_found(host, PERSONIO_PATTERN)), PERSONIO_RESERVED))
    path = F.regexp_extract(u, r"(?i)\Ahttps?://[^/?#]+([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"\A[a-z]{2}-[A-Z]{2}\z"))
    site = F.when(host.rlike(WORKDAY_HOST), F.get(segments, F.lit(0)))

    tokens = [
        ("greenhouse", greenhouse), ("lever", lever), ("ashby", ashby), ("smartrecruiters", smart),
        ("teamtailor", team), ("personio", personio), ("workday", site),
    ]
    claims = F.array(*[F.struct(F.lit(n).alias("platform"), t.alias("token")) for n, t in tokens])
    claim = F.get(F.filter(claims, lambda c: c["token"].isNotNull()), F.lit(0))
    df = df.withColumn("_claim", F.when(is_http_url(u), claim))
    p = F.col("_claim.platform")
    return df.withColumns(
        {
            "platform": p,
            "token": F.when(p != "workday", F.col("_claim.token")),
            "region": F.when((p == "lever") & host.rlike(r"\.eu\.lever\.co"), "eu"),
            "tld": F.when(p == "personio", F.lower(_found(host, PERSONIO_PATTERN, 2))),
            "tenant": F.when(p == "workday", F.regexp_extract(host, WORKDAY_HOST, 1)),
            "datacenter": F.when(p == "workday", F.regexp_extract(host, WORKDAY_HOST, 2)),
            "site": F.when(p == "workday", F.col("_claim.token")),
        }
    ).drop("_claim")


def seed_token(line: Column) -> Column:
    """Board name in one line of a seed file: from a known URL form, or the line itself."""
    v = trim_ws(line)
    bare = F.when(v.rlike(r"\A[A-Za-z0-9._-]+\z"), v)
    token = F.coalesce(_first(v, SEED_PATTERNS), bare)
    return F.when((v != "") & ~v.startswith("#"), token)


def parse_seed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, kind, value): kind is 'url' for boards given as a claimed URL, else 'token'."""
    v = trim_ws(F.col(column))
    kept = lines.select(v.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    routed = route_platform(kept, "line")
    direct = F.col("platform").isNotNull()
    return (
        routed.select(
            "line",
            F.when(direct, "url").otherwise("token").alias("kind"),
            F.when(direct, F.col("line")).otherwise(seed_token(F.col("line"))).alias("value"),
        )
        .filter(F.col("value").isNotNull())
        .dropDuplicates(["kind", "value"])
    )


def read_board_seed_file(spark, path: str) -> DataFrame:
    return parse_seed_lines(spark.read.text(path))


# --- company names from landed feeds ----------------------------------------------------
FEED_FIELDS = {
    # feed -> (array path, fields)
    "himalayas": ("jobs", ["companySlug", "companyName"]),
    "arbeitnow": ("data", ["company_name"]),
    "remoteok": (None, ["company"]),
    "jobicy": ("jobs", ["companyName"]),
}


def read_name_feed(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(feed, name) from landed feed pages (feed, page, payload): all pages, unless there is a `limit`.

    With one, each feed stops after the page on which it reached its even share; what short feeds leave of theirs is
    shared out evenly to the others.
    """
    parts = []
    for feed, (path, fields) in FEED_FIELDS.items():
        item = "struct<" + ",".join(f"{f}:string" for f in fields) + ">"
        payload = F.col("payload") if path is None else F.get_json_object("payload", f"$.{path}")
        rows = pages.filter(F.col("feed") == feed).select(
            "feed", "page", F.posexplode(F.from_json(payload, f"array<{item}>")).alias("at", "j")
        )
        names = F.array(*[F.col("j")[f] for f in fields])
        parts.append(
            rows.select("feed", "page", "at", F.posexplode(names).alias("nth", "name")).filter(F.length(F.trim("name")) > 0)
        )
    names = reduce(DataFrame.unionByName, parts)
    if limit is None:
        return names.select("feed", "page", "at", "nth", "name")
    per_page = names.groupBy("feed", "page").agg(F.count("*").alias("n"))
    totals = per_page.groupBy("feed").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list("n")).alias("totals"))

    def pass_on(left: Column, n: Column) -> Column:
        """Feeds by size: one that is short of its share takes all it has, and the others share what is left."""
        short = n * left["feeds"] <= left["names"]
        rest = F.struct((left["names"] - n).alias("names"), (left["feeds"] - 1).alias("feeds"))
        return F.when(short, rest).otherwise(left)

    begin = F.struct(F.lit(limit).cast("long").alias("names"), F.size("totals").cast("long").alias("feeds"))
    every = F.lit(limit).cast("long")  # with no feed left, each has been read
    share = F.aggregate("totals", begin, pass_on, lambda x: F.when(x["feeds"] > 0, F.ceil(x["names"] / x["feeds"])).otherwise(every))
    before = F.sum("n").over(W.partitionBy("feed").orderBy("page").rowsBetween(W.unboundedPreceding, -1))
    read = per_page.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(totals.select(share.alias("share"))))
    read = read.filter(F.col("before") < F.col("share")).select("feed", "page")
    return names.join(read, ["feed", "page"]).select("feed", "page", "at", "nth", "name")


DIRECTORY = "companies array<struct<name:string,slug:string,status:string>>"


def read_company_directory(pages: DataFrame) -> DataFrame:
    """(page, at, name) of the active companies of a landed directory: the slug, else the name."""
    c = F.col("c")
    return (
        pages.select("page", F.posexplode(F.from_json("payload", DIRECTORY)["companies"]).alias("at", "c"))
        .filter((F.coalesce(c["status"], F.lit("")) == "") | (c["status"] == "Active"))
        .select("page", "at", F.coalesce(F.nullif(c["slug"], F.lit("")), F.nullif(c["name"], F.lit(""))).alias("name"))
        .filter(F.col("name").isNotNull())
    )
