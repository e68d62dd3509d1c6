"""Reader, routing, seed and CSV queries over answers rebuilt from the posting table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.crawl import count_landed_jobs
from hirelake.plans.domain import Domain, pick
from hirelake.plans.registry import query
from hirelake.plans.views import pick as pick_sql
from hirelake.plans.views import q as quoted
from hirelake.session import cut_lineage
from hirelake.sources import company_csv as csv
from hirelake.sources import listings as l
from hirelake.sources import routing as r

PAGE = 20  # parts per page: one answer holds a slice of a board


RAW = ["id", "title", "url", "location", "department", "employment_type", "salary_min", "salary_max", "salary_currency", "posted_at", "valid_through"]


def pages(d: Domain, overlap: bool = False) -> DataFrame:
    """The postings of each page of each board as one list; what a vendor makes of them is worked out in the row.

    With `overlap` the last fifth of a page is on the next page as well, marked `again`.
    """
    part = F.floor(F.col("id") / 100000)
    page = (F.floor(part / PAGE) + 1).cast("int")
    own = F.array(F.struct(page.alias("page"), F.lit(False).alias("again")))
    both = F.concat(own, F.array(F.struct((page + 1).alias("page"), F.lit(True).alias("again"))))
    at = F.when((part % PAGE >= PAGE - 4) & F.lit(overlap), both).otherwise(own)
    rows = d.postings.select(*RAW, "company_id", F.explode(at).alias("at")).select(*RAW, "company_id", "at.page", "at.again")
    grouped = rows.groupBy("company_id", "page").agg(F.collect_list(F.struct("again", *RAW)).alias("rows"))
    return grouped.select(F.concat(F.lit("c"), F.col("company_id").cast("string")).alias("token"), "page", "rows")


def fields(x: Column):
    """The fields every vendor publishes, of one listed posting, by name."""
    made = {
        "sid": x["id"].cast("string"),
        "iso": F.date_format(x["posted_at"], "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "html": F.when(x["id"] % 2 == 0, F.concat(F.lit("<p>R&D &amp; "), x["title"], F.lit("</p>"))),
    }
    return lambda name: (made[name] if name in made else x[name]).alias(name)


def answers(listed: DataFrame, platform: str, item, wrap, overlap: bool = False) -> DataFrame:
    """Landed answers of one vendor: the page's items, sorted by id, as one JSON text."""
    token = F.col("token") if platform != "workday" else F.concat("token", F.lit(".wd3.careers"))
    own = F.col("rows") if overlap else F.filter("rows", lambda x: ~x["again"])
    made = F.transform(own, lambda x: F.struct(x["id"].alias("id"), item(fields(x)).alias("item")))
    texts = listed.select("page", token.alias("token"), F.transform(F.array_sort(made), lambda x: x["item"]).alias("items")).filter(F.size("items") > 0)
    return texts.select(
        F.lit(platform).alias("platform"), F.concat_ws("/", F.lit(platform), F.col("token")).alias("board_url"), "token", "page", wrap.alias("payload")
    )


def wrapped(name: str, **more) -> Column:
    return F.to_json(F.struct(F.col("items").alias(name), *[v.alias(k) for k, v in more.items()]))


def s(*columns) -> Column:
    return F.struct(*columns)


def greenhouse(listed: DataFrame) -> DataFrame:
    def item(c):
        encoded = F.regexp_replace(F.regexp_replace(F.regexp_replace(c("html"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
        return s(
            c("id"), c("title"), c("url").alias("absolute_url"), c("iso").alias("first_published"), F.lit("2020-01-01").alias("updated_at"),
            encoded.alias("content"), s(c("location").alias("name")).alias("location"),
            F.when(c("id") % 3 == 0, F.array(s(F.lit("Madrid").alias("name")), s(F.lit("").alias("name")))).alias("offices"),
            F.array(s(c("department").alias("name"))).alias("departments"),
        )

    return answers(listed, "greenhouse", item, wrapped("jobs"))


def out(rows: DataFrame, *columns: str) -> DataFrame:
    places = F.array_join("locations", "|").alias("locations")
    return rows.select("board_url", "external_id", "title", "url", places, *columns)


_BOARD = lambda p, suffix="": f"'{p}/c' || company_id || '{suffix}' AS board_url"
_ISO = "strftime(posted_at, '%Y-%m-%dT%H:%M:%SZ')"
_HTML = "CASE WHEN id % 2 = 0 THEN '<p>R&D &amp; ' || title || '</p>' END"


@query(
    "read_listing_greenhouse",
    f"""SELECT {_BOARD('greenhouse')}, CAST(id AS VARCHAR) AS external_id, title, url, array_to_string(list_filter([location, CASE WHEN id % 3 = 0 THEN 'Madrid' END], lambda x: x IS NOT NULL), '|') AS locations,
    {_HTML} AS description, department, coalesce({_ISO}, '2020-01-01') AS posted_at FROM posting""",
)
def read_listing_greenhouse(d: Domain) -> DataFrame:
    return out(l.read_listing_greenhouse(greenhouse(pages(d))), "description", "department", "posted_at")


def lever(listed: DataFrame) -> DataFrame:
    def item(c):
        i = c("id")
        return s(
            c("sid").alias("id"), c("title").alias("text"), F.when(i % 5 != 0, c("url")).alias("hostedUrl"),
            F.when(i % 5 == 0, F.when(i % 10 == 0, F.concat(c("url"), F.lit("/apply")))).alias("applyUrl"),
            F.unix_millis(c("posted_at").cast("timestamp")).alias("createdAt"),
            pick(i % 4, ["Remote", "hybrid", "On-Site"], "unspecified").alias("workplaceType"),
            F.when(i % 2 == 1, F.concat(F.lit(" "), c("title"), F.lit(" "))).alias("descriptionPlain"), c("html").alias("description"),
            s(
                c("location").alias("location"), F.array(F.lit("Madrid"), F.lit("")).alias("allLocations"), F.when(i % 3 == 0, F.lit("Core")).alias("team"),
                c("department").alias("department"), c("employment_type").alias("commitment"),
            ).alias("categories"),
            F.when(i % 2 == 0, s(c("salary_min").alias("min"), c("salary_max").alias("max"), c("salary_currency").alias("currency"))).alias("salaryRange"),
        )

    return answers(listed, "lever", item, F.to_json("items"))


@query(
    "read_listing_lever",
    f"""SELECT {_BOARD('lever')}, CAST(id AS VARCHAR) AS external_id, title, CASE WHEN id % 5 <> 0 THEN url ELSE url || '/apply' END AS url, array_to_string(list_filter([location, 'Madrid'], lambda x: x IS NOT NULL), '|') AS locations,
    CASE WHEN id % 2 = 1 THEN title ELSE {_HTML} END AS description, CASE WHEN id % 3 = 0 THEN 'Core' ELSE department END AS department, employment_type, id % 4 = 0 AS remote,
    {pick_sql('id % 4', ['REMOTE', 'HYBRID', 'ON_SITE'])} AS remote_type, CASE WHEN id % 2 = 0 THEN salary_min::DOUBLE END AS salary_min, CASE WHEN id % 2 = 0 THEN salary_currency END AS salary_currency,
    strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at FROM posting WHERE id % 5 <> 0 OR id % 10 = 0""",
)
def read_listing_lever(d: Domain) -> DataFrame:
    return out(l.read_listing_lever(lever(pages(d))), "description", "department", "employment_type", "remote", "remote_type", "salary_min", "salary_currency", "posted_at")


def ashby(listed: DataFrame) -> DataFrame:
    def item(c):
        i = c("id")
        part = lambda a, b, cur: s(a.cast("double").alias("minValue"), b.cast("double").alias("maxValue"), cur.alias("currencyCode"))
        return s(
            c("sid").alias("id"), c("title"), c("url").alias("jobUrl"), c("location"), F.array(s(F.lit("Madrid").alias("location"))).alias("secondaryLocations"),
            c("department"), F.lit("Team").alias("team"), c("employment_type").alias("employmentType"), (i % 2 == 0).alias("isRemote"), c("iso").alias("publishedAt"),
            c("title").alias("descriptionPlain"), c("html").alias("descriptionHtml"),
            s(F.array(part(F.lit(0), F.lit(None).cast("int"), F.lit("XXX")), part(c("salary_min"), c("salary_max"), c("salary_currency"))).alias("summaryComponents")).alias("compensation"),
        )

    return answers(listed, "ashby", item, wrapped("jobs"))


@query(
    "read_listing_ashby",
    f"""SELECT {_BOARD('ashby')}, CAST(id AS VARCHAR) AS external_id, title, url, array_to_string(list_filter([location, 'Madrid'], lambda x: x IS NOT NULL), '|') AS locations, title AS description, {_HTML} AS description_html,
    coalesce(department, 'Team') AS department, id % 2 = 0 AS remote, salary_min::DOUBLE AS salary_min, salary_max::DOUBLE AS salary_max,
    CASE WHEN coalesce(salary_min, salary_max) IS NOT NULL THEN salary_currency END AS salary_currency, {_ISO} AS posted_at FROM posting""",
)
def read_listing_ashby(d: Domain) -> DataFrame:
    return out(l.read_listing_ashby(ashby(pages(d))), "description", "description_html", "department", "remote", "salary_min", "salary_max", "salary_currency", "posted_at")


def smartrecruiters(listed: DataFrame) -> DataFrame:
    def item(c):
        i = c("id")
        return s(
            c("sid").alias("id"), c("title").alias("name"), c("iso").alias("releasedDate"), F.when(i % 2 == 0, s(F.lit("Owner").alias("identifier"))).alias("company"),
            s(F.lit("Paris").alias("city"), F.when(i % 3 == 0, F.lit("Paris")).otherwise(F.lit(" ")).alias("region"), F.lit("fr").alias("country"), (i % 4 == 0).alias("remote")).alias("location"),
            s(c("department").alias("label")).alias("department"), s(c("employment_type").alias("label")).alias("typeOfEmployment"),
        )

    return answers(listed, "smartrecruiters", item, wrapped("content", totalFound=F.size("items")))


@query(
    "read_listing_smartrecruiters",
    f"""SELECT {_BOARD('smartrecruiters')}, CAST(id AS VARCHAR) AS external_id, title, 'https://jobs.smartrecruiters.com/' || CASE WHEN id % 2 = 0 THEN 'Owner' ELSE 'c' || company_id END || '/' || id AS url,
    'Paris, FR' AS locations, department, employment_type, id % 4 = 0 AS remote, {_ISO} AS posted_at FROM posting""",
)
def read_listing_smartrecruiters(d: Domain) -> DataFrame:
    return out(l.read_listing_smartrecruiters(smartrecruiters(pages(d))), "department", "employment_type", "remote", "posted_at")


def teamtailor(listed: DataFrame) -> DataFrame:
    """Pages overlap: the last fifth of each page's jobs is listed on the next page as well."""
    def item(c):
        i = c("id")
        return s(
            F.when(i % 3 != 0, c("sid")).alias("id"), F.when(i % 7 != 0, c("title")).alias("title"), c("url"), c("iso").alias("date_published"), c("html").alias("content_html"),
            s(
                s(F.when(i % 6 == 0, i).alias("value")).alias("identifier"), c("employment_type").alias("employmentType"), F.date_format(c("valid_through"), "yyyy-MM-dd").alias("validThrough"),
                F.array(s(s(F.lit("Paris").alias("addressLocality"), F.lit("FR").alias("addressCountry")).alias("address")), s(s(F.lit("").alias("addressLocality"), F.lit("").alias("addressCountry")).alias("address"))).alias("jobLocation"),
            ).alias("_jobposting"),
        )

    return answers(listed, "teamtailor", item, wrapped("items"), overlap=True)


@query(
    "read_listing_teamtailor",
    f"""WITH j AS (SELECT *, id // 100000 // {PAGE} + 1 + CASE WHEN (id // 100000) % {PAGE} >= {PAGE - 4} THEN 1 ELSE 0 END AS last_page FROM posting WHERE id % 7 <> 0)
    SELECT {_BOARD('teamtailor')}, CASE WHEN id % 3 <> 0 OR id % 6 = 0 THEN CAST(id AS VARCHAR) END AS external_id, title, url, 'Paris, FR' AS locations, {_HTML} AS description, employment_type,
    strftime(valid_through, '%Y-%m-%d') AS valid_through, max(id // 100000 // {PAGE} + 1) OVER (PARTITION BY company_id) >= 20 AS partial FROM j""",
)
def read_listing_teamtailor(d: Domain) -> DataFrame:
    return out(l.read_listing_teamtailor(teamtailor(pages(d, overlap=True)), max_pages=20), "description", "employment_type", "valid_through", "partial")


def personio(listed: DataFrame) -> DataFrame:
    def item(c):
        i = c("id")
        tag = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))).otherwise(F.lit(""))
        cdata = lambda v: F.concat(F.lit("<![CDATA["), v, F.lit("]]>"))
        description = lambda n, v: F.concat(F.lit("<jobDescription>"), tag("name", n), tag("value", v), F.lit("</jobDescription>"))
        return F.concat(
            F.lit("<position>"), tag("id", c("sid")), tag("office", c("location")),
            F.lit("<additionalOffices><office>Madrid</office><office> </office></additionalOffices>"),
            tag("department", F.when(i % 2 == 0, c("department"))), tag("recruitingCategory", F.lit("0042_Sales &amp; Co")), tag("name", cdata(c("title"))),
            F.lit("<jobDescriptions>"), description(F.lit("Your role"), cdata(F.concat(F.lit("<p>"), c("title"), F.lit("</p>")))), description(F.lit("Empty"), F.lit("")), description(F.lit(None), F.lit("More")),
            F.lit("</jobDescriptions>"), tag("employmentType", F.when(i % 3 != 0, F.lit("permanent"))), tag("schedule", F.lit("full-time")), tag("createdAt", c("iso")), F.lit("</position>\n"),
        )

    feed = F.concat(F.lit("<workzag-jobs>"), F.array_join("items", ""), F.lit("</workzag-jobs>"))
    return answers(listed, "personio", item, feed)


@query(
    "read_listing_personio",
    f"""SELECT {_BOARD('personio')}, CAST(id AS VARCHAR) AS external_id, title, 'https://c' || company_id || '.jobs.personio.de/job/' || id AS url, array_to_string(list_filter([location, 'Madrid'], lambda x: x IS NOT NULL), '|') AS locations,
    '<h3>Your role</h3><p>' || title || '</p>' || chr(10) || 'More' AS description, CASE WHEN id % 2 = 0 AND department IS NOT NULL THEN department ELSE 'Sales & Co' END AS department,
    CASE WHEN id % 3 <> 0 THEN 'permanent full-time' ELSE 'full-time' END AS employment_type, {_ISO} AS posted_at FROM posting""",
)
def read_listing_personio(d: Domain) -> DataFrame:
    return out(l.read_listing_personio(personio(pages(d))), "description", "department", "employment_type", "posted_at")


def workday(listed: DataFrame) -> DataFrame:
    def item(c):
        i = c("id")
        return s(
            c("title"), F.when(i % 9 != 0, F.concat(F.lit("/job/x/Some_Title_"), c("sid"))).alias("externalPath"), c("location").alias("locationsText"), c("iso").alias("startDate")
        )

    # Every third board states more postings than it lists.
    stated = F.when(F.substring_index(F.split_part("token", F.lit("."), F.lit(1)), "c", -1).cast("int") % 3 == 0, 1_000_000_000).otherwise(F.size("items"))
    return answers(listed, "workday", item, wrapped("jobPostings", total=stated))


@query(
    "read_listing_workday",
    f"""SELECT {_BOARD('workday', '.wd3.careers')}, CAST(id AS VARCHAR) AS external_id, title, 'https://c' || company_id || '.wd3.myworkdayjobs.com/en-US/careers/job/x/Some_Title_' || id AS url,
    location, {_ISO} AS posted_at, company_id % 3 = 0 AS partial FROM posting WHERE id % 9 <> 0""",
)
def read_listing_workday(d: Domain) -> DataFrame:
    return l.read_listing_workday(workday(pages(d))).select("board_url", "external_id", "title", "url", "location", "posted_at", "partial")


def every_vendor(d: Domain) -> DataFrame:
    vendors = (greenhouse, lever, ashby, smartrecruiters, teamtailor, personio, workday)
    listed = cut_lineage(pages(d, overlap=True))  # read by each of them
    return reduce(DataFrame.unionByName, [v(listed) for v in vendors])


@query(
    "union_listings",
    """SELECT platform, count(*) AS jobs, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT 'greenhouse' AS platform, id FROM posting UNION ALL SELECT 'lever', id FROM posting WHERE id % 5 <> 0 OR id % 10 = 0
    UNION ALL SELECT 'workday', id FROM posting WHERE id % 9 <> 0 UNION ALL SELECT unnest(['ashby', 'smartrecruiters', 'personio']), id FROM posting
    UNION ALL SELECT 'teamtailor', CASE WHEN id % 3 <> 0 OR id % 6 = 0 THEN id END FROM posting WHERE id % 7 <> 0) GROUP BY 1""",
)
def union_listings(d: Domain) -> DataFrame:
    return l.union_listings(every_vendor(d)).groupBy("platform").agg(F.count("*").alias("jobs"), F.sum(F.col("external_id").cast("bigint")).alias("ids"))


@query(
    "count_landed_jobs",
    f"""SELECT platform, page, CAST(count(*) AS BIGINT) AS jobs FROM (SELECT unnest(['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'teamtailor', 'personio', 'workday']) AS platform, id // 100000 // {PAGE} + 1 AS page, id FROM posting
    UNION ALL SELECT 'teamtailor', id // 100000 // {PAGE} + 2, id FROM posting WHERE (id // 100000) % {PAGE} >= {PAGE - 4}) GROUP BY 1, 2""",
)
def landed_jobs(d: Domain) -> DataFrame:
    return count_landed_jobs(every_vendor(d)).groupBy("platform", "page").agg(F.sum("job_count").alias("jobs"))


# --- routing --------------------------------------------------------------------------

ROUTES = [
    # url with {} for the number, platform, token
    ("https://boards.greenhouse.io/acme{}/jobs", "greenhouse", "acme{}"),
    ("https://boards.greenhouse.io/embed/job_board?for=acme{}&b=1", "greenhouse", "acme{}"),
    ("https://jobs.eu.lever.co/acme{}/x", "lever", "acme{}"),
    ("https://jobs.ashbyhq.com/acme{}", "ashby", "acme{}"),
    ("https://careers.smartrecruiters.com/Acme{}", "smartrecruiters", "Acme{}"),
    ("https://ACME{}.teamtailor.com/jobs", "teamtailor", "acme{}"),
    ("https://acme{}.jobs.personio.com/", "personio", "acme{}"),
    ("https://acme{}.wd5.myworkdayjobs.com/en-US/Careers", "workday", None),
    ("https://www.example.com/jobs/{}", None, None),
    ("https://app.teamtailor.com/{}", None, None),
    ("not a url {}", None, None),
]
_SQL_ROUTE = lambda i: " ".join(f"WHEN {n} THEN " + ("NULL" if x[i] is None else f"replace({quoted(x[i])}, '{{}}', CAST(c_custkey AS VARCHAR))") for n, x in enumerate(ROUTES))


def careers(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    return d.raw("customer").select("c_custkey", F.replace(pick(k % 11, [x[0] for x in ROUTES]), F.lit("{}"), k.cast("string")).alias("url"))


@query(
    "route_platform",
    f"""SELECT c_custkey, CASE c_custkey % 11 {_SQL_ROUTE(1)} END AS platform, CASE c_custkey % 11 {_SQL_ROUTE(2)} END AS token, CASE WHEN c_custkey % 11 = 2 THEN 'eu' END AS region,
    CASE WHEN c_custkey % 11 = 6 THEN 'com' END AS tld, CASE WHEN c_custkey % 11 = 7 THEN 'acme' || c_custkey END AS tenant, CASE WHEN c_custkey % 11 = 7 THEN 'Careers' END AS site FROM customer""",
)
def route_platform(d: Domain) -> DataFrame:
    return r.route_platform(careers(d)).select("c_custkey", "platform", "token", "region", "tld", "tenant", "site")


SEEDS = ["# note {}", "", "https://jobs.lever.co/acme{}", "  acme-{} ", "two words {}", "see https://jobs.ashbyhq.com/acme{} now"]


@query(
    "read_board_seed_file",
    """SELECT DISTINCT CASE WHEN o_orderkey % 6 = 2 THEN 'url' ELSE 'token' END AS kind, CASE o_orderkey % 6 WHEN 2 THEN 'https://jobs.lever.co/acme' || o_custkey WHEN 3 THEN 'acme-' || o_custkey ELSE 'acme' || o_custkey END AS value
    FROM orders WHERE o_orderkey % 6 IN (2, 3, 5)""",
)
def read_board_seed_file(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    lines = d.raw("orders").select(F.replace(pick(k % 6, SEEDS), F.lit("{}"), F.col("o_custkey").cast("string")).alias("value"))
    return r.parse_seed_lines(lines).select("kind", "value")


def feed_pages(d: Domain) -> DataFrame:
    """Four job feeds of ten names a page, from the customer table."""
    k = F.col("c_custkey")
    feed = pick(k % 4, ["himalayas", "arbeitnow", "remoteok", "jobicy"])
    rows = d.raw("customer").select(feed.alias("feed"), (F.floor(k / 40) + 1).cast("int").alias("page"), "c_custkey", "c_name")
    slug = F.lower("c_name")
    item = F.struct(slug.alias("companySlug"), F.col("c_name").alias("companyName"), F.col("c_name").alias("company_name"), F.col("c_name").alias("company"))
    pages = rows.groupBy("feed", "page").agg(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("item")))).alias("items")).withColumn(
        "items", F.transform("items", lambda x: x["item"])
    )
    payload = (
        F.when(F.col("feed") == "remoteok", F.to_json("items"))
        .when(F.col("feed") == "arbeitnow", wrapped("data"))
        .otherwise(wrapped("jobs"))
    )
    return pages.select("feed", "page", payload.alias("payload"))


@query(
    "read_name_feed",
    """WITH n AS (SELECT c_custkey % 4 AS f, c_custkey // 40 + 1 AS page, c_name, c_custkey FROM customer),
    names AS (SELECT f, page, CASE f WHEN 0 THEN 'himalayas' WHEN 1 THEN 'arbeitnow' WHEN 2 THEN 'remoteok' ELSE 'jobicy' END AS feed, unnest(CASE WHEN f = 0 THEN [lower(c_name), c_name] ELSE [c_name] END) AS name FROM n)
    SELECT feed, page, name FROM names WHERE page <= CASE WHEN f = 0 THEN 5 ELSE 10 END""",
)
def read_name_feed(d: Domain) -> DataFrame:
    return r.read_name_feed(feed_pages(d), 400).select("feed", "page", "name")


@query(
    "read_name_feed_all",
    """SELECT 'himalayas' AS feed, c_custkey // 40 + 1 AS page, unnest([lower(c_name), c_name]) AS name FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT CASE c_custkey % 4 WHEN 1 THEN 'arbeitnow' WHEN 2 THEN 'remoteok' ELSE 'jobicy' END, c_custkey // 40 + 1, c_name FROM customer WHERE c_custkey % 4 <> 0""",
)
def read_name_feed_all(d: Domain) -> DataFrame:
    return r.read_name_feed(feed_pages(d)).select("feed", "page", "name")


@query(
    "read_company_directory",
    "SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE lower(s_name) END AS name FROM supplier WHERE s_suppkey % 4 <> 1",
)
def read_company_directory(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    item = F.struct(
        F.col("s_name").alias("name"), F.when(k % 3 != 0, F.lower("s_name")).alias("slug"), pick(k % 4, ["Active", "Acquired", "Active", ""]).alias("status")
    )
    pages = d.raw("supplier").groupBy(F.floor(k / 25).cast("int").alias("page")).agg(F.collect_list(item).alias("items"))
    return r.read_company_directory(pages.select("page", wrapped("companies").alias("payload"))).select("name")


# --- company CSV ----------------------------------------------------------------------


def csv_rows(d: Domain) -> DataFrame:
    i = F.col("id")
    return d.companies.select(
        F.when(i % 9 != 0, F.concat(F.lit(" "), "name")).otherwise(F.lit("  ")).alias("name"), "website", F.col("careers_url").alias("careersUrl"),
        F.when(i % 8 == 0, F.lit("Wizardry")).otherwise(F.lower("industry")).alias("industry"), "country",
    )


@query("read_company_csv", "SELECT name, website, careers_url, industry, country, 'PENDING' AS status FROM company WHERE id % 9 <> 0 AND id % 8 <> 0")
def read_company_csv(d: Domain) -> DataFrame:
    return csv.check_companies(csv_rows(d))[0]


@query("read_company_csv_errors", "SELECT CASE WHEN id % 9 = 0 THEN 'Name is required' ELSE 'Invalid industry' END AS message, country FROM company WHERE id % 9 = 0 OR id % 8 = 0")
def read_company_csv_errors(d: Domain) -> DataFrame:
    bad = csv.check_companies(csv_rows(d))[1]
    return bad.select(F.substring_index("message", ".", 1).alias("message"), F.get_json_object("data", "$.country").alias("country"))


@query("import_counts", "SELECT count(*) FILTER (WHERE id % 9 <> 0 AND id % 8 <> 0) AS success_count, count(*) FILTER (WHERE id % 9 = 0 OR id % 8 = 0) AS error_count FROM company")
def import_counts(d: Domain) -> DataFrame:
    return csv.import_counts(csv_rows(d))


@query(
    "write_company_csv",
    "SELECT name, coalesce(website, '') AS website, coalesce(careers_url, '') AS \"careersUrl\", coalesce(industry, '') AS industry, country, status FROM company WHERE status IN ('APPROVED', 'PENDING')",
)
def write_company_csv(d: Domain) -> DataFrame:
    return csv.export_companies(d.companies, status=["APPROVED", "PENDING"]).drop("created_at", "id")
