"""Normalise queries: titles, markup, URLs, places, classification, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions import roles, text, urls
from hirelake.functions.markup import sanitize_html
from hirelake.functions.places import clean_location, format_places, with_places
from hirelake.operators import normalise as n
from hirelake.plans.domain import POSTINGS_AT, Domain, at, pick
from hirelake.plans.registry import query
from hirelake.plans.views import fold
from hirelake.plans.views import pick as pick_sql
from hirelake.plans.views import q as quoted

NOW = f"TIMESTAMP '{POSTINGS_AT}'"


def sql_patterns(c: str, patterns: list[tuple[str, str]]) -> str:
    # RE2 reads the patterns as written: ASCII word boundaries.
    whens = " ".join(f"WHEN regexp_matches({c}, {quoted('(?i)' + p)}) THEN '{label}'" for p, label in patterns)
    return f"CASE {whens} END"


# --- titles ---------------------------------------------------------------------------


def dirty_titles(d: Domain) -> DataFrame:
    """Posting titles the way boards mangle them, and the titles of raw pages."""
    i, t = F.col("id"), F.col("title")
    mangled = (
        F.when(i % 7 == 0, F.concat(F.lit("  - "), t, F.lit("  (3) ")))
        .when(i % 7 == 1, F.concat(t, F.lit("   NEW!")))
        .when(i % 7 == 2, F.concat(F.lit("&eacute;quipe &amp; "), t, F.lit(" |")))
        .when(i % 7 == 3, F.concat(F.lit("View "), t))
        .when(i % 7 == 4, F.concat(F.lit("My "), F.substring_index(t, " ", 1)))
        .when(i % 7 == 5, F.concat(t, F.lit(" is a job you will like a lot.")))
        .otherwise(t)
    )
    pages = d.raw("pages").select(
        (-F.col("page_id") - 1).alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    )
    return d.postings.select("id", mangled.alias("title")).unionByName(pages)


DIRTY = """SELECT id, CASE id % 7 WHEN 0 THEN '  - ' || title || '  (3) ' WHEN 1 THEN title || '   NEW!'
  WHEN 2 THEN '&eacute;quipe &amp; ' || title || ' |' WHEN 3 THEN 'View ' || title WHEN 4 THEN 'My ' || split_part(title, ' ', 1)
  WHEN 5 THEN title || ' is a job you will like a lot.' ELSE title END AS title FROM posting
  UNION ALL SELECT -page_id - 1, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages"""
DECODE = "replace(replace(replace({}, '&eacute;', 'é'), '&quot;', '\"'), '&amp;', '&')"
CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + DECODE.format("title")
    + r", '\s+', ' ', 'g'), '^[\s\-–—•|/,:]+', ''), '[\s\-–—•|/,:]+$', ''), '(?i)\b(new|nouveau|urgent|hot|featured)\s*!?$', ''), '\(\s*\d+\s*\)$', ''))"
)


@query("clean_title", f"WITH dirty AS ({DIRTY}) SELECT id, {CLEAN} AS title FROM dirty")
def clean_title(d: Domain) -> DataFrame:
    return dirty_titles(d).select("id", roles.clean_title(F.col("title")).alias("title"))


_NAV = ", ".join(map(quoted, roles.NAV_TITLES))


@query(
    "is_plausible_title",
    f"""WITH dirty AS ({DIRTY}), lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS title FROM documents),
    c AS (SELECT id, {CLEAN} AS t FROM (SELECT * FROM dirty UNION ALL SELECT -1000000 - id, title FROM lines)),
    f AS (SELECT id, t, trim(regexp_replace(lower(strip_accents(t)), '\\s+', ' ', 'g')) AS fd FROM c)
    SELECT id, count(*) AS candidates, count(*) FILTER (WHERE length(t) BETWEEN 3 AND 160 AND regexp_matches(t, '\\p{{L}}') AND fd NOT IN ({_NAV})
      AND NOT (regexp_matches(fd, {quoted('(?i)' + roles.NAV_PREFIXES)}) AND len(string_split(fd, ' ')) <= 4)
      AND NOT (regexp_matches(t, '[.!?]$') AND len(string_split(t, ' ')) > 6) AND len(string_split_regex(t, '\\s+')) <= 22
      AND NOT regexp_matches(t, '^\\d+$') AND NOT regexp_matches(fd, {quoted('(?i)' + roles.LINK_VERBS)})) AS plausible FROM f GROUP BY id""",
)
def is_plausible_title(d: Domain) -> DataFrame:
    lines = d.raw("documents").select((-1000000 - F.col("doc_id")).alias("id"), F.explode(F.split("text", "\n")).alias("title"))
    titles = dirty_titles(d).unionByName(lines).select("id", roles.clean_title(F.col("title")).alias("title"))
    return titles.groupBy("id").agg(
        F.count("*").alias("candidates"), F.count_if(roles.is_plausible_title(F.col("title"))).alias("plausible")
    )


# --- markup ---------------------------------------------------------------------------


@query("decode_entities", f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {DECODE.format('html')} AS t FROM pages)")
def decode_entities(d: Domain) -> DataFrame:
    t = text.decode_entities(F.col("html"))
    return d.raw("pages").select("page_id", F.length(t).cast("bigint").alias("chars"), F.md5(t).alias("digest"))


NUMERIC = ["&#38;", "&#x26;", "&#233;", "&#xE9;", "&#8364;", "&#x1F600;"]


@query(
    "decode_entities_numeric",
    "SELECT id, title || ' ' || CASE id % 6 WHEN 0 THEN '&' WHEN 1 THEN '&' WHEN 2 THEN 'é' WHEN 3 THEN 'é' WHEN 4 THEN '€' ELSE chr(128512) END || ' end &unknown;' AS title FROM posting",
)
def decode_entities_numeric(d: Domain) -> DataFrame:
    raw = F.concat("title", F.lit(" "), pick(F.col("id") % 6, NUMERIC), F.lit(" end &unknown;"))
    return d.postings.select("id", text.decode_entities(raw).alias("title"))


def sql_strip(c: str) -> str:
    t = f"regexp_replace(regexp_replace({c}, '(?i)<script[\\s\\S]*?</script>', ' ', 'g'), '(?i)<style[\\s\\S]*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)</(p|div|li|tr|h[1-6])>', chr(10), 'g')"
    t = DECODE.format(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' ?\\n ?', chr(10), 'g')"
    return f"trim(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"


@query("strip_html", f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {sql_strip('html')} AS t FROM pages)")
def strip_html(d: Domain) -> DataFrame:
    t = text.strip_html(F.col("html"))
    return d.raw("pages").select("page_id", F.length(t).cast("bigint").alias("chars"), F.md5(t).alias("digest"))


@query("sanitize_html")
def sanitize(d: Domain) -> DataFrame:
    return d.raw("pages").select("page_id", sanitize_html(F.col("html")).alias("html"))


_HTMLISH = r"(?i)<(p|div|br|ul|ol|li|h[1-6]|strong|em|span|table)\b[^>]*>"


@query(
    "looks_like_html",
    f"SELECT 'page' AS kind, page_id AS id, regexp_matches(html, '{_HTMLISH}') AS html FROM pages UNION ALL SELECT 'doc', doc_id, regexp_matches(text, '{_HTMLISH}') FROM documents",
)
def looks_like_html(d: Domain) -> DataFrame:
    pages = d.raw("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.looks_like_html(F.col("html")).alias("html"))
    docs = d.raw("documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), text.looks_like_html(F.col("text")).alias("html"))
    return pages.unionByName(docs)


@query(
    "pick_description",
    f"""SELECT page_id, md5(t) AS text_digest, length(t) AS chars, has_html FROM (
    SELECT page_id, {sql_strip("CASE WHEN page_id % 3 = 0 THEN 'Plain ' || page_id ELSE html END")} AS t, page_id % 3 <> 0 AS has_html FROM pages)""",
)
def pick_description(d: Domain) -> DataFrame:
    p = F.col("page_id")
    rows = d.raw("pages").select(
        "page_id",
        F.when(p % 3 == 0, F.concat(F.lit("Plain "), p.cast("string"))).when(p % 3 == 1, F.col("html")).alias("description"),
        F.when(p % 3 == 2, F.col("html")).alias("description_html"),
    )
    t = F.col("description")
    return n.pick_description(rows).select(
        "page_id", F.md5(t).alias("text_digest"), F.length(t).cast("bigint").alias("chars"),
        F.col("description_html").isNotNull().alias("has_html"),
    )


# --- URLs -----------------------------------------------------------------------------


def raw_urls(d: Domain) -> DataFrame:
    """Page URLs and posting URLs with the noise links pick up."""
    i = F.col("id")
    noisy = (
        F.when(i % 6 == 0, F.concat(F.lit("HTTP://WWW.Jobs.example.co.uk:80/a/"), i.cast("string"), F.lit("/?utm_source=x&b=2&a=1#top")))
        .when(i % 6 == 1, F.concat("url", F.lit("?gh_src=abc&page=2&REF=z")))
        .when(i % 6 == 2, F.concat("url", F.lit("///")))
        .when(i % 6 == 3, F.concat(F.lit("  not a url "), i.cast("string"), F.lit(" ")))
        .when(i % 6 == 4, F.concat(F.lit("https://10.0.0.1:8443/p?q=a b&q=&sid=9&id="), i.cast("string")))
        .otherwise(F.col("url"))
    )
    pages = d.raw("pages").select((-F.col("page_id") - 1).alias("id"), "url")
    return d.postings.select("id", noisy.alias("url")).unionByName(pages)


URLS = """SELECT id, CASE id % 6 WHEN 0 THEN 'HTTP://WWW.Jobs.example.co.uk:80/a/' || id || '/?utm_source=x&b=2&a=1#top'
  WHEN 1 THEN url || '?gh_src=abc&page=2&REF=z' WHEN 2 THEN url || '///' WHEN 3 THEN '  not a url ' || id || ' '
  WHEN 4 THEN 'https://10.0.0.1:8443/p?q=a b&q=&sid=9&id=' || id ELSE url END AS url, CAST(NULL AS VARCHAR) AS page FROM posting
  UNION ALL SELECT -page_id - 1, url, url FROM pages"""
# Page URLs carry at most: http, #fragment, a trailing slash, ref, utm_source.
_PAGE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(page, '^http:', 'https:'), '#.*$', ''), '//www\\.', '//'), '[?]utm_source=[^&]*$', ''), '&ref=[^&]*$', ''), '([^/])/+$', '\\1')"


@query(
    "normalise_url",
    f"""WITH raw AS ({URLS}) SELECT id, CASE WHEN page IS NOT NULL THEN {_PAGE} ELSE CASE id % 6 WHEN 0 THEN 'https://jobs.example.co.uk/a/' || id || '?a=1&b=2'
      WHEN 1 THEN regexp_extract(url, '^[^?]*') || '?page=2' WHEN 2 THEN rtrim(url, '/') WHEN 3 THEN 'not a url ' || id
      WHEN 4 THEN 'https://10.0.0.1:8443/p?id=' || id || '&q=a+b&q=' ELSE url END END AS url FROM raw""",
)
def normalise_url(d: Domain) -> DataFrame:
    return raw_urls(d).select("id", urls.normalise_url(F.col("url")).alias("url"))


@query(
    "normalise_source_url",
    f"""WITH raw AS ({URLS}) SELECT id, CASE WHEN page IS NOT NULL THEN regexp_replace(regexp_replace(page, '#.*$', ''), '([^/])/+$', '\\1') ELSE
      CASE id % 6 WHEN 0 THEN 'http://www.jobs.example.co.uk/a/' || id || '?utm_source=x&b=2&a=1' WHEN 1 THEN url
      WHEN 2 THEN rtrim(url, '/') WHEN 3 THEN 'not a url ' || id ELSE url END END AS url FROM raw""",
)
def normalise_source_url(d: Domain) -> DataFrame:
    return raw_urls(d).select("id", urls.normalise_source_url(F.col("url")).alias("url"))


@query(
    "registrable_domain",
    f"""WITH raw AS ({URLS}) SELECT id, CASE WHEN page IS NOT NULL THEN regexp_extract(page, '([^./]+\\.[^./]+)(/|$|\\?|#)', 1) ELSE
      CASE id % 6 WHEN 0 THEN 'example.co.uk' WHEN 3 THEN 'not a url ' || id WHEN 4 THEN '10.0.0.1' ELSE 'example.com' END END AS domain FROM raw""",
)
def registrable_domain(d: Domain) -> DataFrame:
    return raw_urls(d).select("id", urls.registrable_domain(F.col("url")).alias("domain"))


# --- places ---------------------------------------------------------------------------

# raw text, then the places it must give as city~region~country~remote
RAW_PLACES = [
    ("Paris, France", ["Paris~~FR~"]),
    ("San Francisco, New York City", ["San Francisco~~US~", "New York City~~US~"]),
    ("Remote - Germany", ["~~DE~REMOTE"]),
    ("Austin, TX", ["Austin~TX~US~"]),
    ("Berlin (HQ)", ["Berlin~~DE~"]),
    ("Paris (France); London | Paris, FR", ["Paris~~FR~", "London~~GB~"]),
    ("Hybrid - Lyon", ["Lyon~~FR~HYBRID"]),
    ("Montreuil, IDF, FR", ["Montreuil~IDF~FR~"]),
    ("EMEA", []),
    ("Toronto, ON or Remote (US)", ["Toronto~ON~CA~", "~~US~REMOTE"]),
    ("Deutschland / &Eacute;tats-Unis", ["~~DE~", "~~US~"]),
    ("Atlantis", ["Atlantis~~~"]),
]
LABELS = ["Paris, FR", "San Francisco · New York City", "Remote", "Austin, TX", "Berlin, DE", "Paris, FR · London, GB", "Lyon, FR",
          "Montreuil, FR", None, "Toronto, CA · Remote", "DE · US", "Atlantis"]


def raw_places(d: Domain) -> DataFrame:
    """Two raw texts per posting: one of the fixed ones, and a numbered depot nobody knows."""
    i = F.col("id")
    fixed = pick(i % 12, [r for r, _ in RAW_PLACES])
    depot = F.when(i % 5 == 0, F.concat(F.lit(" - Depot "), (i % 100).cast("string"), F.lit(", wa ")))
    rows = d.postings.select("id", fixed.alias("raw"), depot.alias("depot"))
    return with_places(rows, F.array("raw", "depot"))


_DEPOT = "CASE WHEN id % 5 = 0 THEN 'Depot ' || (id % 100) || '~wa~US~' END"


@query(
    "parse_locations",
    f"""SELECT id, array_to_string(list_filter([{pick_sql('id % 12', ['|'.join(p) if p else None for _, p in RAW_PLACES])}, {_DEPOT}], lambda x: x IS NOT NULL), '|') AS places FROM posting""",
)
def parse_locations(d: Domain) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    line = lambda p: F.concat_ws("~", blank(p["city"]), blank(p["region"]), blank(p["country"]), blank(p["remote"]))
    return raw_places(d).select("id", F.array_join(F.transform("places", line), "|").alias("places"))


@query(
    "format_locations",
    f"""SELECT id, nullif(array_to_string(list_filter([{pick_sql('id % 12', LABELS)}, CASE WHEN id % 5 = 0 THEN 'Depot ' || (id % 100) || ', wa' END], lambda x: x IS NOT NULL), ' · '), '') AS location FROM posting""",
)
def format_locations(d: Domain) -> DataFrame:
    return raw_places(d).select("id", format_places(F.col("places")).alias("location"))


@query(
    "clean_location",
    """SELECT id, CASE id % 4 WHEN 0 THEN title || ' & Co' WHEN 1 THEN NULL WHEN 2 THEN repeat(title, 30) ELSE title END AS location FROM posting""",
)
def clean_loc(d: Domain) -> DataFrame:
    i, t = F.col("id"), F.col("title")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit(" – "), t, F.lit(" &amp;  Co, ")))
        .when(i % 4 == 1, F.lit(" Standort: "))
        .when(i % 4 == 2, F.repeat(t, 30))
        .otherwise(t)
    )
    return d.postings.select("id", clean_location(raw).alias("location"))


@query("location_dictionaries", "SELECT id, CASE id % 5 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'US' WHEN 3 THEN 'BE' END AS country FROM posting")
def location_dictionaries(d: Domain) -> DataFrame:
    from hirelake.functions.places import country_of

    return d.postings.select("id", country_of(pick(F.col("id") % 5, [" France", "ALEMANIA", "États-Unis", "België", "Nowhere"])).alias("country"))


# --- classification ---------------------------------------------------------------------

NOUNS = ["Security Analyst", "iOS Engineer", "Développeuse", "QA Lead", "Développeur confirmé", "VP Sales", "Stage données", "Engineering Manager", "Chef de produit", "Jr. Accountant"]
_NOUN = f"title || ' ' || {pick_sql('id % 11', NOUNS, '')}"


def titled(d: Domain):
    return d.postings.withColumn("t", F.concat("title", F.lit(" "), pick(F.col("id") % 11, NOUNS, "")))


def _both(c: str, patterns) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(strip_accents({c}), {quoted('(?i)' + p)}) OR regexp_matches({c}, {quoted('(?i)' + p)}) THEN '{label}'" for p, label in patterns
    )
    return f"CASE {whens} END"


@query("classify_domain", f"SELECT id, {_both('hay', roles.DOMAIN_PATTERNS)} AS domain FROM (SELECT id, {_NOUN} || ' ' || coalesce(department, '') AS hay FROM posting)")
def classify_domain(d: Domain) -> DataFrame:
    return titled(d).select("id", roles.classify_domain(F.col("t"), F.col("department")).alias("domain"))


@query("classify_seniority", f"SELECT id, {_both('hay', roles.SENIORITY_PATTERNS)} AS seniority FROM (SELECT id, {_NOUN} AS hay FROM posting)")
def classify_seniority(d: Domain) -> DataFrame:
    return titled(d).select("id", roles.classify_seniority(F.col("t")).alias("seniority"))


CONTRACTS = ["Full-Time", "CDI temps plein", "PART_TIME", "alternance", None, "bénévolat", "Self employed", "W2 contract", "seasonal"]
_EMP = lambda c: sql_patterns(f"replace(strip_accents({c}), '_', ' ')", roles.EMPLOYMENT_PATTERNS)


@query(
    "normalise_employment",
    f"""SELECT id, coalesce({_EMP('stated')}, {_EMP('t')}, {_EMP('head')}) AS employment_type FROM (
    SELECT id, {pick_sql('id % 10', CONTRACTS)} AS stated, {_NOUN} AS t, description AS head FROM posting)""",
)
def normalise_employment(d: Domain) -> DataFrame:
    stated = pick(F.col("id") % 10, CONTRACTS)
    return titled(d).select(
        "id", roles.normalise_employment(stated, F.col("t"), F.col("description")).alias("employment_type")
    )


MODELS = ["Hybrid, 2 days a week in the office", "Fully remote", "On-site", "Télétravail total", "Remote friendly", "anywhere", "", "présentiel", "Remotely"]
_REMOTE = "(?i)" + roles.REMOTE_WORDS


@query(
    "normalise_remote",
    f"""SELECT id, CASE WHEN regexp_matches(t, {quoted('(?i)' + roles.HYBRID_PATTERN)}) THEN 'HYBRID' WHEN regexp_matches(t, {quoted('(?i)' + roles.FULLY_REMOTE_PATTERN)}) THEN 'REMOTE'
      WHEN id % 13 = 0 THEN 'REMOTE' WHEN regexp_matches(t, {quoted('(?i)' + roles.ON_SITE_PATTERN)}) THEN 'ON_SITE' WHEN regexp_matches(t, {quoted(_REMOTE)}) THEN 'REMOTE' END AS remote_type,
      coalesce(regexp_matches(raw, {quoted(_REMOTE)}), false) AS remote
    FROM (SELECT id, raw, strip_accents(title || ' ' || coalesce(raw, '')) AS t FROM (SELECT id, title, {pick_sql('id % 10', MODELS)} AS raw FROM posting))""",
)
def normalise_remote(d: Domain) -> DataFrame:
    raw = pick(F.col("id") % 10, MODELS)
    return d.postings.select(
        "id",
        roles.normalise_remote(F.when(F.col("id") % 13 == 0, F.lit(True)), F.col("title"), raw).alias("remote_type"),
        roles.is_remote(raw).alias("remote"),
    )


def pay_texts(d: Domain) -> DataFrame:
    i, low = F.col("id"), F.coalesce("salary_min", F.lit(30))
    k = F.floor(low / 1000).cast("string")
    raw = (
        F.when(i % 6 == 0, F.concat(F.lit("Pay: €"), k, F.lit("k - "), (F.floor(low / 1000) + 9).cast("string"), F.lit("k per year")))
        .when(i % 6 == 1, F.concat(F.lit("between "), k, F.lit(".500 to "), k, F.lit(".900 CHF")))
        .when(i % 6 == 2, F.lit("about 15 to 20 hours"))
        .when(i % 6 == 3, F.concat(k, F.lit("k – 10k")))
        .when(i % 6 == 4, F.concat(F.lit("$ "), k, F.lit(",000 to $ "), k, F.lit(",500")))
        .otherwise(F.concat(F.lit("pay by agreement, call 555-382 or 12 - 14 h for "), "title"))
    )
    # Every other text states its pay only after thousands of other characters.
    whole = F.when(i % 12 < 6, F.concat(F.repeat(F.lit("about the team "), 400), raw)).otherwise(raw)
    return d.postings.select("id", whole.alias("t"), F.floor(low / 1000).alias("k"))


@query(
    "parse_salary",
    """WITH k AS (SELECT id, floor(coalesce(salary_min, 30) / 1000) AS k, description FROM posting)
    SELECT id, CAST(CASE WHEN id % 6 = 0 AND k >= 10 THEN k * 1000 WHEN id % 6 = 1 AND k >= 1 THEN k * 1000 + 500 WHEN id % 6 = 4 AND k >= 1 THEN k * 1000 END AS INTEGER) AS salary_min,
      CAST(CASE WHEN id % 6 = 0 AND k >= 10 THEN (k + 9) * 1000 WHEN id % 6 = 1 AND k >= 1 THEN k * 1000 + 900 WHEN id % 6 = 4 AND k >= 1 THEN k * 1000 + 500 END AS INTEGER) AS salary_max,
      CASE WHEN id % 6 = 0 AND k >= 10 THEN 'EUR' WHEN id % 6 = 4 AND k >= 1 THEN 'USD' END AS salary_currency FROM k""",
)
def parse_salary(d: Domain) -> DataFrame:
    pay = roles.parse_salary(F.col("t"))
    return pay_texts(d).select("id", pay.alias("p")).select(
        "id", F.col("p.min").alias("salary_min"), F.col("p.max").alias("salary_max"), F.col("p.currency").alias("salary_currency")
    )


@query(
    "coerce_date",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2006 THEN o_orderdate END WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate + INTERVAL 3650 DAY
      WHEN 3 THEN CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2006 THEN o_orderdate + INTERVAL 30 MINUTE END END AS posted_at FROM orders""",
)
def coerce_date(d: Domain) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    raw = (
        F.when(k % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k % 6 == 1, (F.unix_timestamp(day) * 1).cast("string"))
        .when(k % 6 == 2, F.unix_millis(day + F.make_dt_interval(F.lit(3650))).cast("string"))
        .when(k % 6 == 3, F.date_format(day, "yyyy-MM-dd'T'00:30:00'Z'"))
        .when(k % 6 == 4, F.lit("soon"))
    )
    return d.raw("orders").select("o_orderkey", roles.coerce_date(raw, at(POSTINGS_AT)).alias("posted_at"))


@query("fold", f"SELECT doc_id, md5({fold('text')}) AS folded FROM documents")
def fold_text(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.md5(text.fold_key(F.col("text"))).alias("folded"))


@query(
    "clean_list",
    """SELECT doc_id, array_to_string(list_transform(list_slice(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL), 1, 40), lambda x: x), '|') AS items
    FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS w FROM documents)""",
)
def clean_list(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.array_join(text.clean_list(F.split("text", " "), 40), "|").alias("items"))


@query("capitalise_slug", "SELECT id, CASE WHEN name = lower(name) THEN upper(substr(name, 1, 1)) || substr(name, 2) ELSE name END AS name FROM company")
def capitalise_slug(d: Domain) -> DataFrame:
    return d.companies.select("id", roles.capitalise_slug(F.col("name")).alias("name"))


@query(
    "salary_label",
    """WITH s AS (SELECT id, salary_min AS a, salary_max AS b, CAST(floor(salary_min / 1000.0 + 0.5) AS BIGINT) || 'k' AS ka, CAST(floor(salary_max / 1000.0 + 0.5) AS BIGINT) || 'k' AS kb FROM posting)
    SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN ka || '€ – ' || kb || '€' WHEN a IS NOT NULL THEN ka || '+' WHEN b IS NOT NULL THEN 'Up to ' || kb || '€' END AS label FROM s""",
)
def salary_label(d: Domain) -> DataFrame:
    return d.postings.select("id", roles.salary_label(F.col("salary_min"), F.col("salary_max")).alias("label"))


@query(
    "relative_date",
    f"""SELECT id, CASE WHEN n < 0 THEN NULL WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 30 THEN n || 'd ago'
    WHEN n // 30 < 12 THEN (n // 30) || 'mo ago' ELSE (n // 30 // 12) || 'y ago' END AS age FROM (SELECT id, date_diff('day', posted_at, {NOW}) AS n FROM posting)""",
)
def relative_date(d: Domain) -> DataFrame:
    return d.postings.select("id", roles.relative_date(F.col("posted_at"), at(POSTINGS_AT)).alias("age"))


# --- the listing job ----------------------------------------------------------------------


def raw_listing(d: Domain, copies: bool = True) -> DataFrame:
    """Raw jobs as boards list them: every posting, a quarter of them twice, fuller the second time."""
    i, none = F.col("id"), F.lit(None).cast("string")
    both = F.explode(F.when(i % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = d.postings.withColumn("copy", both if copies else F.lit(0))
    full = F.col("copy") == 1
    return rows.select(
        F.lit("lever").alias("platform"),
        F.concat(F.lit("https://jobs.lever.co/c"), F.col("company_id").cast("string")).alias("board_url"),
        (i * 2 + F.col("copy")).alias("pos"),
        "external_id",
        F.concat(F.lit(" "), "title", F.lit(" (2)")).alias("title"),
        F.concat("url", F.lit("?utm_source=feed")).alias("url"),
        F.when(full | (i % 4 != 0), F.col("description")).alias("description"),
        none.alias("description_html"),
        pick(i % 6, ["Paris, France", "Berlin (Germany)", "Austin, TX", "UK", "Remote"]).alias("location"),
        F.array().cast("array<string>").alias("locations"),
        "department",
        none.alias("domain"), none.alias("seniority"),
        pick(i % 5, ["Full-time", "Internship", "Contract", "Part time"]).alias("employment_type"),
        F.lit(None).cast("boolean").alias("remote"),
        F.when(i % 3 == 0, F.col("remote_type")).alias("remote_type"),
        F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"),
        "salary_currency",
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"),
        F.when(full, F.date_format("valid_through", "yyyy-MM-dd")).alias("valid_through"),
        F.lit(False).alias("partial"),
    )


def listing(d: Domain) -> DataFrame:
    return n.dedupe_listing(n.normalise_postings(raw_listing(d), at(POSTINGS_AT)))


_LOCATION = pick_sql("id % 6", ["Paris, FR", "Berlin, DE", "Austin, TX", "GB", "Remote"])
_RANGE = lambda c: f"CASE WHEN {c} BETWEEN 1000 AND 10000000 THEN {c} END"


@query(
    "normalise_postings",
    f"""WITH j AS (SELECT *, {_both("title || ' ' || coalesce(department, '')", roles.DOMAIN_PATTERNS)} AS dom, {_both('title', roles.SENIORITY_PATTERNS)} AS sen FROM posting)
    SELECT id, title, url, {_LOCATION} AS location, dom AS domain, sen AS seniority, department, {_EMP("coalesce(" + pick_sql('id % 5', ['Full-time', 'Internship', 'Contract', 'Part time']) + ", '')")} AS stated_type,
      CASE WHEN id % 3 = 0 AND remote_type IS NOT NULL THEN remote_type WHEN id % 6 = 4 THEN 'REMOTE' END AS remote_type,
      {_RANGE('salary_min')} AS salary_min, {_RANGE('salary_max')} AS salary_max,
      CASE WHEN coalesce({_RANGE('salary_min')}, {_RANGE('salary_max')}) IS NOT NULL THEN salary_currency END AS salary_currency,
      CASE WHEN year(posted_at) BETWEEN 2000 AND 2006 THEN posted_at END AS posted_at
    FROM j""",
)
def normalise_postings(d: Domain) -> DataFrame:
    rows = n.normalise_postings(raw_listing(d, copies=False), at(POSTINGS_AT))
    stated = F.col("pos").cast("bigint") / 2 % 5
    return rows.select(
        (F.col("pos") / 2).cast("bigint").alias("id"), "title", "url", "location", "domain", "seniority", "department",
        F.when(stated < 4, F.col("employment_type")).alias("stated_type"), "remote_type", "salary_min", "salary_max",
        "salary_currency", "posted_at",
    )


_KEY = "CASE WHEN external_id IS NOT NULL THEN 'lever:' || external_id ELSE url END"


@query(
    "dedupe_listing",
    f"SELECT 'https://jobs.lever.co/c' || company_id AS board_url, {_KEY} AS job_key, id * 2 + CASE WHEN id % 4 = 0 AND (description IS NOT NULL OR year(valid_through) BETWEEN 2000 AND 2006) THEN 1 ELSE 0 END AS pos FROM posting",
)
def dedupe_listing(d: Domain) -> DataFrame:
    return listing(d).select("board_url", "job_key", "pos")


_DIGIT = lambda at_: f"sum(CAST('0x' || substr(sha1(k), {at_}, 15) AS BIGINT))"


def fingerprint_sql(source: str) -> str:
    return f"""SELECT board_url, sha1(n || ':' || lo || ':' || hi) AS content_hash, n AS job_count FROM (
      SELECT board_url, count(*) AS n, {_DIGIT(1)} AS lo, {_DIGIT(16)} AS hi FROM ({source}) GROUP BY 1)"""


_KEYED = f"SELECT 'https://jobs.lever.co/c' || company_id AS board_url, {_KEY} AS k, id FROM posting"


@query("board_fingerprint", fingerprint_sql(_KEYED))
def board_fingerprint(d: Domain) -> DataFrame:
    return n.board_fingerprint(job_keys(d))


def job_keys(d: Domain) -> DataFrame:
    return d.postings.select(
        F.concat(F.lit("https://jobs.lever.co/c"), F.col("company_id").cast("string")).alias("board_url"),
        urls.job_key(F.lit("lever"), F.col("external_id"), F.col("url")).alias("job_key"), "id",
        "company_id", "created_at",
    )


@query(
    "diff_listings",
    f"""WITH now AS ({fingerprint_sql(_KEYED)}), before AS ({fingerprint_sql("SELECT 'https://jobs.lever.co/c' || company_id AS board_url, " + _KEY + " AS k FROM posting WHERE company_id % 3 = 0 OR (company_id % 3 = 1 AND created_at < TIMESTAMP '2000-01-01')")})
    SELECT now.board_url, now.job_count FROM now LEFT JOIN before USING (board_url) WHERE now.content_hash IS DISTINCT FROM before.content_hash""",
)
def diff_listings(d: Domain) -> DataFrame:
    keys = job_keys(d)
    c = F.col("company_id")
    before = keys.filter((c % 3 == 0) | ((c % 3 == 1) & (F.col("created_at") < at("2000-01-01"))))
    return n.diff_listings(n.board_fingerprint(before), n.board_fingerprint(keys)).select("board_url", "job_count")


@query(
    "to_posting_dto",
    "SELECT id AS pos, CASE WHEN id % 3 <> 0 THEN domain END AS domain, CASE WHEN id % 3 <> 1 THEN employment_type END AS employment_type, remote_type, len(places) AS places, salary_min FROM posting JOIN posting_places USING (id)",
)
def to_posting_dto(d: Domain) -> DataFrame:
    i = F.col("id")
    kind = "array<struct<city:string,region:string,country:string,raw:string,remote:string>>"
    places = F.transform("places", lambda p: p.withField("remote", F.lit(None).cast("string"))).cast(kind)
    rows = d.with_place_lists(d.postings).withColumns(
        {
            "pos": i, "places": places,
            "domain": F.when(i % 3 == 0, F.lit("WIZARDRY")).otherwise(F.col("domain")),
            "employment_type": F.when(i % 3 == 1, F.lit("full time")).otherwise(F.col("employment_type")),
        }
    )
    return n.to_posting_rows(rows, F.col("source")).select(
        "pos", "domain", "employment_type", "remote_type", F.size("places").cast("bigint").alias("places"), "salary_min"
    )
