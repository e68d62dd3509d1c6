"""Ingest and entity queries: identity, near duplicates, merge, lifecycle of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.roles import round_int
from hirelake.functions.similarity import trigram_similarity
from hirelake.operators import entities as e
from hirelake.operators import events as ev
from hirelake.operators import merge as m
from hirelake.plans.domain import EVENTS_AT, POSTINGS_AT, Domain, at
from hirelake.plans.registry import query
from hirelake.plans.views import fold
from hirelake.session import cut_lineage

SEEN = f"TIMESTAMP '{POSTINGS_AT}'"


def seen():
    return at(POSTINGS_AT)


def incoming(d: Domain) -> DataFrame:
    return m.with_identity(d.incoming)


def spark_id():
    """The driver's keys are numbers: a new row keeps the number it came with."""
    return F.col("pos")


# The incoming rows and everything the merge derives from them, as SQL.
_PAD = "'  ' || w || ' '"
_GRAMS = f"list_distinct(flatten(list_transform(list_filter(string_split({{}}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr({_PAD}, i, 3)))))"
INCOMING = f"""SELECT id AS pos, company_id, CASE WHEN id % 10 = 6 THEN title || ' II' ELSE title END AS title, url, external_id, description,
  location, places, CASE WHEN id % 10 <> 7 THEN department END AS department, domain, seniority, employment_type, remote_type,
  salary_min, salary_max, salary_currency, source, posted_at, valid_through FROM posting JOIN posting_places USING (id) WHERE id % 10 >= 5"""
PREPARED = f"""SELECT *, {fold('title')} || '|' || {fold("coalesce(list_filter(places, lambda x: x.city <> '')[1].city, split_part(location, ',', 1), '')")} AS own_key,
  sha256(array_to_string(list_concat([coalesce(title, ''), coalesce(external_id, ''), coalesce(description, ''), '', coalesce(location, ''),
  coalesce(department, ''), coalesce(domain, ''), coalesce(seniority, ''), coalesce(employment_type, ''), coalesce(remote_type, ''),
  coalesce(CAST(salary_min AS VARCHAR), ''), coalesce(CAST(salary_max AS VARCHAR), ''), coalesce(salary_currency, ''), coalesce(source, ''),
  coalesce(CAST(posted_at AS VARCHAR), ''), coalesce(CAST(valid_through AS VARCHAR), '')],
  list_sort(list_transform(places, lambda x: x.city || '~' || x.region || '~' || x.country || '~' || x.raw))), chr(0))) AS content_hash FROM inc"""
NEAR = f"""WITH a AS (SELECT DISTINCT company_id, own_key, split_part(own_key, '|', 1) AS t, split_part(own_key, '|', 2) AS c FROM prep),
  b AS (SELECT company_id, dedup_key, split_part(dedup_key, '|', 1) AS t, split_part(dedup_key, '|', 2) AS c, min(created_at) AS created_at FROM stored GROUP BY ALL),
  ga AS (SELECT *, {_GRAMS.format('t')} AS g FROM a), gb AS (SELECT *, {_GRAMS.format('t')} AS g FROM b),
  sims AS (SELECT ga.company_id, ga.own_key, gb.dedup_key, gb.created_at, len(list_intersect(ga.g, gb.g)) AS n, len(ga.g) AS na, len(gb.g) AS nb
    FROM ga JOIN gb ON ga.company_id = gb.company_id AND ga.c = gb.c AND least(len(ga.g), len(gb.g)) >= 0.9 * greatest(len(ga.g), len(gb.g)))
  SELECT company_id, own_key, dedup_key AS existing FROM sims WHERE n > 0 AND n / (na + nb - n)::DOUBLE >= 0.9
  QUALIFY row_number() OVER (PARTITION BY company_id, own_key ORDER BY n / (na + nb - n)::DOUBLE DESC, created_at, dedup_key) = 1"""
RESOLVED = "SELECT prep.*, coalesce(near.existing, prep.own_key) AS dedup_key FROM prep LEFT JOIN near ON near.company_id = prep.company_id AND near.own_key = prep.own_key"
BASE = f"inc AS ({INCOMING}), prep AS ({PREPARED})"
WITH_KEYS = f"{BASE}, near AS ({NEAR}), res AS ({RESOLVED})"


@query("dedup_key", f"SELECT id, dedup_key FROM keyed")
def dedup_key(d: Domain) -> DataFrame:
    rows = d.with_place_lists(d.postings.drop("dedup_key"))
    return rows.select("id", m.dedup_key(F.col("title"), F.col("places"), F.col("location")).alias("dedup_key"))


@query("content_hash", "SELECT id, content_hash FROM hashed")
def content_hash(d: Domain) -> DataFrame:
    return d.with_place_lists(d.postings.drop("content_hash")).select("id", m.content_hash(F.col("places")).alias("content_hash"))


@query("round_int", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice + 0.5) AS INTEGER) AS price FROM lineitem")
def rounded(d: Domain) -> DataFrame:
    return d.raw("lineitem").select("l_orderkey", "l_linenumber", round_int(F.col("l_extendedprice")).alias("price"))


@query(
    "trigram_similarity",
    f"""SELECT id, round(CASE WHEN n = 0 THEN 0 ELSE n / (na + nb - n)::DOUBLE END, 9) AS similarity FROM (SELECT id, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM
    (SELECT id, {_GRAMS.format(fold('title'))} AS a, {_GRAMS.format("lower(department)")} AS b FROM posting WHERE department IS NOT NULL))""",
)
def similarity(d: Domain) -> DataFrame:
    sim = trigram_similarity(F.col("title"), F.col("department"))
    rows = d.postings.filter("department IS NOT NULL").withColumn("title", m.fold_key(F.col("title")))
    return rows.select("id", F.round(sim, 9).alias("similarity"))


@query("resolve_near_duplicates", f"WITH {WITH_KEYS} SELECT pos, dedup_key FROM res")
def resolve_near_duplicates(d: Domain) -> DataFrame:
    return m.resolve_near_duplicates(incoming(d), d.stored).select("pos", "dedup_key")


MATCHES = """WITH pairs AS (
  SELECT s.id, 0 AS rank, v.pos, v.url FROM stored s JOIN res v ON s.company_id = v.company_id AND s.url = v.url
  UNION ALL SELECT s.id, 1, v.pos, v.url FROM stored s JOIN res v ON s.company_id = v.company_id AND s.external_id = v.external_id
  UNION ALL SELECT s.id, 2, v.pos, v.url FROM stored s JOIN res v ON s.company_id = v.company_id AND s.dedup_key = v.dedup_key)
  SELECT id, pos, url FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, pos, url) = 1"""


def resolved(d: Domain, columns: list[str] | None = None) -> DataFrame:
    """The batch with settled keys, written once; `columns` are those that the caller reads, all without it."""
    batch, texts = m.set_texts_aside(incoming(d))
    rows = m.resolve_near_duplicates(batch, d.stored)
    return cut_lineage(rows.select(*columns)) if columns else m.with_texts(cut_lineage(rows), texts)


IDENTITY = list(dict.fromkeys([*m.ORDER, *m.MATCH_KEYS]))


@query("match_incoming", f"WITH {WITH_KEYS}, matches AS ({MATCHES}) SELECT id, pos FROM matches")
def match_incoming(d: Domain) -> DataFrame:
    return m.match_incoming(d.stored, resolved(d, IDENTITY)).select("id", "pos")


# A batch row shut out by nothing stored; what is left collides on the key at most (urls and ids are the posting's own).
FRESH = """SELECT * FROM res v WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.company_id = v.company_id AND s.url = v.url)
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.company_id = v.company_id AND s.external_id = v.external_id)
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.company_id = v.company_id AND s.dedup_key = v.dedup_key)
  QUALIFY row_number() OVER (PARTITION BY company_id, dedup_key ORDER BY pos) = 1"""


@query("insert_new", f"WITH {WITH_KEYS}, fresh AS ({FRESH}) SELECT pos AS id, title, url, location FROM fresh")
def insert_new(d: Domain) -> DataFrame:
    new = m.insert_new(resolved(d, [*IDENTITY, "title", "location"]), d.stored, seen(), spark_id())
    return new.select("id", "title", "url", "location")


# One board under two companies, chains of rows that shut each other out, exact repeats and two spellings of a board. The
# oracle walks each company's rows one by one and keeps a row if none of its keys was taken.
SHARED_SQL = """
WITH RECURSIVE part AS (SELECT id // 100000 AS k, company_id FROM posting),
rows AS (
  SELECT company_id + o AS company_id, k AS pos, 'u' || (k % 40) AS url, CASE WHEN k % 5 > 0 THEN 'e' || (k // 7 % 30) END AS external_id,
    'k' || (k // 3 % 50) AS dedup_key, 'board' || s AS source
  FROM part, (VALUES (0), (500000)) AS a(o), (VALUES (''), ('/')) AS b(s) WHERE s = '' OR k % 11 = 0),
numbered AS (
  SELECT *, list_filter(['u:' || url, 'e:' || external_id, 'k:' || dedup_key], lambda x: x IS NOT NULL) AS keys,
    row_number() OVER (PARTITION BY company_id ORDER BY pos, url, source) AS n FROM rows),
walk AS (
  SELECT DISTINCT company_id, 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::BIGINT AS pos FROM rows
  UNION ALL
  SELECT w.company_id, r.n, CASE WHEN list_has_any(w.used, r.keys) THEN w.used ELSE list_concat(w.used, r.keys) END,
    CASE WHEN NOT list_has_any(w.used, r.keys) THEN r.pos END
  FROM walk w JOIN numbered r ON r.company_id = w.company_id AND r.n = w.n + 1)
SELECT company_id, pos FROM walk WHERE pos IS NOT NULL"""


@query("insert_new_shared_boards", SHARED_SQL)
def insert_new_shared_boards(d: Domain) -> DataFrame:
    k = F.floor(F.col("id") / 100000)
    rows = d.postings.select(k.alias("pos"), "company_id")
    rows = rows.unionByName(rows.filter("pos % 9 = 0"))
    sources = F.when(F.col("pos") % 11 == 0, F.array(F.lit("board"), F.lit("board/"))).otherwise(F.array(F.lit("board")))
    companies = F.explode(F.array(F.col("company_id"), F.col("company_id") + 500000))
    rows = rows.select("pos", companies.alias("company_id"), sources.alias("sources"))
    rows = rows.select("pos", "company_id", F.explode("sources").alias("source"))
    keyed = rows.withColumns(
        {
            "url": F.concat(F.lit("u"), F.col("pos") % 40),
            "external_id": F.when(F.col("pos") % 5 > 0, F.concat(F.lit("e"), F.floor(F.col("pos") / 7) % 30)),
            "dedup_key": F.concat(F.lit("k"), F.floor(F.col("pos") / 3) % 50),
        }
    )
    return m.insert_new(keyed, d.stored, seen(), F.col("pos")).select("company_id", "pos")


MERGED = f"""SELECT s.id, m.pos IS NOT NULL AS seen, m.pos IS NOT NULL AND s.content_hash IS DISTINCT FROM v.content_hash AS changed,
  s.title AS old_title, v.title AS new_title, s.department AS old_dep, v.department AS new_dep, s.closed_at AS old_closed, s.content_hash AS old_hash,
  v.content_hash AS new_hash, s.updated_at AS old_updated, s.last_seen_at AS old_seen, s.salary_max AS old_max, v.salary_max AS new_max
  FROM stored s LEFT JOIN matches m ON m.id = s.id LEFT JOIN res v ON v.pos = m.pos"""
_VALUES = f"""CASE WHEN changed THEN coalesce(new_title, old_title) ELSE old_title END AS title, CASE WHEN changed THEN coalesce(new_dep, old_dep) ELSE old_dep END AS department,
  CASE WHEN changed THEN coalesce(new_max, old_max) ELSE old_max END AS salary_max, CASE WHEN changed THEN new_hash ELSE old_hash END AS content_hash,
  CASE WHEN changed THEN {SEEN} ELSE old_updated END AS updated_at"""
_TOUCHED = f"CASE WHEN seen THEN {SEEN} ELSE old_seen END AS last_seen_at, CASE WHEN NOT seen THEN old_closed END AS closed_at"
_COLUMNS = ["title", "department", "salary_max", "content_hash", "updated_at", "last_seen_at", "closed_at"]


@query("merge_changed", f"WITH {WITH_KEYS}, matches AS ({MATCHES}), merged AS ({MERGED}) SELECT id, seen, changed, {_VALUES}, {_TOUCHED} FROM merged")
def merge_changed(d: Domain) -> DataFrame:
    v = resolved(d)
    return m.merge_changed(d.stored, v, m.match_incoming(d.stored, v), seen()).select("id", "seen", "changed", *_COLUMNS)


@query("touch_seen", f"WITH {WITH_KEYS}, matches AS ({MATCHES}), merged AS ({MERGED}) SELECT id, {_TOUCHED} FROM merged")
def touch_seen(d: Domain) -> DataFrame:
    return m.touch_seen(d.stored, m.match_incoming(d.stored, resolved(d, IDENTITY)), seen()).select("id", "last_seen_at", "closed_at")


# Places: every third posting is sent with new places, one of them twice and over-long.
SENT = """SELECT id AS posting_id, [{'city': 'Madrid', 'region': '', 'country': 'es', 'raw': 'Madrid, es'},
  {'city': 'Gent', 'region': repeat('r', 130), 'country': 'be', 'raw': repeat('x', 250)}, {'city': 'Gent', 'region': repeat('r', 140), 'country': 'BE', 'raw': 'late'}] AS places FROM posting WHERE id % 3 = 0"""
SYNCED = f"""WITH sent AS ({SENT}), flat AS (SELECT posting_id, i, places[i].city AS city, places[i].region AS region, upper(places[i].country) AS country, places[i].raw AS raw
    FROM (SELECT posting_id, places, unnest([1, 2, 3]) AS i FROM sent)),
  new AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY posting_id, city, region, country ORDER BY i) = 1)
  SELECT posting_id, city, region, country, raw FROM place WHERE posting_id NOT IN (SELECT posting_id FROM sent)
  UNION ALL SELECT n.posting_id, n.city, n.region, n.country, coalesce(p.raw, n.raw) FROM new n LEFT JOIN place p USING (posting_id, city, region, country)"""


@query("sync_locations", SYNCED)
def sync_locations(d: Domain) -> DataFrame:
    place = lambda city, region, country, raw: F.struct(
        F.lit(city).alias("city"), F.lit(region).alias("region"), F.lit(country).alias("country"), F.lit(raw).alias("raw")
    )
    places = F.array(place("Madrid", "", "es", "Madrid, es"), place("Gent", "r" * 130, "be", "x" * 250), place("Gent", "r" * 140, "BE", "late"))
    sent = d.postings.filter("id % 3 = 0").select(F.col("id").alias("posting_id"), places.alias("places"))
    return m.sync_places(d.places, sent)


def ingest(d: Domain) -> m.IngestResult:
    return m.ingest_batch(d.stored, d.places.join(d.stored.select(F.col("id").alias("posting_id")), "posting_id", "left_semi"), d.incoming, seen(), new_id=spark_id())


@query(
    "ingest_batch",
    f"""WITH {WITH_KEYS}, matches AS ({MATCHES}), merged AS ({MERGED}), fresh AS ({FRESH})
    SELECT id, {_VALUES}, {_TOUCHED} FROM merged
    UNION ALL SELECT pos, title, department, salary_max, content_hash, {SEEN}, {SEEN}, NULL FROM fresh""",
)
def ingest_batch(d: Domain) -> DataFrame:
    return ingest(d).postings.select("id", *_COLUMNS)


@query(
    "ingest_counts",
    f"""WITH {WITH_KEYS}, matches AS ({MATCHES}), merged AS ({MERGED}), fresh AS ({FRESH})
    SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM res) AS total, (SELECT count(*) FROM fresh) + (SELECT count(*) FROM merged WHERE changed) AS changed""",
)
def ingest_counts(d: Domain) -> DataFrame:
    r = ingest(d)
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    return one(r.inserted, "inserted").join(one(d.incoming, "total"), "k").join(one(r.changed, "changed"), "k").drop("k")


# --- entities -------------------------------------------------------------------------


def keyed(d: Domain) -> DataFrame:
    key = m.dedup_key(F.col("title"), F.col("places"), F.col("location"))
    return d.with_place_lists(d.postings.drop("dedup_key")).withColumn("dedup_key", key).select(*d.postings.columns)


COLLAPSE = "SELECT id, first_value(id) OVER (PARTITION BY company_id, dedup_key ORDER BY created_at, id) AS canonical_id FROM keyed"


@query("collapse_duplicates", f"SELECT id, canonical_id FROM ({COLLAPSE}) WHERE id = canonical_id")
def collapse_duplicates(d: Domain) -> DataFrame:
    return e.collapse_duplicates(keyed(d), ["company_id", "dedup_key"]).select("id", F.col("id").alias("canonical_id"))


@query("collapse_mapping", f"SELECT id AS dup_id, canonical_id FROM ({COLLAPSE}) WHERE id <> canonical_id")
def collapse_mapping(d: Domain) -> DataFrame:
    return e.collapse_mapping(keyed(d), ["company_id", "dedup_key"])


_RANK = "CASE status WHEN 'APPLIED' THEN 0 WHEN 'DISMISSED' THEN 1 WHEN 'SEEN' THEN 2 ELSE 3 END"


@query(
    "repoint_interactions",
    f"""WITH c AS ({COLLAPSE}), mv AS (SELECT i.*, c.canonical_id FROM interaction i JOIN c ON c.id = i.posting_id WHERE c.id <> c.canonical_id),
    best AS (SELECT * FROM mv QUALIFY row_number() OVER (PARTITION BY user_id, canonical_id ORDER BY {_RANK}, application_id NULLS LAST, saved DESC, posting_id) = 1),
    stay AS (SELECT i.* FROM interaction i LEFT JOIN c ON c.id = i.posting_id WHERE c.id IS NULL OR c.id = c.canonical_id)
    SELECT user_id, posting_id, status, saved, application_id FROM stay
    UNION ALL SELECT user_id, canonical_id, status, saved, application_id FROM best b WHERE NOT EXISTS (SELECT 1 FROM stay s WHERE s.user_id = b.user_id AND s.posting_id = b.canonical_id)""",
)
def repoint_interactions(d: Domain) -> DataFrame:
    mapping = e.collapse_mapping(keyed(d), ["company_id", "dedup_key"])
    return e.repoint_interactions(d.interactions, mapping).select("user_id", "posting_id", "status", "saved", "application_id")


# Companies with an upper-case twin, younger than the original; every other posting of id % 10 = 0 companies sits at the twin.
TWINS = """SELECT * FROM company UNION ALL SELECT id + 1000000, ' ' || upper(name), industry, country, status, 'https://jobs.ashbyhq.com/twin' || id,
  'https://twin' || id || '.example.org', true, created_at + INTERVAL 1 DAY FROM company WHERE id % 10 = 0"""
MOVED = "SELECT * REPLACE (CASE WHEN company_id % 10 = 0 AND id % 2 = 0 THEN company_id + 1000000 ELSE company_id END AS company_id) FROM keyed"
FOLLOWED = """SELECT user_id, company_id + CASE WHEN company_id % 10 = 0 AND user_id % 2 = 0 THEN 1000000 ELSE 0 END AS company_id FROM watch
  UNION SELECT user_id, company_id + 1000000 FROM watch WHERE company_id % 10 = 0 AND user_id % 3 = 0"""


def twin_tables(d: Domain):
    c = d.companies
    text = F.col("id").cast("string")
    twins = c.filter("id % 10 = 0").select(
        (F.col("id") + 1000000).alias("id"), F.concat(F.lit(" "), F.upper("name")).alias("name"), "industry", "country", "status",
        F.concat(F.lit("https://jobs.ashbyhq.com/twin"), text).alias("careers_url"),
        F.concat(F.lit("https://twin"), text, F.lit(".example.org")).alias("website"), F.lit(True).alias("is_monitored"),
        (F.col("created_at") + F.make_dt_interval(F.lit(1))).alias("created_at"),
    )
    moved = lambda cond: F.col("company_id") + F.when((F.col("company_id") % 10 == 0) & cond, 1000000).otherwise(0)
    posts = keyed(d).withColumn("company_id", moved(F.col("id") % 2 == 0))
    w = d.watches
    follows = (
        w.withColumn("company_id", moved(F.col("user_id") % 2 == 0))
        .unionByName(w.filter("company_id % 10 = 0 AND user_id % 3 = 0").withColumn("company_id", F.col("company_id") + 1000000))
        .dropDuplicates(["user_id", "company_id"])
    )
    apps = d.applications.withColumn("company_id", moved(F.col("id") % 2 == 0))
    return c.unionByName(twins), posts, apps, follows


def merged_companies(d: Domain) -> e.Merged:
    companies, posts, apps, follows = twin_tables(d)
    return e.merge_companies(companies, posts, d.interactions, apps, follows)


_PASS = lambda src, key, cond="true": f"SELECT id, target, dedup_key, url, external_id, created_at FROM (SELECT *, CASE WHEN {cond} THEN row_number() OVER (PARTITION BY target, {key} ORDER BY created_at, id) ELSE 1 END AS rn FROM {src}) WHERE rn = 1"
_PASSES = f"""t0 AS (SELECT id, company_id % 1000000 AS target, dedup_key, url, external_id, created_at FROM ({MOVED})),
  t1 AS ({_PASS('t0', 'dedup_key')}), t2 AS ({_PASS('t1', 'url')}), t3 AS ({_PASS('t2', 'external_id', 'external_id IS NOT NULL')})"""


@query("merge_companies", f"WITH {_PASSES} SELECT id, target AS company_id FROM t3")
def merge_companies(d: Domain) -> DataFrame:
    return merged_companies(d).postings.select("id", "company_id")


@query(
    "merge_companies_survivors",
    f"""WITH twins AS ({TWINS}) SELECT id, name, coalesce(careers_url, CASE WHEN id % 10 = 0 THEN 'https://jobs.ashbyhq.com/twin' || id END) AS careers_url,
    coalesce(website, CASE WHEN id % 10 = 0 THEN 'https://twin' || id || '.example.org' END) AS website, is_monitored OR id % 10 = 0 AS is_monitored FROM twins WHERE id < 1000000""",
)
def merge_companies_survivors(d: Domain) -> DataFrame:
    return merged_companies(d).companies.select("id", "name", "careers_url", "website", "is_monitored")


@query("merge_companies_watches", f"SELECT DISTINCT user_id, company_id % 1000000 AS company_id FROM ({FOLLOWED})")
def merge_companies_watches(d: Domain) -> DataFrame:
    return merged_companies(d).watches.select("user_id", "company_id")


@query("backfill_dedup_key", f"""SELECT p.id, {fold('p.title')} || '|' || {fold("coalesce(f.city, split_part(p.location, ',', 1), '')")} AS dedup_key FROM posting p
  LEFT JOIN (SELECT posting_id, min_by(city, id) AS city FROM place GROUP BY 1) f ON f.posting_id = p.id""")
def backfill_dedup_key(d: Domain) -> DataFrame:
    return e.backfill_dedup_key(d.postings, d.places).select("id", "dedup_key")


ENTRIES = """SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN 'board-' || s_suppkey ELSE upper(s_name) END AS name, 'https://jobs.lever.co/seed' || s_suppkey AS careers_url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'https://seed' || s_suppkey || '.example.com' END AS website FROM supplier"""


@query(
    "seed_companies",
    f"""WITH entries AS ({ENTRIES}), n AS (SELECT *, CASE WHEN name = lower(name) THEN upper(substr(name, 1, 1)) || substr(name, 2) ELSE name END AS nm FROM entries),
    j AS (SELECT n.*, c.id, c.name AS old, c.careers_url AS old_careers, c.website AS old_site, c.status AS old_status, c.is_monitored AS old_mon,
      c.name = lower(c.name) AND c.name <> n.nm AS renamed, c.careers_url IS NOT NULL AS keeps FROM n LEFT JOIN company c ON lower(trim(c.name)) = lower(trim(n.nm)))
    SELECT nm AS entry, CASE WHEN id IS NULL OR renamed THEN nm ELSE old END AS name, CASE WHEN id IS NOT NULL AND keeps THEN old_careers ELSE careers_url END AS careers_url,
      coalesce(old_status, 'APPROVED') AS status, CASE WHEN id IS NOT NULL AND keeps THEN old_mon ELSE true END AS is_monitored,
      CASE WHEN id IS NULL THEN 'created' WHEN keeps AND NOT renamed THEN 'unchanged' ELSE 'updated' END AS outcome FROM j""",
)
def seed_companies(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    text = k.cast("string")
    entries = d.raw("supplier").select(
        k.alias("pos"),
        F.when(k % 3 == 0, F.concat(F.lit("board-"), text)).otherwise(F.upper("s_name")).alias("name"),
        F.concat(F.lit("https://jobs.lever.co/seed"), text).alias("careers_url"),
        F.when(k % 2 == 0, F.concat(F.lit("https://seed"), text, F.lit(".example.com"))).alias("website"),
    )
    out = e.seed_companies(d.companies, entries)
    entry = F.when(F.col("outcome") == "created", F.col("name")).otherwise(F.upper("name"))
    return out.select(entry.alias("entry"), "name", "careers_url", "status", "is_monitored", "outcome")


@query(
    "find_or_create_company",
    """WITH asked AS (SELECT DISTINCT ON (lower(trim(n))) trim(n) AS name FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN ' supplier#' || lpad(CAST(c_custkey % 500 AS VARCHAR), 9, '0') || ' ' ELSE c_name END AS n FROM customer) ORDER BY lower(trim(n)), trim(n))
    SELECT coalesce(c.name, a.name) AS name, c.id IS NULL AS created FROM asked a LEFT JOIN company c ON lower(trim(c.name)) = lower(a.name)""",
)
def find_or_create_company(d: Domain) -> DataFrame:
    k = F.col("c_custkey")
    names = d.raw("customer").select(
        F.when(k % 2 == 0, F.concat(F.lit(" supplier#"), F.lpad((k % 500).cast("string"), 9, "0"), F.lit(" "))).otherwise(F.col("c_name")).alias("name")
    )
    return e.find_or_create_company(d.companies, names).select("name", "created")


@query("capitalise_seeded", "SELECT id, CASE WHEN status = 'APPROVED' AND is_monitored AND name = lower(name) THEN upper(substr(name, 1, 1)) || substr(name, 2) ELSE name END AS name FROM company")
def capitalise_seeded(d: Domain) -> DataFrame:
    return e.capitalise_seeded(d.companies).select("id", "name")


# Changes per application from the event log: clicks move a card, errors delete it.
CHANGES = """SELECT event_id % 20000 AS id, event_id, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
  CASE event_type WHEN 'click' THEN 'INTERVIEW' WHEN 'purchase' THEN 'OFFER' END AS status FROM events"""


def changes(d: Domain) -> DataFrame:
    kind = F.col("event_type")
    return d.raw("events").select(
        (F.col("event_id") % 20000).alias("id"), F.col("ts").alias("at"),
        F.when(kind == "error", "delete").otherwise("upsert").alias("op"),
        F.when(kind == "click", "INTERVIEW").when(kind == "purchase", "OFFER").alias("status"),
    )


@query(
    "apply_changes",
    f"""WITH c AS (SELECT * FROM ({CHANGES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)
    SELECT coalesce(a.id, c.id) AS id, CASE WHEN c.op = 'delete' THEN a.status ELSE coalesce(c.status, a.status) END AS status,
      CASE WHEN c.op = 'delete' THEN c.ts ELSE a.deleted_at END AS deleted_at FROM application a FULL JOIN c ON c.id = a.id WHERE a.id IS NOT NULL OR c.op <> 'delete'""",
)
def apply_changes(d: Domain) -> DataFrame:
    return e.apply_changes(d.applications, changes(d), ["id"], soft_delete="deleted_at").select("id", "status", "deleted_at")


@query(
    "follow_unfollow",
    """WITH c AS (SELECT user_id, event_id % 100 AS company_id, max_by(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END, ts) AS op FROM events GROUP BY 1, 2)
    SELECT coalesce(w.user_id, c.user_id) AS user_id, coalesce(w.company_id, c.company_id) AS company_id FROM watch w FULL JOIN c ON c.user_id = w.user_id AND c.company_id = w.company_id WHERE c.op IS DISTINCT FROM 'delete'""",
)
def follow_unfollow(d: Domain) -> DataFrame:
    c = d.raw("events").select(
        "user_id", (F.col("event_id") % 100).alias("company_id"), F.col("ts").alias("at"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
    )
    return e.apply_changes(d.watches, c, ["user_id", "company_id"]).select("user_id", "company_id")


@query("remove_companies", "SELECT id FROM application WHERE company_id NOT IN (SELECT id FROM company WHERE status = 'REJECTED')")
def remove_companies(d: Domain) -> DataFrame:
    gone = d.companies.filter("status = 'REJECTED'")
    return e.remove_companies(d.companies, d.applications, gone)[1].select("id")


# --- interactions ---------------------------------------------------------------------



@query(
    "upsert_interaction",
    """WITH p AS (SELECT user_id, posting_id + shift AS posting_id, max_by(st, t) FILTER (WHERE st IS NOT NULL) AS st, max_by(sv, t) FILTER (WHERE sv IS NOT NULL) AS sv,
      max(t) FILTER (WHERE sv IS NOT NULL) AS sat FROM (
        SELECT i.user_id, i.posting_id, unnest([0, 1]) AS shift, CASE WHEN i.status = 'SEEN' THEN 'DISMISSED' END AS st, i.status = 'DISMISSED' AS sv, i.created_at AS t FROM interaction i)
      GROUP BY 1, 2), known AS (SELECT p.* FROM p WHERE posting_id IN (SELECT id FROM posting))
    SELECT coalesce(i.user_id, p.user_id) AS user_id, coalesce(i.posting_id, p.posting_id) AS posting_id, coalesce(p.st, i.status, 'SEEN') AS status, coalesce(p.sv, i.saved, false) AS saved,
      CASE WHEN p.sv THEN p.sat WHEN NOT p.sv THEN NULL ELSE i.saved_at END AS saved_at FROM interaction i FULL JOIN known p ON p.user_id = i.user_id AND p.posting_id = i.posting_id""",
)
def upsert_interaction(d: Domain) -> DataFrame:
    i = d.interactions
    patches = i.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "user_id", (F.col("posting_id") + F.col("shift")).alias("posting_id"),
        F.when(F.col("status") == "SEEN", "DISMISSED").alias("status"),
        (F.col("status") == "DISMISSED").alias("saved"),
        F.lit(None).cast("bigint").alias("application_id"), F.col("created_at").alias("at"),
    )
    return ev.upsert_interaction(i, patches, d.postings).select("user_id", "posting_id", "status", "saved", "saved_at")


def tracked(d: Domain):
    requests = d.interactions.select(
        "user_id", "posting_id",
        F.when(F.col("posting_id") % 2 == 0, "APPLIED").otherwise("WISHLIST").alias("status"),
        at(EVENTS_AT).alias("at"),
    )
    new_id = F.col("posting_id") * 1000 + F.col("user_id")
    return ev.track_as_application(requests, d.interactions, d.postings, d.applications, new_id)


LINKED = "SELECT i.user_id, i.posting_id FROM interaction i JOIN application a ON a.id = i.application_id"
TRACKED = f"""SELECT i.user_id, i.posting_id, i.posting_id * 1000 + i.user_id AS id, p.title AS position, p.company_id, p.location, p.salary_max, i.posting_id % 2 = 0 AS sent
  FROM interaction i JOIN posting p ON p.id = i.posting_id WHERE NOT EXISTS (SELECT 1 FROM ({LINKED}) l WHERE l.user_id = i.user_id AND l.posting_id = i.posting_id)"""


@query(
    "track_as_application",
    f"""SELECT id, user_id, position, company_id, CASE WHEN sent THEN 'APPLIED' ELSE 'WISHLIST' END AS status, 'Location: ' || location AS notes,
    CASE WHEN sent THEN TIMESTAMP '{EVENTS_AT}' END AS applied_at FROM ({TRACKED})""",
)
def track_as_application(d: Domain) -> DataFrame:
    return tracked(d)[0].select("id", "user_id", "position", "company_id", "status", "notes", "applied_at")


@query(
    "track_as_application_events",
    f"SELECT application_id, type FROM (SELECT id AS application_id, unnest(CASE WHEN sent THEN ['APPLICATION_CREATED', 'APPLICATION_SENT'] ELSE ['APPLICATION_CREATED'] END) AS type FROM ({TRACKED}))",
)
def track_as_application_events(d: Domain) -> DataFrame:
    return tracked(d)[2].select("application_id", "type")
