"""The derived tables of `domain.py` as SQL, one CTE each, for the side-by-side check."""

from __future__ import annotations

import re

from hirelake.plans.domain import PLACES, POSTINGS_AT, ROLES


def q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def pick(c: str, values, default=None) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"CASE {c} {whens} ELSE {q(default)} END"


def fold(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


_TITLE = f"CASE WHEN p.l_partkey % 8 = 7 THEN p_name ELSE {pick('p.l_partkey % 8', [r[0] for r in ROLES])} || ' ' || p_brand END"
_STATUS = ["WISHLIST", "APPLIED", "INTERVIEW", "OFFER", "REJECTED", "GHOSTED", "NOT_ELIGIBLE"]
_FIRST_PLACE = " ".join(
    f"WHEN {n} THEN {{'city': {q(c)}, 'region': {q(r)}, 'country': {q(k)}, 'raw': {q(label)}}}"
    for n, (c, r, k, label) in enumerate(PLACES)
)


def _wish(n: int, *values: str) -> str:
    return f"CASE WHEN k % {n} = 0 AND k % 11 <> 0 THEN [{', '.join(map(q, values))}] ELSE [] END"


VIEWS = {
    "company": f"""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN lower(s_name) ELSE s_name END AS name,
  {pick('s_suppkey % 5', ['SOFTWARE', 'AI', 'BANKING', 'RETAIL'])} AS industry, n_name AS country,
  CASE WHEN s_acctbal < 0 THEN 'REJECTED' WHEN s_acctbal < 500 THEN 'PENDING' ELSE 'APPROVED' END AS status,
  CASE WHEN s_suppkey % 3 = 0 THEN 'https://Jobs.Lever.co/team' || (s_suppkey // 2) || '/'
       WHEN s_suppkey % 3 = 2 THEN 'https://boards.greenhouse.io/supplier' || s_suppkey END AS careers_url,
  CASE WHEN s_suppkey % 7 <> 0 THEN 'https://www.supplier' || s_suppkey || '.example.com/' END AS website,
  s_suppkey % 2 = 0 AS is_monitored,
  TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey % 97 AS INTEGER)) AS created_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "posting": f"""
SELECT id, company_id, title, 'https://jobs.example.com/c' || company_id || '/p' || pk AS url,
  CASE WHEN id % 3 <> 0 THEN 'X' || id END AS external_id, description, CAST(NULL AS VARCHAR) AS description_html,
  {pick('id % 6', [x[3] for x in PLACES])} AS location,
  CASE WHEN pk % 11 <> 0 THEN p_type END AS department,
  {pick('pk % 8', [r[1] for r in ROLES])} AS domain, {pick('pk % 8', [r[2] for r in ROLES])} AS seniority,
  {pick('pk % 5', ['FULL_TIME', 'INTERNSHIP', 'CONTRACT', 'PART_TIME'])} AS employment_type,
  {pick('(pk + company_id) % 4', ['REMOTE', 'HYBRID', 'ON_SITE'])} AS remote_type,
  CASE WHEN pk % 6 <> 0 THEN CAST(floor(p_retailprice * 40) AS INTEGER) END AS salary_min,
  CASE WHEN pk % 7 <> 0 THEN CAST(floor(p_retailprice * 55) AS INTEGER) END AS salary_max,
  {pick('pk % 3', ['EUR', 'USD'])} AS salary_currency,
  'https://jobs.example.com/c' || company_id AS source,
  CASE WHEN pk % 13 <> 0 THEN first_seen END AS posted_at,
  CASE WHEN pk % 2 = 0 THEN last_seen + INTERVAL 90 DAY END AS valid_through,
  last_seen AS last_seen_at,
  CASE WHEN last_seen < TIMESTAMP '1998-01-01' THEN last_seen END AS closed_at,
  CASE WHEN last_seen < TIMESTAMP '1998-01-01' THEN 'EXPIRED' END AS closed_reason,
  CASE WHEN id % 3 = 1 THEN last_seen END AS last_validated_at,
  first_seen AS created_at, last_seen AS updated_at
FROM (SELECT p.l_partkey * 100000 + p.l_suppkey AS id, p.l_suppkey AS company_id, p.l_partkey AS pk,
        {_TITLE} AS title, d.text AS description, p_type, p_retailprice, first_seen, last_seen
      FROM (SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen
            FROM lineitem GROUP BY 1, 2) p
      JOIN part ON p.l_partkey = p_partkey LEFT JOIN documents d ON d.doc_id = p.l_partkey)""",
    "posting_places": f"""
SELECT id, list_filter([CASE id % 6 {_FIRST_PLACE} END,
  CASE WHEN id % 7 = 0 THEN {{'city': 'Madrid', 'region': '', 'country': 'ES', 'raw': 'Madrid'}} END], lambda x: x IS NOT NULL) AS places
FROM posting""",
    "place": """
SELECT id * 10 + i - 1 AS id, id AS posting_id, places[i].city AS city, places[i].region AS region,
  places[i].country AS country, places[i].raw AS raw
FROM (SELECT id, places, unnest(range(1, len(places) + 1)) AS i FROM posting_places)""",
    "application": f"""
SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey % 10 AS company_id,
  {pick('o_orderkey % 7', [r[0] for r in ROLES])} || ' ' || o_orderpriority AS position,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 50 END AS kanban_order,
  {pick('o_orderkey % 5', ['Paris', 'paris', 'Lyon', ''])} AS city, {pick('o_orderkey % 5', ['FR', 'fr', 'FR', 'DE'])} AS country,
  CAST(floor(o_totalprice) AS INTEGER) AS salary_min, {pick('o_orderkey % 7', _STATUS)} AS status,
  {pick("CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1", ['S_TIER', 'A_TIER', 'B_TIER'], 'NONE')} AS tier,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS applied_at, o_orderdate AS created_at,
  o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS updated_at,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate END AS deleted_at
FROM orders""",
    "interaction": """
SELECT user_id, posting_id,
  CASE event_type WHEN 'purchase' THEN 'APPLIED' WHEN 'error' THEN 'DISMISSED' ELSE 'SEEN' END AS status,
  event_type = 'signup' AS saved, CASE WHEN event_type = 'signup' THEN ts END AS saved_at,
  CASE WHEN event_type = 'purchase' THEN event_id END AS application_id, ts AS created_at, ts + INTERVAL 1 DAY AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, posting_id ORDER BY event_id) AS rn
      FROM events JOIN (SELECT l_orderkey, min(l_partkey * 100000 + l_suppkey) AS posting_id FROM lineitem GROUP BY 1)
        ON event_id = l_orderkey) WHERE rn = 1""",
    "watch": """
SELECT user_id, company_id, CASE WHEN user_id % 9 = 0 THEN 'https://jobs.ashbyhq.com/c' || company_id END AS careers_url,
  CAST(NULL AS VARCHAR) AS website, CASE WHEN user_id % 2 = 0 THEN 'follow' END AS notes
FROM (SELECT DISTINCT user_id, posting_id % 100000 AS company_id FROM interaction WHERE status = 'SEEN')""",
    "users": """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 19 <> 0 THEN lower(c_name) || '@example.com' END AS email,
  CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer""",
    "preference": f"""
SELECT k AS user_id, {_wish(2, 'BACKEND', 'DATA')} AS domains, {_wish(5, 'SENIOR', 'LEAD')} AS seniorities,
  {_wish(3, 'FULL_TIME', 'CONTRACT')} AS employment_types, {_wish(4, 'REMOTE', 'HYBRID')} AS remote_types,
  {_wish(7, 'DE', 'ES')} AS countries, {_wish(6, 'paris', 'madrid')} AS cities, {_wish(8, 'engineer')} AS titles,
  {_wish(9, 'les', 'que', 'und')} AS keywords, {_wish(13, 'engineer')} AS required_keywords,
  {_wish(10, 'AI', 'BANKING')} AS industries, {_wish(14, 'the', 'of')} AS motivations, {_wish(15, 'eau', 'sch')} AS resume_keywords,
  {_wish(12, 'manager')} AS excluded_keywords,
  CASE WHEN k % 16 = 0 AND k % 11 <> 0 THEN [k % 10] ELSE [] END AS excluded_company_ids,
  CASE WHEN k % 3 = 1 AND k % 11 <> 0 THEN 45000 END AS min_salary, CASE WHEN k % 6 = 1 THEN 'EUR' END AS wish_currency,
  CASE WHEN k % 4 = 3 AND k % 11 <> 0 THEN 60 END AS max_age_days, k % 21 = 0 AS open_to_relocation,
  CASE WHEN k % 4 = 0 THEN 2.0 ELSE 1.0 END AS w_domain, CASE WHEN k % 4 = 0 THEN 0.5 ELSE 1.0 END AS w_salary,
  CASE WHEN k % 4 = 1 THEN 0.0 ELSE 1.0 END AS w_location, CASE WHEN k % 4 = 1 THEN 2.0 ELSE 1.0 END AS w_remote,
  k % 5 <> 4 AS notify_matches, CASE WHEN k % 3 = 2 THEN TIMESTAMP '{POSTINGS_AT}' - INTERVAL 40 DAY END AS last_notified_at
FROM (SELECT c_custkey AS k FROM customer)""",
    "job_event": """
SELECT event_id, CASE event_type WHEN 'view' THEN 'POSTING_VIEWED' WHEN 'click' THEN 'FOLLOW_UP_SENT'
    WHEN 'purchase' THEN 'APPLICATION_SENT' WHEN 'signup' THEN 'APPLICATION_CREATED' WHEN 'error' THEN 'REJECTION_RECEIVED' END AS type,
  ts AS occurred_at, ts AS created_at, user_id, user_id * 10 + event_id % 7 AS application_id, props AS payload FROM events""",
    "keyed": f"""
SELECT p.*, pp.places, {fold('p.title')} || '|' || {fold("coalesce(list_filter(pp.places, lambda x: x.city <> '')[1].city, split_part(p.location, ',', 1), '')")} AS dedup_key
FROM posting p JOIN posting_places pp USING (id)""",
    "hashed": """
SELECT *, sha256(array_to_string(list_concat([coalesce(title, ''), coalesce(external_id, ''), coalesce(description, ''), '', coalesce(location, ''),
  coalesce(department, ''), coalesce(domain, ''), coalesce(seniority, ''), coalesce(employment_type, ''), coalesce(remote_type, ''),
  coalesce(CAST(salary_min AS VARCHAR), ''), coalesce(CAST(salary_max AS VARCHAR), ''), coalesce(salary_currency, ''), coalesce(source, ''),
  coalesce(CAST(posted_at AS VARCHAR), ''), coalesce(CAST(valid_through AS VARCHAR), '')],
  list_sort(list_transform(places, lambda x: x.city || '~' || x.region || '~' || x.country || '~' || x.raw))), chr(0))) AS content_hash
FROM keyed""",
    "stored": """
SELECT * REPLACE (CASE WHEN id % 4 <> 0 THEN content_hash END AS content_hash) FROM hashed WHERE id % 10 < 8
QUALIFY row_number() OVER (PARTITION BY company_id, dedup_key ORDER BY created_at, id) = 1""",
}


def sql(body: str) -> str:
    """`body` with every derived table it names (and those they name) put in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                need(view)
                needed.append(name)

    need(body)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = body.strip()
    if not needed:
        return body
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"{lead}{ctes},\n{body[len(lead):]}"
    return f"WITH {ctes}\n{body}"
