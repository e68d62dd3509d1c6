"""The whole home page of one viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators import dashboard as b
from hirelake.plans import q_board, q_dashboard
from hirelake.plans.domain import Domain
from hirelake.plans.q_dashboard import _SINCE, _STALE, _TIER, DAYS, FUNNEL, NOW, PER_DAY, STREAK, as_of, live
from hirelake.plans.registry import query

USER = q_board.USER
SCORE = q_board.SCORE.replace(q_board.NOW, NOW)
_MINE = f"(SELECT * FROM {q_dashboard.LIVE} WHERE user_id = {USER})"
_DAY = "strftime(coalesce(posted_at, created_at), '%Y-%m-%d')"
_APPLICATION = "a.id || ':' || a.position || ':' || coalesce(c.name, '') || ':' || a.days_since"


def _applications(where: str, order: str) -> str:
    rows = f"SELECT id, position, company_id, {_SINCE}, row_number() OVER (ORDER BY {order}) AS k FROM {_MINE} WHERE {where}"
    return f"SELECT coalesce(string_agg({_APPLICATION}, '|' ORDER BY a.k), '') FROM ({rows}) a LEFT JOIN company c ON c.id = a.company_id WHERE a.k <= 5"


def _offers(where: str, order: str, shown: str) -> str:
    rows = f"SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM offers WHERE {where}"
    return f"SELECT coalesce(string_agg({shown}, '|' ORDER BY k), '') FROM ({rows}) WHERE k <= 5"


_STRONG = "score >= 70 AND status IN ('NEW', 'SEEN')"
_NEWEST = "coalesce(posted_at, created_at) DESC, id"
SQL = f"""WITH frame AS ({q_board.FRAME}),
offers AS (SELECT *, {SCORE} AS score FROM frame WHERE closed_at IS NULL AND application_id IS NULL),
per_day AS ({PER_DAY}),
numbers AS (SELECT f.*, s.streak_days FROM ({FUNNEL}) f JOIN ({STREAK}) s USING (user_id) WHERE user_id = {USER})
SELECT CAST({USER} AS BIGINT) AS user_id, {', '.join(f'coalesce(n.{c.lower()}, 0) AS {c.lower()}' for c in b.COUNTED)},
  coalesce(n.total_applications, 0) AS total_applications, coalesce(n.stale_applied, 0) AS stale_applied,
  coalesce(n.applied_this_week, 0) AS applied_this_week, coalesce(n.applied_last_week, 0) AS applied_last_week,
  CAST(coalesce(n.streak_days, 0) AS BIGINT) AS streak_days,
  CAST(floor(n.answered / nullif(n.ever_sent, 0)::DOUBLE * 100 + 0.5) AS BIGINT) AS response_rate,
  (SELECT count(*) FROM offers WHERE {_STRONG}) AS strong_matches, (SELECT count(*) FROM offers WHERE saved) AS saved_undecided,
  true AS has_profile, CAST({q_board.MIXED.completeness} AS BIGINT) AS profile_completeness,
  (SELECT string_agg(c.date || '=' || coalesce(p.sent, 0), ',' ORDER BY c.date) FROM ({DAYS}) c
    LEFT JOIN per_day p ON p.date = c.date AND p.user_id = {USER}) AS activity,
  ({_offers(_STRONG, f"score DESC, {_NEWEST}", "id || ':' || title || ':' || company_name || ':' || CAST(score AS BIGINT)")}) AS top_matches,
  ({_offers("saved", _NEWEST, f"id || ':' || title || ':' || company_name || ':' || {_DAY}")}) AS saved_offers,
  ({_applications("status = 'WISHLIST'", f"{_TIER}, created_at, id")}) AS wishlist_applications,
  ({_applications(_STALE, "applied_at, id")}) AS stale_applications
FROM (SELECT 1) LEFT JOIN numbers n ON true"""


@query("viewer_overview", SQL)
def viewer_overview(d: Domain) -> DataFrame:
    """The lists as text, since they are compared by value."""
    page = b.viewer_overview(live(d), d.companies, q_board.frame(d), q_board.VIEWER, as_of())

    def text(rows: str, *shown) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *[F.coalesce(f(r).cast("string"), F.lit("")) for f in shown])), "|").alias(rows)

    of = lambda name: lambda r: r[name]
    application = [of("id"), of("position"), of("company_name"), of("days_since")]
    return page.select(
        *[c for c in page.columns if c not in ("activity", "top_matches", "saved_offers", "wishlist_applications", "stale_applications")],
        F.array_join(F.transform("activity", lambda a: F.concat_ws("=", a["date"], a["sent"].cast("string"))), ",").alias("activity"),
        text("top_matches", of("id"), of("title"), of("company_name"), of("match_score")),
        text("saved_offers", of("id"), of("title"), of("company_name"), lambda r: F.date_format(r["listed_at"], "yyyy-MM-dd")),
        text("wishlist_applications", *application),
        text("stale_applications", *application),
    )
