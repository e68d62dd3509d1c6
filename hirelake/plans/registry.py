"""Named queries over the derived tables, each with the SQL it must agree with (where SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hirelake.plans.domain import Domain
from hirelake.plans.views import sql as with_views

_QUERIES: dict[str, tuple[Callable[[Domain], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Domain], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (build, sql)
        return build

    return add


def _load() -> None:
    from hirelake.plans import q_board, q_crawl, q_cycle, q_dashboard, q_events, q_listings, q_merge, q_normalise, q_overview, q_profiles  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Naive times in the tables are UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Domain(spark, folder))

        return run

    return {name: bind(build) for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(text) for name, (_, text) in _QUERIES.items() if text}
