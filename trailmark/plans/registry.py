"""Where query modules enter their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.plans.fixture_sql import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: dict[str, str] | None = None) -> Callable[[Query], Query]:
    """Enter a query under its function's name; sql may name fixture views and the given views."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_fixtures(sql, views)
        return f

    return enter
