"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weft.plans.views import Views, oracle

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Views` under ``name`` or its own, with DuckDB SQL for the same rows."""

    def put(fn: Callable[[Views], DataFrame]):
        def run(spark, sf_dir):
            return fn(Views(spark, sf_dir))

        QUERIES[name or fn.__name__] = run
        if sql:
            ORACLE_SQL[name or fn.__name__] = oracle(sql) if not sql.startswith("WITH RECURSIVE v_") else sql
        return fn

    return put
