"""Named queries over the bound tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from entityflow.plans.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, types: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the named views as tables.

    ``types`` names the SQL types of result columns that SQL would give another width.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            text = with_views(views, sql)
            if types:
                casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
                text = f"SELECT * REPLACE ({casts}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return register
