"""Query registry: each entry is a Spark callable and, where SQL can state it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicmill.plans.standins import DUCK, Tables, VIEWS, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(views: str, body: str) -> str:
    """Prefix ``body`` with the stand-in tables it names."""
    parts = [f"{name} AS ({view_sql(name, DUCK)})" for name in views.split()]
    body = body.strip()
    if not parts:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def query(name: str, views: str = "", sql: str | None = None):
    assert all(v in VIEWS for v in views.split()), (name, views)

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return wrap
