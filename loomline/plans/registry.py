"""Names of the registered queries, with their DataFrame functions and DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.sources.tables import Tables, with_views

#: Every equipment with the names of where it stands.
PLACES = """(SELECT equipments.id_equipment, nm_equipment, nm_area, nm_site, nm_enterprise FROM equipments JOIN areas USING (id_area)
    JOIN sites ON sites.id_site = equipments.id_site JOIN enterprises ON enterprises.id_enterprise = equipments.id_enterprise) AS places"""
WHERE_IT_STANDS = "nm_enterprise, nm_site, nm_area, nm_equipment"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Registers build over the tables of a directory; sql says the same over the views."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, path: build(Tables(spark, path))
    if sql is not None:
        SQL[name] = with_views(sql)


def add_stream(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Registers a query that runs a stream to its end and returns what it wrote."""
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = with_views(sql)


def _load() -> None:
    from loomline.plans import configuration, events, ingest, joins, kpis, logs, orders, series, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
