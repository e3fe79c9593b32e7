"""All registered queries of the library, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import captures, catalogue, catalogue_sql, product, product_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = catalogue.QUERIES | product.QUERIES | captures.QUERIES
SQL: dict[str, str] = catalogue_sql.SQL | product_sql.SQL | captures.SQL
