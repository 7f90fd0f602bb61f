"""All queries of the core by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import library, study

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**library.Q, **study.Q}
ORACLE: dict[str, str] = {**library.SQL, **study.SQL}
