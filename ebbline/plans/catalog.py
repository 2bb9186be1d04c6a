"""Where queries register themselves, with their DuckDB SQL beside them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = ""):
    """Registers a query. `dates` names its date columns: both engines give them as yyyy-MM-dd text."""
    names = dates.split()

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in names}) if names else df

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'strftime(CAST("{c}" AS DATE), {chr(39)}%Y-%m-%d{chr(39)}) AS "{c}"' for c in names)}) FROM ({sql})" if names else sql
        return f

    return register
