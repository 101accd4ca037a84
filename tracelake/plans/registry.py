"""Queries and SQL of the reference's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, bigint: str = "") -> Callable:
    """Registers a function of ``Tables`` under its name, with the SQL it must agree with.

    ``bigint`` names columns that DuckDB sums in a wider type than Spark's long.
    """
    if bigint:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in bigint.split())}) FROM ({sql})"

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


from tracelake.plans import compare, curation, gates, grading, ordered, resampled, rollups, selection, sourced, statistics, streams, traces, validators  # noqa: E402, F401
