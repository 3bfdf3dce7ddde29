"""Registry of the queries that run on the given tables, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL it must agree with."""
    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def text(col: str | Column) -> Column:
    """Dates leave the queries as ISO text, so that both engines print them alike."""
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def rounded(col: str | Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    value = F.round(F.col(col) if isinstance(col, str) else col, places)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def sql_rounded(expr: str, places: int = 6) -> str:
    return f"(CASE WHEN round({expr}, {places}) = 0 THEN 0.0 ELSE round({expr}, {places}) END)"


def sql_month(day: str) -> str:
    return f"CAST((year({day}) - 1960) * 12 + month({day}) - 1 AS INTEGER)"


def sql_quarter(day: str) -> str:
    return f"CAST((year({day}) - 1960) * 4 + quarter({day}) - 1 AS INTEGER)"


# Code sets over the part numbers of the test tables. They overlap.
PART_SETS = {"lowest": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], "evens": [2, 8, 34, 144, 610],
             "middle": [(900, 1100)], "mixed": [13, (50, 60), (1900, 1950)]}
PART_SETS_SQL = {
    "lowest": "{c} IN (1,2,3,5,8,13,21,34,55,89)", "evens": "{c} IN (2,8,34,144,610)",
    "middle": "{c} BETWEEN 900 AND 1100",
    "mixed": "({c} = 13 OR {c} BETWEEN 50 AND 60 OR {c} BETWEEN 1900 AND 1950)"}
