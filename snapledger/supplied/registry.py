"""Queries over the supplied tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.supplied.tables import Tables


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    """Register a function of the tables under its own name."""

    def register(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return register


def shown(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and dates as text, so both engines report the same types."""
    casts = {"date": "string", "int": "bigint"}
    return df.select(*[F.col(n).cast(casts[t]).alias(n) if t in casts else F.col(n) for n, t in df.dtypes])


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return shown(QUERIES[name].run(Tables(spark, folder)))
