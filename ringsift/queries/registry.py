"""Registration of queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = [
    "scalars", "sources", "projections", "joins", "aggregates", "windows", "evaluation", "decisions", "features",
    "events", "streams", "pages", "models",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"ringsift.queries.{name}")


def _tidy(df: DataFrame, places: int) -> DataFrame:
    """Whole numbers as bigint, decimals as double, doubles at a fixed number of places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), places) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, doubles: str = "", ints: str = "", places: int = 6):
    """Register ``fn(tables) -> DataFrame`` and its twin.

    ``doubles`` and ``ints`` name columns of the twin that are rounded, or cast to bigint, in the
    same way as the Spark result.
    """

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: _tidy(fn(Tables(spark, folder)), places)
        if sql is not None:
            body = with_views(sql)
            swaps = [f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in doubles.split()]
            swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({body}) q" if swaps else body
        return fn

    return register
