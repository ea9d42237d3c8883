"""Values that are computed a single time although several expressions use them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value bound to a lambda variable."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def settle(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections use by name only.

    A generator with one row stands between, so the optimizer does not put the expressions
    themselves wherever their names occur.
    """
    keep = [c for c in df.columns if c not in cols]
    row = F.struct(*[v.alias(k) for k, v in cols.items()])
    return df.select(*keep, F.inline(F.array(row)))
