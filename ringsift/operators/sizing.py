"""Look-up joins and derived tables; nothing here depends on a count of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

def write_once(df: DataFrame, label: str) -> DataFrame:
    """A derived look-up table, written once and read back."""
    return materialise(df, label)


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 32
) -> DataFrame:
    """Equi join that spreads every key of ``big`` over ``salts`` partitions.

    ``small`` must be unique on ``on``; its rows are repeated once per salt.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support {how!r}")
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a unique-key look-up table without a hint.

    Spark broadcasts it by its bytes, known or measured while running; else adaptive execution splits
    skewed keys. Where a key is known to be hot, ``salted_join`` spreads it whatever the settings.
    """
    return big.join(table, on, how)
