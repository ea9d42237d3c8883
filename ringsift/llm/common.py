"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsift.session import materialise

#: Cells per group when rows are numbered (four hexadecimal digits); a cell is what one task sorts.
CELLS = 1 << 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    return materialise(df, label)


def spread(df: DataFrame, *names: str) -> DataFrame:
    """Deal rows by key to as many tasks as the session names, for work that weighs more than its bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)


def cell(key: Column) -> Column:
    """One of ``CELLS`` hash cells, as four hexadecimal digits; null reads as the empty text."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 4)


def named(group: Column) -> Column:
    """A group's value as text that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(df: DataFrame, group: str, key: str, into: str, tie: str | None = None) -> DataFrame:
    """Give the rows of each group numbers 0, 1, 2, ... without a gap.

    Rows are dealt by (group, hash cell of ``key``), counted per cell, and numbered inside the cell;
    the counts of earlier cells are added. One task never holds a whole group, however large it is.
    ``group`` is never null. Order: hash cell, then key, null first, then ``tie``; what is equal in all comes in any order.
    """
    dealt = df.withColumn("_cell", cell(F.col(key)))
    counts = dealt.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_cell").orderBy(F.col(key).asc_nulls_first(), *([tie] if tie else []))
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, [group, "_cell"])
    return joined.withColumn(into, (F.col("_start") + F.col("_rank")).cast("bigint")).drop("_cell", "_rank", "_start")
