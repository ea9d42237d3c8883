"""Data-quality checks; every check returns issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import phone


def phone_column_profile(df: DataFrame, number: str) -> DataFrame:
    """One row: rows, invalid numbers, distinct numbers that occur more than once."""
    per = df.groupBy(F.coalesce(F.col(number), F.lit("")).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.sum("c").alias("rows"),
        F.sum(F.when(~phone.is_valid("n"), F.col("c")).otherwise(0)).alias("invalid_rows"),
        F.count_if((F.col("n") != "") & (F.col("c") > 1)).alias("duplicated_numbers"),
    )


def invalid_numbers(df: DataFrame, number: str, limit: int = 30) -> DataFrame:
    """The first invalid numbers in order, for a report."""
    bad = df.filter(~phone.is_valid(number)).select(F.coalesce(F.col(number), F.lit("")).alias("number"))
    return bad.groupBy("number").agg(F.count(F.lit(1)).alias("rows")).orderBy("number").limit(limit)


def duplicated_numbers(df: DataFrame, number: str, limit: int = 20) -> DataFrame:
    """The most frequent numbers that occur more than once, for a report."""
    per = df.groupBy(F.col(number).alias("number")).agg(F.count(F.lit(1)).alias("rows"))
    return per.filter(F.col("rows") > 1).orderBy(F.desc("rows"), "number").limit(limit)


def header_issues(columns: list[str], wanted: list[str]) -> list[str]:
    """Columns that are missing, then columns nobody asked for."""
    return [f"missing:{c}" for c in wanted if c not in columns] + [
        f"unexpected:{c}" for c in columns if c not in wanted
    ]


def first_order_mismatch(left: list[str], right: list[str]) -> tuple[int, str | None, str | None] | None:
    """Position and names of the first difference between two ordered name lists."""
    for i in range(max(len(left), len(right))):
        a = left[i] if i < len(left) else None
        b = right[i] if i < len(right) else None
        if a != b:
            return i, a, b
    return None


def order_mismatches(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Positions at which two (position, name) tables differ; a missing side is null."""
    a = left.select("position", F.col(name).alias("left_name"))
    b = right.select("position", F.col(name).alias("right_name"))
    return a.join(b, "position", "full_outer").filter(~F.col("left_name").eqNullSafe(F.col("right_name")))


def feature_table_profile(df: DataFrame, features: list[str], label: str, classes: list) -> DataFrame:
    """One pass over a feature table: values outside [0, 1], NaN or missing, and bad labels."""
    tests: list[Column] = []
    for c in features:
        v = F.col(c)
        tests.append(F.count_if((v < 0) | (v > 1)).alias(f"{c}__range"))
        tests.append(F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}__missing"))
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(F.col(label).isin(classes), F.lit(False))).alias("bad_label"),
        *tests,
    )
    rows = [F.struct(F.lit("*").alias("column_name"), F.lit("bad_label").alias("issue"), F.col("bad_label").alias("rows_hit"))]
    for c in features:
        for kind in ("range", "missing"):
            rows.append(
                F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("issue"), F.col(f"{c}__{kind}").alias("rows_hit"))
            )
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter(F.col("rows_hit") > 0)


def class_share_issues(df: DataFrame, label: str, classes: list, floor: float = 0.05) -> DataFrame:
    """Classes that are missing or hold less than the floor."""
    parts = [
        F.struct(F.lit(c).alias("class"), F.count_if(F.col(label) == c).alias("rows_found"))
        for c in classes
    ]
    counted = df.agg(F.array(*parts).alias("p"), F.count(F.lit(1)).alias("n"))
    rows = counted.select(F.explode("p").alias("p"), "n").select("p.*", (F.col("p.rows_found") / F.greatest("n", F.lit(1))).alias("share"))
    return rows.filter(F.col("share") < floor)


def feed_issues(df: DataFrame, number: str, counts: list[str], order: str) -> DataFrame:
    """Issue rows of one feed: empty, invalid and duplicate numbers, counts that are no integers."""
    base = df.withColumn("_n", F.coalesce(F.col(number), F.lit("")))

    def issues(part: DataFrame, kind: str) -> DataFrame:
        return part.select(F.lit(kind).alias("issue"), F.col(order).alias("row_order"), F.col("_n").alias("value"))

    bad_count = None
    for c in counts:
        test = (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") & F.col(c).cast("string").try_cast("bigint").isNull()
        bad_count = test if bad_count is None else bad_count | test
    first = base.filter("_n <> ''").groupBy("_n").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_c"))
    again = base.join(first.filter("_c > 1"), "_n").filter(F.col(order) > F.col("_first"))
    return (
        issues(base.filter("_n = ''"), "empty_number")
        .unionByName(issues(base.filter((F.col("_n") != "") & ~phone.is_national("_n")), "invalid_number"))
        .unionByName(issues(again, "duplicate_number"))
        .unionByName(issues(base.filter(bad_count if bad_count is not None else F.lit(False)), "bad_count"))
    )


def label_issues(df: DataFrame, label: str) -> DataFrame:
    """Unknown labels with their row counts."""
    return (
        df.filter(~F.coalesce(F.col(label).isin(S.LABELS), F.lit(False)))
        .groupBy(F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def list_conflicts(allow: DataFrame, black: DataFrame, number: str = "normalized_number") -> DataFrame:
    """Numbers that are on both lists."""
    return allow.select(number).join(black.select(number).distinct(), number, "left_semi").distinct()


def placeholder_split(df: DataFrame, name: str, number: str, words: list[str]) -> DataFrame:
    """Add ``quarantined``: a placeholder name or a number that is not national."""
    low = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    return df.withColumn("quarantined", low.isin([w.lower() for w in words]) | ~phone.is_national(number))
