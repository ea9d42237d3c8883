"""Smoothed risk tables by prefix, code and operator.

Every table comes from one aggregate over the labelled rows. The groups are prefixes of canonical
numbers, so partial aggregation shrinks hot prefixes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import phone
from ..functions.numeric import round_even
from ..functions.once import settle


#: Canonical numbers are cut here before they are counted: +7 and seven digits.
FOLD_CHARS = 9


def _labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isin(S.LABELS))


def folded(df: DataFrame, operators: bool = True) -> DataFrame:
    """Counts per (prefix of nine characters, operator bucket): all that the tables below need.

    The rows are read and shuffled once. They are counted by the operator as written, so that
    partial aggregation shrinks hot prefixes first and the bucket is found for a few distinct
    names instead of for every row. Column number keeps its meaning, so the result can be given
    to every function of this module in place of the rows.
    """
    keys = [F.substring("number", 1, FOLD_CHARS).alias("number")]
    if operators:
        keys.append(F.col("operator"))
    counts = _labelled(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == "BLOCK").alias("n_block"),
        F.count_if(F.col("label") == "WARN").alias("n_warn"),
    )
    if not operators:
        return counts
    sums = [F.sum(c).alias(c) for c in ("n", "n_block", "n_warn")]
    return settle(counts, {"bucket": phone.operator_bucket("operator")}).groupBy("number", "bucket").agg(*sums)


def _counts(df: DataFrame, operators: bool = False) -> DataFrame:
    return df if "n_block" in df.columns else folded(df, operators)


def _national() -> Column:
    """+7 and digits only, so a prefix of k characters has at most 10^(k - 2) values."""
    return F.col("number").rlike(r"^\+7[0-9]*$")


def label_totals(df: DataFrame) -> DataFrame:
    """One row: labelled rows and the overall block and warn rates."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return _counts(df).agg(
        n.alias("source_rows"),
        (F.coalesce(F.sum("n_block"), F.lit(0)) / F.greatest(n, F.lit(1))).alias("block_rate"),
        (F.coalesce(F.sum("n_warn"), F.lit(0)) / F.greatest(n, F.lit(1))).alias("warn_rate"),
    )


def rates(df: DataFrame) -> Column:
    """The overall rates as one struct, found by a scalar subquery that runs once."""
    return label_totals(df).select(F.struct("block_rate", "warn_rate")).scalar()


def smoothed(hits: Column, total: Column, prior: Column, alpha: float) -> Column:
    """(hits + alpha * prior) / (total + alpha), clamped, four places."""
    share = (hits + F.lit(alpha) * prior) / (total + F.lit(alpha))
    return round_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4)


def label_entropy(*counts: Column) -> Column:
    """Entropy of three label counts over log2(3), four places."""
    total = sum(counts[1:], counts[0]).cast("double")
    out = F.lit(0.0)
    for c in counts:
        p = c / total
        out = out + F.when(c > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), out / F.log2(F.lit(3.0))))
    return F.when(total > 0, round_even(share, 4)).otherwise(F.lit(0.0))


def entropy_of_shares(block: Column, warn: Column) -> Column:
    """Entropy over log2(3) when only two shares are known."""
    b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), block))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), warn))
    a = F.greatest(F.lit(0.0), 1.0 - b - w)
    total = a + b + w
    out = F.lit(0.0)
    for part in (b, w, a):
        p = part / total
        out = out + F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), out / F.log2(F.lit(3.0))))).otherwise(
        F.lit(0.0)
    )


def _risk(df: DataFrame, keys: dict[str, Column], alpha: float, min_samples: int) -> DataFrame:
    """Smoothed block share per group, pulled towards the overall block rate."""
    counts = _counts(df)
    # The keys are found for the few counted prefixes; a filter on them must not go back to the rows.
    keyed = settle(counts.filter(_national()), {f"_{k}": c for k, c in keys.items()})
    per = keyed.groupBy(*[F.col(f"_{k}").alias(k) for k in keys]).agg(
        F.sum("n").alias("seen_count"), F.sum("n_block").alias("block_count")
    )
    per = per.filter(F.col("seen_count") >= min_samples)
    for k in keys:
        per = per.filter(F.col(k).isNotNull() & (F.col(k) != ""))
    return per.select(
        *keys,
        smoothed(F.col("block_count"), F.col("seen_count"), rates(counts)["block_rate"], alpha).alias("risk"),
        "seen_count",
    )


def prefix_risk(df: DataFrame, length: int = 6, alpha: float = 10.0, min_samples: int = 3) -> DataFrame:
    """Risk per prefix; input columns number, label."""
    return _risk(df, {"prefix": F.substring("number", 1, length)}, alpha, min_samples)


def code_risk(df: DataFrame, alpha: float = 20.0, min_samples: int = 5) -> DataFrame:
    """Risk per three-digit code."""
    return _risk(df, {"def_code": phone.def_code_text("number")}, alpha, min_samples)


def operator_code_risk(df: DataFrame, alpha: float = 20.0, min_samples: int = 5) -> DataFrame:
    """Risk per operator bucket and code from one pass; input columns number, label, operator.

    The prior counts every labelled row, the groups only rows with a known operator.
    """
    return _risk(
        _counts(df, True),
        {
            "bucket": F.when(F.col("bucket") != "unknown", F.col("bucket")),
            "def_code": phone.def_code_text("number"),
        },
        alpha,
        min_samples,
    )


def operator_by_number(metadata: DataFrame, order: str) -> DataFrame:
    """Operator bucket of a number: the last row in ``order`` with a known operator wins."""
    named = metadata.filter(F.col("number").startswith("+7") & (F.trim("operator") != ""))
    latest = named.groupBy("number").agg(F.max_by("operator", F.col(order)).alias("operator"))
    return settle(latest, {"bucket": phone.operator_bucket("operator")}).drop("operator")


def operator_code_risk_joined(
    labels: DataFrame, metadata: DataFrame, order: str, alpha: float = 20.0, min_samples: int = 5
) -> DataFrame:
    """Same table when labels and operators come from two tables."""
    national = _labelled(labels).filter(F.col("number").startswith("+7"))
    # Labels are folded per number first, so a hot number is one row in the join.
    per_number = national.groupBy("number").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "BLOCK").alias("b")
    )
    joined = per_number.join(operator_by_number(metadata, order), "number")
    per = (
        settle(joined, {"def_code": phone.def_code_text("number")})
        .groupBy("bucket", "def_code")
        .agg(F.sum("n").alias("seen_count"), F.sum("b").alias("block_count"))
        .filter((F.col("seen_count") >= min_samples) & (F.col("def_code") != ""))
    )
    return per.select(
        "bucket",
        "def_code",
        smoothed(F.col("block_count"), F.col("seen_count"), rates(labels)["block_rate"], alpha).alias("risk"),
        "seen_count",
    )


def operator_bucket_by_code(df: DataFrame, min_samples: int = 3, min_share: float = 0.5) -> DataFrame:
    """Most common operator bucket per code when it holds the majority; ties go to the first name."""
    known = _counts(df, True).filter(_national() & (F.col("bucket") != "unknown"))
    coded = settle(known, {"def_code": phone.def_code_text("number")})
    per = coded.groupBy("def_code", "bucket").agg(F.sum("n").alias("n"))
    top = (
        per.filter(F.col("def_code") != "")
        .groupBy("def_code")
        .agg(
            F.sum("n").alias("total"),
            F.min(F.struct((-F.col("n")).alias("neg"), "bucket")).alias("top"),
        )
    )
    count = -F.col("top.neg")
    return top.filter((F.col("total") >= min_samples) & (count / F.col("total") >= min_share)).select(
        "def_code", F.col("top.bucket").alias("bucket"), "total", count.alias("bucket_count")
    )


def prefix_histogram(
    df: DataFrame, lengths: tuple[int, ...] = (5, 6, 9), alpha: float = 10.0, min_samples: int = 3
) -> DataFrame:
    """Block and warn shares, seen count and entropy per prefix, for several lengths at once, all
    rolled up from one set of counts."""
    if max(lengths) > FOLD_CHARS:
        raise ValueError(f"prefixes are counted up to {FOLD_CHARS} characters")
    counts = _counts(df)
    levels = F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]))
    per = (
        counts.filter(_national())
        .select("*", levels.alias("prefix_length"))
        .groupBy("prefix_length", F.expr("substring(number, 1, prefix_length)").alias("prefix"))
        .agg(F.sum("n").alias("seen_count"), F.sum("n_block").alias("b"), F.sum("n_warn").alias("w"))
        .filter(F.col("seen_count") >= min_samples)
    )
    n, b, w = F.col("seen_count"), F.col("b"), F.col("w")
    overall = rates(counts)
    return per.select(
        "prefix_length",
        "prefix",
        smoothed(b, n, overall["block_rate"], alpha).alias("block_share"),
        smoothed(w, n, overall["warn_rate"], alpha).alias("warn_share"),
        "seen_count",
        label_entropy(n - b - w, b, w).alias("entropy"),
    )


def histogram_header(df: DataFrame, histogram: DataFrame, saturation: float = 30.0) -> DataFrame:
    """One row per prefix length: overall rates, log of the largest count, sample saturation."""
    top = histogram.groupBy("prefix_length").agg(
        round_even(F.log1p(F.max("seen_count").cast("double")), 4).alias("seen_log_norm"),
        F.count(F.lit(1)).alias("prefixes"),
    )
    totals = label_totals(df).select(
        F.struct(
            "source_rows",
            round_even(F.col("block_rate"), 4).alias("overall_block_rate"),
            round_even(F.col("warn_rate"), 4).alias("overall_warn_rate"),
        )
    ).scalar()
    return (
        top.withColumn("_t", totals)
        .select("prefix_length", "seen_log_norm", "prefixes", "_t.*")
        .withColumn("sample_size_saturation", F.lit(saturation))
    )


def quantise(histogram: DataFrame, length: int = 9) -> DataFrame:
    """Shares as 0..255 (half even), counts capped at 2^32 - 1, keys as integers, sorted."""

    def byte(c: str) -> Column:
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255).cast("bigint")

    good = histogram.filter(F.col("prefix").rlike(rf"^\+7[0-9]{{{length - 2}}}$") & (F.col("seen_count") >= 0))
    return good.select(
        F.substring("prefix", 3, length - 2).cast("bigint").alias("prefix_key"),
        byte("block_share").alias("block_q"),
        byte("warn_share").alias("warn_q"),
        byte("entropy").alias("entropy_q"),
        F.least(F.col("seen_count").cast("bigint"), F.lit(4_294_967_295)).alias("seen"),
    ).orderBy("prefix_key")


#: Operators that codes are known by.
_NAMED = sorted(b for b in S.OPERATOR_BUCKETS if b != "unknown")


def prefix_levels(df: DataFrame, alpha: float = 10.0, min_samples: int = 3, code_alpha: float = 20.0,
                  code_samples: int = 5) -> DataFrame:
    """All that is known about a number's first six characters, in one row: its own counts, those of its
    five characters, of its code, and of every operator under the code.

    ``key`` is a prefix of six characters, or a bare code for numbers without one. Every code that was
    seen has its ten prefixes whether they were seen or not, so one equi join finds every level. At
    most 11,000 rows and the few shorter numbers.
    """
    counts = _counts(df, True)
    overall = rates(counts)
    national = settle(counts.filter(_national()), {"code": phone.def_code_text("number"), "key": F.substring("number", 1, 6)})
    sums = {"n": F.sum("n"), "b": F.sum("n_block"), "w": F.sum("n_warn")}
    own = national.filter(F.col("code") != "").groupBy("code", "key").agg(
        *[v.alias(k) for k, v in sums.items()],
        *[F.sum(F.when(F.col("bucket") == o, F.col(c)).otherwise(0)).alias(f"{k}_{o}") for o in _NAMED for k, c in (("n", "n"), ("b", "n_block"))],
    )
    empty = F.array(*[F.concat(F.lit("+7"), "code", F.lit(str(i))) for i in range(10)], F.col("code"))
    zeros = own.select("code").distinct().select("code", F.explode(empty).alias("key"))
    rows = own.unionByName(zeros, allowMissingColumns=True).na.fill(0).groupBy("code", "key").agg(*[F.sum(c).alias(c) for c in own.columns[2:]])
    code = Window.partitionBy("code")

    def risk(b: Column, n: Column, a: float, least: int) -> Column:
        return F.when(n >= least, smoothed(b, n, overall["block_rate"], a))

    five = F.substring("key", 1, 5) == F.concat(F.lit("+7"), "code")
    inside = F.when(five, F.col("n")).otherwise(0), F.when(five, F.col("b")).otherwise(0)
    totals = rows.select(
        "*", F.sum(inside[0]).over(code).alias("n5"), F.sum(inside[1]).over(code).alias("b5"),
        *[F.sum(c).over(code).alias(f"c_{c}") for c in own.columns[2:]],
    )
    n, b, w = F.col("n"), F.col("b"), F.col("w")
    whole = F.length("key") == 6
    known = sum((F.col(f"c_n_{o}") for o in _NAMED[1:]), F.col(f"c_n_{_NAMED[0]}"))
    most = F.greatest(*[F.col(f"c_n_{o}") for o in _NAMED])
    top = F.coalesce(*[F.when(F.col(f"c_n_{o}") == most, F.lit(o)) for o in _NAMED])
    return totals.select(
        "key",
        F.when(whole & (n >= min_samples), F.struct(
            smoothed(b, n, overall["block_rate"], alpha).alias("block_share"), smoothed(w, n, overall["warn_rate"], alpha).alias("warn_share"),
            label_entropy(n - b - w, b, w).alias("entropy"), n.alias("seen_count"))).alias("six"),
        risk(F.col("b5"), F.col("n5"), alpha, min_samples).alias("five"),
        risk(F.col("c_b"), F.col("c_n"), code_alpha, code_samples).alias("code"),
        F.when((known >= 3) & (most / known >= 0.5), top).alias("bucket"),
        F.create_map(*[x for o in _NAMED for x in (F.lit(o), risk(F.col(f"c_b_{o}"), F.col(f"c_n_{o}"), code_alpha, code_samples))]).alias("operators"),
    )
