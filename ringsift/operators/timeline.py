"""Running values and look-back windows that do not put a whole key into one task.

A key is cut into buckets of its order column. Every bucket is first summed up on its own; the
sums of the earlier buckets are carried in; only the rows of one bucket are then sorted together.
Sums, maxima and minima found this way equal those of one window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    folds: dict[str, tuple[str, Column]],
    bucket: Column,
    inclusive: bool = False,
) -> DataFrame:
    """Add one column per fold: its value over all rows of the key that come earlier.

    ``folds`` maps a name to (``sum`` | ``max`` | ``min``, value). ``bucket`` must not decrease
    when ``order`` grows. With ``inclusive`` rows of equal order count too.
    """
    cells = df.withColumn("_b", bucket)
    for name, (_, value) in folds.items():
        cells = cells.withColumn(f"_v_{name}", value)
    per = cells.groupBy(*keys, "_b").agg(
        *[_FOLD[kind](f"_v_{name}").alias(f"_c_{name}") for name, (kind, _) in folds.items()]
    )
    # One row per key and bucket: bounded by the number of buckets, not by the rows.
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(
        *keys,
        "_b",
        *[
            _FOLD[kind](f"_c_{name}").over(earlier).alias(f"_c_{name}")
            for name, (kind, _) in folds.items()
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy(order)
        .rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = cells.join(carry, [*keys, "_b"])
    for name, (kind, _) in folds.items():
        out = out.withColumn(
            name, _merge(kind, F.col(f"_c_{name}"), _FOLD[kind](f"_v_{name}").over(inside))
        )
    helpers = ["_b"] + [f"_{p}_{n}" for n in folds for p in ("c", "v")]
    return out.drop(*helpers)


def _union_timeline(
    targets: DataFrame, target_id: str, events: DataFrame, keys: list[str], ts: str, values: list[str]
) -> DataFrame:
    asks = targets.select(*keys, ts, F.col(target_id).alias("_id"), *[F.lit(None).alias(v) for v in values])
    facts = events.select(*keys, ts, F.lit(None).alias("_id"), *values)
    return facts.unionByName(asks).dropna(subset=keys)


def latest_before(
    targets: DataFrame,
    target_id: str,
    events: DataFrame,
    keys: list[str],
    ts: str,
    values: dict[str, Column],
    inclusive: bool = False,
    width: int = DAY_MS,
    following: bool = False,
    attach: bool = True,
) -> DataFrame:
    """For every target row the greatest of each value among earlier events of its key.

    ``values`` usually are ``when(test, ts)``, so the result is the time of the latest such
    event. With ``following`` the smallest value among later events is found instead.
    Adds the value columns to ``targets``; null when there is no such event. Without ``attach``
    only the id and the values come back, so that several look-backs can share their targets.
    """
    names = list(values)
    facts = events.select(*keys, ts, *[v.alias(n) for n, v in values.items()])
    line = _union_timeline(targets, target_id, facts, keys, ts, names)
    order, kind = ("_o", "min") if following else ("_o", "max")
    line = line.withColumn("_o", -F.col(ts) if following else F.col(ts))
    out = running(
        line,
        keys,
        order,
        {f"_r_{n}": (kind, F.col(n)) for n in names},
        F.floor(F.col("_o") / width),
        inclusive,
    )
    found = out.filter(F.col("_id").isNotNull()).select(
        F.col("_id").alias(target_id), *[F.col(f"_r_{n}").alias(n) for n in names]
    )
    return targets.join(found, target_id, "left") if attach else found


def lookback_sums(
    targets: DataFrame,
    target_id: str,
    events: DataFrame,
    keys: list[str],
    ts: str,
    sums: dict[str, tuple[Column, int]],
    width: int = HOUR_MS,
    attach: bool = True,
) -> DataFrame:
    """For every target row sums of event values with ``t - window <= event < t``.

    ``sums`` maps a name to (value, window in the unit of ``ts``). A sum over a window is the
    running sum at its end less the running sum at its start, so each target asks once per
    distinct window and no pair of target and event is ever formed.
    """
    names = list(sums)
    windows = sorted({w for _, w in sums.values()})
    facts = events.select(*keys, ts, *[v.cast("double").alias(n) for n, (v, _) in sums.items()])
    starts = targets.select(
        *keys,
        F.col(target_id),
        F.explode(F.array(*[F.lit(w).cast("bigint") for w in [0, *windows]])).alias("_w"),
        F.col(ts),
    ).withColumn(ts, F.col(ts) - F.col("_w"))
    asks = starts.select(
        *keys, ts, F.col(target_id).alias("_id"), "_w", *[F.lit(None).cast("double").alias(n) for n in names]
    )
    line = (
        facts.select(*keys, ts, F.lit(None).alias("_id"), F.lit(None).cast("bigint").alias("_w"), *names)
        .unionByName(asks)
        .dropna(subset=keys)
    )
    out = running(
        line, keys, ts, {f"_r_{n}": ("sum", F.col(n)) for n in names}, F.floor(F.col(ts) / width)
    )
    found = (
        out.filter(F.col("_id").isNotNull())
        .groupBy(F.col("_id").alias(target_id))
        .agg(
            *[
                (
                    F.sum(F.when(F.col("_w") == 0, F.col(f"_r_{n}")))
                    - F.sum(F.when(F.col("_w") == w, F.col(f"_r_{n}")))
                ).alias(n)
                for n, (_, w) in sums.items()
            ]
        )
    )
    return targets.join(found, target_id, "left").fillna(0.0, subset=names) if attach else found
