"""Numeric and date helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(c: Column | str) -> Column:
    """Into [0, 1]; NaN and infinities become 0, null stays null."""
    c = col(c).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def clip(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    """Text to double; a decimal comma is accepted, anything else gives the default."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), ",", ".")
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def safe_int(c: Column | str, default: int = 0) -> Column:
    """Text to bigint, truncating; NaN, infinities and junk give the default."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), ",", ".")
    number = text.try_cast("double")
    usable = F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number)
    return F.coalesce(usable.cast("bigint"), F.lit(default).cast("bigint"))


def round_even(c: Column, digits: int = 0) -> Column:
    """Half-even rounding."""
    return F.bround(c, digits)


def round_count(c: Column) -> Column:
    """Half-even rounding to a row count."""
    return F.bround(c, 0).cast("bigint")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def log_share(c: Column, top: float) -> Column:
    """log1p(x) / log1p(top), clamped."""
    return clamp01(F.log1p(c.cast("double")) / F.log1p(F.lit(float(top))))


def sigmoid(z: Column) -> Column:
    """Stable for large positive and negative arguments."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def dot(values: Column, weights: Column) -> Column:
    """Sum of products of two double arrays, left to right."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def parse_date(c: Column | str) -> Column:
    """Four fixed formats, then ISO 8601, as wall-clock time; null when none fits."""
    text = F.trim(col(c))
    shapes = [
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2}$", "d.M.yyyy H:m"),
    ]
    fixed = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))) for shape, fmt in shapes
    ]
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text.try_cast("timestamp")
    )
    return F.coalesce(*fixed, iso).cast("timestamp_ntz")


def wall_ms(ts: Column) -> Column:
    """Milliseconds from 1970 to a wall-clock time, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def review_velocity(last: Column, first: Column, reviews: Column, window_days: int) -> Column:
    """Reviews per day of age (at least one day), per window, clamped."""
    elapsed = F.timestamp_diff("SECOND", parse_date(first), parse_date(last))

    def rate(seconds: Column) -> Column:
        age = F.greatest(seconds / 86400.0, F.lit(1.0))
        value = clamp01((reviews / age) / float(max(window_days, 1)))
        return F.when(seconds.isNotNull() & (reviews > 0), value).otherwise(F.lit(0.0))

    return let(elapsed, rate)


def night_flag(ms: Column, utc_offset: Column | int = 0) -> Column:
    """22:00-08:00 local time."""
    hour = F.pmod(F.floor((ms + F.lit(utc_offset) * 3600000) / 3600000), F.lit(24))
    return (hour >= 22) | (hour < 8)


def weekend_flag(ms: Column, utc_offset: Column | int = 0) -> Column:
    """Saturday or Sunday local time; day 0 of the epoch was a Thursday."""
    day = F.pmod(F.floor((ms + F.lit(utc_offset) * 3600000) / 86400000), F.lit(7))
    return day.isin(2, 3)
