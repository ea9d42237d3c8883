"""Phone-number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .numeric import clamp01, col, contains_any


def digits(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def normalize(raw: Column | str, reject_foreign: bool = True) -> Column:
    """Canonical ``+7`` form, ``+digits`` for foreign numbers if wanted, else null."""
    text = F.trim(col(raw))
    d = digits(text)
    n = F.length(d)
    first = F.substring(d, 1, 1)
    foreign = F.lit(None).cast("string") if reject_foreign else F.concat(F.lit("+"), d)
    return (
        F.when(d.isin(S.EMERGENCY_CODES), F.concat(F.lit("+7"), d))
        .when((n == 11) & first.isin("7", "8"), F.concat(F.lit("+7"), F.substring(d, 2, 10)))
        .when((n == 10) & first.isin("9", "3", "4", "8"), F.concat(F.lit("+7"), d))
        .when(
            text.startswith("+") & (n >= 11),
            F.when(first == "7", F.concat(F.lit("+7"), F.substring(d, 2, 10))).otherwise(foreign),
        )
    )


def normalize_block_key(raw: Column | str) -> Column:
    """Looser rule for block-list keys: a leading + keeps all digits, seven or more will do."""
    text = F.trim(col(raw))
    d = digits(text)
    n = F.length(d)
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(text.startswith("+"), F.concat(F.lit("+"), d))
        .when((n == 11) & d.rlike("^[78]"), F.concat(F.lit("+7"), F.substring(d, 2, 10)))
        .when(n == 10, F.concat(F.lit("+7"), d))
        .when(n >= 7, F.concat(F.lit("+"), d))
    )


def normalize_device(raw: Column | str) -> Column:
    """Junk guard, short codes kept as they are, then the canonical rule."""
    text = F.trim(col(raw))
    d = digits(text)
    n = F.length(d)
    usable = (F.length(text) <= 20) & text.rlike(r"^[+0-9 ()\-.]+$") & n.between(2, 15)
    return F.when(usable, F.when(n <= 6, d).otherwise(normalize(text, reject_foreign=False)))


def registry_operator(raw: Column | str) -> Column:
    """Registry operator name -> short display name."""
    text = F.trim(F.coalesce(col(raw), F.lit("")))
    upper = F.upper(text)
    bare = F.regexp_replace(text, r"^(ПАО|ООО|АО|ЗАО|ОАО)\s+", "")
    out = None
    for words, name in S.REGISTRY_OPERATORS:
        test = contains_any(upper, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.trim(F.regexp_replace(bare, "^[\"']+|[\"']+$", "")))


def registry_region(raw: Column | str) -> Column:
    """Registry region -> short display name."""
    text = F.trim(F.split_part(F.coalesce(col(raw), F.lit("")), F.lit("|"), F.lit(1)))
    text = F.trim(F.split_part(text, F.lit("*"), F.lit(1)))
    text = F.regexp_replace(text, r"^г\.\s+", "")
    for old, new in S.REGION_REWRITES:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(F.trim(text), r"\s+обл\.\s*$", " обл.")
    return F.trim(F.regexp_replace(text, r"\.{2,}", "."))


def national_part(n: Column | str) -> Column:
    """What follows +7; null for anything else."""
    c = col(n)
    return F.when(c.startswith("+7"), F.substring(c, 3, 30))


def def_code(n: Column | str) -> Column:
    """Three digits after +7 as a number, else null."""
    return F.substring(national_part(n), 1, 3).try_cast("int")


def def_code_text(n: Column | str) -> Column:
    """Three digits after a leading 7 or 8, else the first three digits, else ''."""
    d = digits(n)
    return (
        F.when((F.length(d) >= 4) & F.substring(d, 1, 1).isin("7", "8"), F.substring(d, 2, 3))
        .when(F.length(d) >= 3, F.substring(d, 1, 3))
        .otherwise(F.lit(""))
    )


# Every class is one regular expression over the canonical form, so a test refers to its column once
# and stays small when it is pushed below a projection.
_MOBILE = "9[0-9]{2}"
_LANDLINE = "|".join(str(c) for c in S.LANDLINE_CODES)
_TOLLFREE = "|".join(str(c) for c in S.TOLLFREE_CODES)
_EMERGENCY = "|".join(S.EMERGENCY_CODES)
_NATIONAL = rf"\+7(?:(?:{_EMERGENCY})$|{_MOBILE}|{_LANDLINE}|{_TOLLFREE})"
_PLACEHOLDER = r"\+7.+0{6}$"


def _matches(n: Column | str, pattern: str) -> Column:
    return F.coalesce(col(n).rlike("^" + pattern), F.lit(False))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_mobile(n: Column | str) -> Column:
    return _matches(n, rf"\+7{_MOBILE}")


def is_landline(n: Column | str) -> Column:
    return _matches(n, rf"\+7(?:{_LANDLINE})")


def is_tollfree(n: Column | str) -> Column:
    return _matches(n, rf"\+7(?:{_TOLLFREE})")


def is_short_code(n: Column | str) -> Column:
    return _matches(n, r"\+7[0-9]{1,4}$")


def is_national(n: Column | str) -> Column:
    return _matches(n, _NATIONAL)


def is_placeholder(n: Column | str) -> Column:
    """A code followed by six or more zeros."""
    return _matches(n, _PLACEHOLDER)


def is_valid(n: Column | str) -> Column:
    return _matches(n, rf"(?!{_PLACEHOLDER}){_NATIONAL}")


def is_foreign(n: Column | str) -> Column:
    return _matches(n, r"\+(?!7)")


def is_plausible(n: Column | str) -> Column:
    """A full national number that is not a filler."""
    fillers = "|".join(S.FAKE_NATIONAL_DIGITS)
    return _matches(n, rf"(?=.{{12}}$)(?!\+7(?:(\d)\1+|{fillers})$){_NATIONAL}")


def number_type(n: Column | str) -> Column:
    c = col(n)
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when(is_short_code(c), "short")
        .when(is_tollfree(c), "tollfree")
        .when(is_mobile(c), "mobile")
        .when(is_landline(c), "landline")
        .when(c.startswith("+7"), "ru_other")
        .otherwise("foreign")
    )


def spoofed_prefix(raw: Column, normalized: Column) -> Column:
    """A foreign code dressed up as a capital-city code."""
    text = F.regexp_replace(
        F.trim(F.coalesce(F.nullif(raw, F.lit("")), normalized, F.lit(""))), r"[ \-()]", ""
    )
    d = digits(text)
    return _flag(
        (text.startswith("+84") & d.startswith("8495"))
        | (text.startswith("0084") & d.startswith("008495"))
        | (normalized.startswith("+84") & digits(normalized).startswith("8495"))
    )


def digit_entropy(d: Column) -> Column:
    """Shannon entropy of the digits over log2(10)."""
    n = F.length(d).cast("double")
    total = F.lit(0.0)
    for digit in "0123456789":
        share = (n - F.length(F.replace(d, F.lit(digit), F.lit("")))) / n
        total = total + F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))
    return F.when(F.length(d) > 0, total / F.log2(F.lit(10.0))).otherwise(F.lit(0.0))


def _runs(d: Column) -> Column:
    return F.regexp_extract_all(d, F.lit(r"((\d)\2*)"), F.lit(1))


def repeat_ratio(d: Column) -> Column:
    """Share of neighbours that repeat: every run of length k holds k - 1 of them."""
    n = F.length(d)
    return F.when(n > 1, (n - F.size(_runs(d))) / (n - 1)).otherwise(F.lit(0.0))


def max_run(d: Column) -> Column:
    """Longest run of one digit over the length."""
    n = F.length(d)
    longest = F.array_max(F.transform(_runs(d), lambda r: F.length(r)))
    return F.when(n > 0, F.least(longest / n, F.lit(1.0))).otherwise(F.lit(0.0))


def _monotonic_pattern(size: int) -> str:
    up = ["".join(str((s + i) % 10) for i in range(size)) for s in range(10)]
    down = ["".join(str((s - i) % 10) for i in range(size)) for s in range(10)]
    return "|".join(up + down)


def has_monotonic_run(d: Column, size: int = 4) -> Column:
    return d.rlike(_monotonic_pattern(size))


def is_beautiful(d: Column) -> Column:
    """A memorable pattern in the last seven digits."""
    tail = F.right(d, F.lit(7))
    size = F.length(tail)
    return (size > 0) & (
        (repeat_ratio(tail) >= 0.45)
        | (max_run(tail) >= 4.0 / F.greatest(size, F.lit(1)))
        | tail.rlike(r"(\d{2,3})\1+")
        | has_monotonic_run(tail)
    )


def operator_bucket(name: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(col(name), F.lit(""))))
    out = F.when(text == "", "unknown")
    for bucket, words in S.OPERATOR_RULES:
        out = out.when(contains_any(text, words), bucket)
    return out.otherwise("other")


def text_bucket(c: Column | str, buckets: int = 16) -> Column:
    """Polynomial hash (x31 mod 1000003) of the lower-cased text."""
    text = F.trim(F.lower(F.coalesce(col(c), F.lit(""))))
    value = F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: (acc * 31 + F.ascii(ch)) % 1000003,
    )
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(value % buckets)


def utc_offset(region: Column | str) -> Column:
    text = F.lower(F.coalesce(col(region), F.lit("")))
    out = None
    for hours, words in S.UTC_OFFSET_RULES:
        test = contains_any(text, words)
        out = F.when(test, F.lit(hours)) if out is None else out.when(test, F.lit(hours))
    return out.otherwise(F.lit(S.UTC_OFFSET_DEFAULT)).cast("bigint")


def plan_number_type(code: Column) -> Column:
    """Number type by code range, as the numbering plan uses it."""
    return (
        F.when(code.between(900, 999), "mobile")
        .when(code.between(300, 499), "landline")
        .when(code == 800, "tollfree")
        .when(code.isin(700, 780), "virtual")
        .otherwise("other")
    )


def legacy_prefix_risk(n: Column) -> Column:
    """Fixed risks for a number when no prefix table is at hand."""
    d = digits(n)
    return (
        F.when(n.startswith("+7800"), 0.25)
        .when(n.startswith("+7495") | n.startswith("+7499"), 0.35)
        .when(
            (F.length(d) >= 4) & d.startswith("79"),
            F.when(F.substring(d, 2, 3).try_cast("int").isin(S.LEGACY_RISKY_MOBILE), 0.65).otherwise(0.3),
        )
        .when(n.startswith("+84"), 0.8)
        .otherwise(0.1)
    )


def mask_number(n: Column) -> Column:
    """Keep five characters in front and two behind; short numbers stay as they are."""
    return F.when(
        F.length(n) > 6, F.concat(F.substring(n, 1, 5), F.lit("•••"), F.right(n, F.lit(2)))
    ).otherwise(n)


def split_phones(c: Column | str) -> Column:
    """Numbers of one map tag: split on ; , and |."""
    parts = F.transform(F.split(col(c), r"[;,|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def digit_flags(d: Column) -> dict[str, Column]:
    """The four digit-shape features."""
    return {
        "digitEntropy": clamp01(digit_entropy(d)),
        "repeatDigitRatio": clamp01(repeat_ratio(d)),
        "maxSameDigitRun": clamp01(max_run(d)),
        "beautifulNumberFlag": is_beautiful(d).cast("double"),
    }
