"""Text expressions: categories, key words, n-grams, truncation."""

from __future__ import annotations

import html as html_lib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .numeric import col, contains_any
from .once import let

#: Phrases such as "not spam" are taken out before words are counted.
NEGATED = r"(?U)\bне\s+(?:мошен|спам|реклам|опасн)\w*"


def category_flags(categories: Column | str) -> dict[str, Column]:
    text = F.lower(F.coalesce(col(categories), F.lit("")))
    return {
        "has_fraud_category": contains_any(text, S.FRAUD_WORDS).cast("double"),
        "has_telemarketing_category": contains_any(text, S.TELEMARKETING_WORDS).cast("double"),
        "has_finance_category": contains_any(text, S.FINANCE_WORDS).cast("double"),
    }


def without_negated(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NEGATED, " ")


def count_word(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word))


def _count_all(clean: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_word(clean, w) for w in words]).cast("bigint")


def count_words(c: Column, words: list[str]) -> Column:
    """Occurrences of all words, negated phrases left out."""
    return let(without_negated(c), lambda text: _count_all(text, words))


def evidence_categories(c: Column) -> Column:
    """Sorted categories a review text falls into."""

    def found(text: Column) -> Column:
        tests = [F.when(text.contains(name.lower()), F.lit(name)) for name in S.EVIDENCE_CATEGORIES]
        tests.append(F.when(contains_any(text, S.EVIDENCE_FRAUD), F.lit("мошенничество")))
        tests.append(F.when(contains_any(text, S.EVIDENCE_WARN), F.lit("спам")))
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*tests))))

    return let(without_negated(c), found)


def has_signal(c: Column, categories: Column) -> Column:
    """Any non-neutral category, or any fraud or warning word."""
    return F.exists(categories, lambda x: ~x.isin(S.NEUTRAL_CATEGORIES)) | let(
        without_negated(c), lambda text: contains_any(text, S.EVIDENCE_FRAUD + S.EVIDENCE_WARN)
    )


# Counts above these are not believed by crawlers. Parameters, off by default.
VIEWS_BELIEVED, REVIEWS_BELIEVED = 5_000_000, 5000


def _largest_number(c: Column, pattern: str, most: int | None) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    values = F.transform(found, lambda x: x.try_cast("bigint"))
    values = values if most is None else F.filter(values, lambda v: v <= most)
    return F.coalesce(F.array_max(values), F.lit(0).cast("bigint"))


def view_count(c: Column, most: int | None = None) -> Column:
    """Largest number in front of a word for views, requests or searches; numbers above ``most`` do not count."""
    return _largest_number(c, r"(?iu)(?<!\d)(\d+)\s+(?:просмотр|запрос|поиск)", most)


def review_count(c: Column, most: int | None = None) -> Column:
    """Largest number in front of a word for reviews or ratings; numbers above ``most`` do not count."""
    return _largest_number(c, r"(?iu)(?<!\d)(\d+)\s+(?:отзыв|оценк|оценок)", most)


def page_date(c: Column) -> Column:
    """First d.m.y date, else first y-m-d date, as yyyy-mm-dd; '' when there is none."""
    dmy = r"(\d{1,2})[./](\d{1,2})[./](\d{4})"
    ymd = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(c, pattern, group)
        return F.when(F.length(found) < 2, F.lpad(found, 2, "0")).otherwise(found)

    return (
        F.when(c.rlike(dmy), F.concat_ws("-", part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .when(c.rlike(ymd), F.concat_ws("-", part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .otherwise(F.lit(""))
    )


def section_between(text: Column, starts: list[str], ends: list[str]) -> Column:
    """From the earliest start marker to the nearest end marker behind it; '' without a start."""

    def positive(marks: Column) -> Column:
        return F.array_min(F.filter(marks, lambda p: p > 0))

    def cut(pair: Column) -> Column:
        body, low = pair["t"], pair["l"]
        first = positive(F.array(*[_locate_after(F.lit(m.lower()), low, F.lit(1)) for m in starts]))

        def from_start(start: Column) -> Column:
            stops = [_locate_after(F.lit(m.lower()), low, start + 1) for m in ends]
            stop = positive(F.array(*stops, F.length(body) + 1))
            return F.trim(F.substr(body, start, stop - start))

        return F.coalesce(let(first, from_start), F.lit(""))

    return let(F.struct(text.alias("t"), F.lower(text).alias("l")), cut)


def _locate_after(marker: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", marker, text, start)


def truncate(c: Column, limit: int | None) -> Column:
    """Collapse white space; texts longer than a limit, if there is one, are cut and end with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    if limit is None:
        return flat
    cut = F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def ngrams(c: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams, all of the first size, then of the next."""

    def of_size(n: int) -> Column:
        last = F.length(c) - (n - 1)
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))

    return F.concat(*[of_size(n) for n in sizes])


#: Fixed value: characters of the longest label that the app corpus believes.
LABEL_CHARS = 200


def strip_label(c: Column, limit: int | None = None) -> Column:
    """Canonical Unicode composition, trimmed; labels of more than ``limit`` characters (``LABEL_CHARS``) become ''."""
    text = F.trim(nfc(F.coalesce(c, F.lit(""))))
    return text if limit is None else F.when(F.length(text) > limit, F.lit("")).otherwise(text)


def nfc(c: Column) -> Column:
    """Unicode NFC. Plain ASCII never leaves the JVM."""
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfc_udf(odd), c)


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


#: What ``html.unescape`` takes for a character reference.
CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda refs: [html_lib.unescape(r) for r in refs], na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities to characters. Only the references go to Python, not the texts around them."""
    refs = let(c, lambda x: F.when(x.contains("&"), F.regexp_extract_all(x, F.lit(CHARREF), F.lit(0))))

    def put(pair: Column) -> Column:
        gaps = F.split(pair["t"], CHARREF, -1)
        whole = F.zip_with(gaps, F.concat(pair["r"], F.array(F.lit(""))), lambda gap, ref: F.concat(gap, ref))
        return F.when(F.size(pair["r"]) > 0, F.array_join(whole, "")).otherwise(pair["t"])

    return let(F.struct(c.alias("t"), _unescape_udf(refs).alias("r")), put)


def app_category(c: Column) -> Column:
    """One of the twenty names, else OTHER."""
    name = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(name.isin(S.APP_CATEGORIES), name).otherwise(F.lit("OTHER"))


def app_category_unknown(c: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return ~name.isin(S.APP_CATEGORIES)


def app_bucket(category: Column) -> Column:
    """Twenty categories to five buckets."""
    out = None
    for name, bucket in S.APP_BUCKETS.items():
        out = F.when(category == name, bucket) if out is None else out.when(category == name, bucket)
    return out.otherwise(F.lit("OTHER"))


def is_list_source(c: Column) -> Column:
    """Source of a shipped allow list."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return s.startswith("whitelist") | s.startswith("static_whitelist")


def is_public_blacklist_source(*sources: Column) -> Column:
    tests = []
    for c in sources:
        s = F.lower(F.coalesce(c, F.lit("")))
        tests += [s.contains("moshelovka"), s.contains("public_blacklist")]
    return reduce(lambda a, b: a | b, tests)
