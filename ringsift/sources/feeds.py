"""Feed readers: everything is read as text under an explicit header and coerced later."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import phone
from ..functions.numeric import first_non_empty, safe_float, safe_int
from ..operators import decide
from ..operators.merge import best_row


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def to_english(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: S.RU_TO_FIELD[c] for c in df.columns if c in S.RU_TO_FIELD})


def to_russian(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: S.FIELD_TO_RU[c] for c in df.columns if c in S.FIELD_TO_RU})


def read_feed(spark: SparkSession, path: str, columns: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """Text columns of a CSV with translated headers. A missing file has no rows.

    With ``columns`` the result has exactly these; absent ones are ''. Quoted values may hold line
    breaks, so a file is read by one task; without ``multiline`` large files are split at line ends.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], S.string_schema(columns or S.RAW_REPUTATION_COLUMNS))
    df = to_english(
        spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"', encoding="utf-8")
    )
    if columns is not None:
        df = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    return df.na.fill("")


#: The upper half of a one-byte code page, read byte by byte and as windows-1251.
_BYTES = bytes(b for b in range(0x80, 0x100) if b != 0x98)
_AS_LATIN, _AS_CYRILLIC = _BYTES.decode("latin-1"), _BYTES.decode("cp1251")


def from_cp1251(c: Column) -> Column:
    """Text that was read as ISO 8859-1 but is windows-1251; Spark's readers lack that code page."""
    return F.translate(c, _AS_LATIN, _AS_CYRILLIC)


def to_cp1251(c: Column) -> Column:
    """The reverse, for writing."""
    return F.translate(c, _AS_CYRILLIC, _AS_LATIN)


def read_plan(spark: SparkSession, path: str, encoding: str = "windows-1251") -> DataFrame:
    """Numbering plan: ``;``-separated code, start, end, capacity, operator, region.

    Short lines and lines whose numbers cannot be read (the header among them) are dropped.
    """
    names = ["code", "start", "end", "capacity", "operator", "region"]
    cyrillic = encoding == "windows-1251"
    read_as = "iso-8859-1" if cyrillic else encoding
    raw = spark.read.csv(path, sep=";", schema=S.string_schema(names), encoding=read_as, comment="#")
    if cyrillic:
        raw = raw.withColumns({c: from_cp1251(F.col(c)) for c in ("operator", "region")})
    typed = raw.filter(F.col("region").isNotNull()).select(
        F.trim("code").try_cast("bigint").alias("def_code"),
        F.trim("start").try_cast("bigint").alias("start_number"),
        F.trim("end").try_cast("bigint").alias("end_number"),
        F.trim("operator").alias("operator"),
        F.trim("region").alias("region"),
        F.trim("capacity").try_cast("bigint").alias("capacity"),
    ).dropna(subset=["def_code", "start_number", "end_number", "capacity"])
    return typed.withColumn("number_type", phone.plan_number_type(F.col("def_code")))


def read_typed_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan written by us: typed columns under a header."""
    return spark.read.csv(path, header=True, schema=S.NUMBERING_PLAN)


def _pick(df: DataFrame, names: list[str], mode: str) -> Column:
    """First alias that has a value, or the first alias column that exists."""
    present = [n for n in names if n in df.columns]
    if not present:
        return F.lit("")
    if mode == "column":
        return F.coalesce(F.col(present[0]).cast("string"), F.lit(""))
    return first_non_empty(*[F.col(n).cast("string") for n in present])


# Alias columns of a feed, first one first.
ALIASES = {
    "number": ["normalized_number", "phone", "number"],
    "negative_count": ["negative_count", "negative", "bad"],
    "positive_count": ["positive_count", "positive", "good"],
    "neutral_count": ["neutral_count", "neutral"],
    "review_count": ["review_count", "reviews", "overall"],
    "view_count": ["view_count", "views"],
    "search_volume": ["search_volume"],
    "related_count": ["related_count"],
    "source_confidence": ["source_confidence", "confidence"],
    "source_reliability": ["source_reliability"],
    "categories": ["categories", "category", "rating"],
}


def canonical_reputation(df: DataFrame, source_hint: str = "unknown", alias_mode: str = "column") -> DataFrame:
    """Canonical seventeen columns of one feed, rows without a valid number dropped.

    The number always takes the first non-empty alias; the other fields follow ``alias_mode``.
    Extra columns of the input such as an order column are kept behind.
    """
    if alias_mode not in ("column", "value"):
        raise ValueError(f"unknown alias mode {alias_mode!r}")
    number = phone.normalize(_pick(df, ALIASES["number"], "value"))
    ints = {
        n: safe_int(_pick(df, ALIASES[n], alias_mode))
        for n in ("negative_count", "positive_count", "neutral_count", "review_count", "view_count", "search_volume", "related_count")
    }
    votes = ints["negative_count"] + ints["positive_count"] + ints["neutral_count"]
    reviews = F.when(ints["review_count"] > 0, ints["review_count"]).otherwise(votes)
    views = ints["view_count"]
    search = F.when((ints["search_volume"] <= 0) & (views > 0), views).otherwise(ints["search_volume"])
    text = lambda n: _pick(df, [n], "column")
    known = {a for names in ALIASES.values() for a in names} | set(S.RAW_REPUTATION_COLUMNS)
    rest = [c for c in df.columns if c not in known]
    return df.select(
        number.alias("normalized_number"),
        first_non_empty(text("source"), F.lit(source_hint)).alias("source"),
        ints["negative_count"].alias("negative_count"),
        ints["positive_count"].alias("positive_count"),
        ints["neutral_count"].alias("neutral_count"),
        reviews.alias("review_count"),
        search.alias("search_volume"),
        _pick(df, ALIASES["categories"], alias_mode).alias("categories"),
        first_non_empty(text("last_review_at"), text("detail_date")).alias("last_review_at"),
        text("first_seen_at").alias("first_seen_at"),
        safe_float(_pick(df, ALIASES["source_confidence"], alias_mode), 0.5).alias("source_confidence"),
        safe_float(_pick(df, ALIASES["source_reliability"], alias_mode), 0.5).alias("source_reliability"),
        views.alias("view_count"),
        ints["related_count"].alias("related_count"),
        text("detail_date").alias("detail_date"),
        text("page_title").alias("page_title"),
        text("url").alias("url"),
        *rest,
    ).filter(phone.is_valid("normalized_number"))


def canonical_blacklist(df: DataFrame, source: str) -> DataFrame:
    """A public block list as reputation rows: one negative review each, fixed reliability."""
    number = phone.normalize(_pick(df, ALIASES["number"], "value"))
    conf = safe_float(_pick(df, ["confidence", "source_confidence"], "column"), 0.85)
    rest = [c for c in df.columns if c not in ("normalized_number", "phone", "number", "category", "confidence", "source_confidence", "url", "source")]
    zero, one, empty = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit("")
    return df.select(
        number.alias("normalized_number"), F.lit(source).alias("source"), one.alias("negative_count"),
        zero.alias("positive_count"), zero.alias("neutral_count"), one.alias("review_count"), zero.alias("search_volume"),
        first_non_empty(_pick(df, ["category"], "column"), F.lit("мошенничество")).alias("categories"),
        empty.alias("last_review_at"), empty.alias("first_seen_at"), conf.alias("source_confidence"),
        F.lit(0.85).alias("source_reliability"), zero.alias("view_count"), zero.alias("related_count"),
        empty.alias("detail_date"), empty.alias("page_title"), _pick(df, ["url"], "column").alias("url"), *rest,
    ).filter(phone.is_valid("normalized_number"))


def canonical_allowlist(official: DataFrame, legitimate: DataFrame, order: str) -> DataFrame:
    """One row per allowed number; the official feed wins. Of equal feeds the last official and
    the first legitimate row stays."""

    def part(df: DataFrame, rank: int, category: Column, source: Column, conf: Column, position: Column) -> DataFrame:
        return df.select(
            phone.normalize(_pick(df, ALIASES["number"], "value")).alias("normalized_number"),
            _pick(df, ["name"], "column").alias("name"), category.alias("category"), source.alias("source"),
            conf.alias("source_confidence"), F.lit(rank).alias("_rank"), position.alias("_ord"),
        )

    own = part(
        official, 0, _pick(official, ["category"], "column"), F.lit("whitelist_official"), F.lit(0.95), -F.col(order)
    )
    cat = _pick(legitimate, ["category"], "column")
    src = first_non_empty(_pick(legitimate, ["source"], "column"), F.lit("legitimate"))
    conf = decide.list_confidence(_pick(legitimate, ["source_confidence"], "column"), cat, src)
    other = part(legitimate, 1, cat, F.concat(F.lit("legitimate_"), src), conf, F.col(order))
    both = own.unionByName(other).filter(phone.is_valid("normalized_number"))
    return best_row(both, ["normalized_number"], [F.col("_rank"), F.col("_ord")]).drop("_rank", "_ord")


def import_foreign(df: DataFrame, source: str) -> DataFrame:
    """A foreign CSV under twelve canonical columns; foreign numbers are kept."""
    number = phone.normalize(_pick(df, ["normalized_number", "phone", "number", "Телефон"], "value"), False)
    neg = safe_int(_pick(df, ["negative_count", "negative", "bad"], "value"))
    pos = safe_int(_pick(df, ["positive_count", "positive", "good"], "value"))
    neu = safe_int(_pick(df, ["neutral_count", "neutral"], "value"))
    given = _pick(df, ["review_count", "reviews"], "value")
    reviews = F.when(given == "", neg + pos + neu).otherwise(safe_int(given))
    conf = _pick(df, ["source_confidence", "confidence"], "value")
    return df.select(
        number.alias("normalized_number"), F.lit(source).alias("source"), neg.alias("negative_count"),
        pos.alias("positive_count"), neu.alias("neutral_count"), reviews.alias("review_count"),
        safe_int(_pick(df, ["search_volume", "views"], "value")).alias("search_volume"),
        _pick(df, ["categories", "category", "tags"], "value").alias("categories"),
        _pick(df, ["last_review_at"], "column").alias("last_review_at"),
        _pick(df, ["first_seen_at"], "column").alias("first_seen_at"),
        safe_float(conf, 0.7).alias("source_confidence"), _pick(df, ["url"], "column").alias("url"),
    ).filter(F.col("normalized_number").isNotNull())


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sorted numbers of a text list: # comments out, first comma field in."""
    line = F.trim("value")
    field = F.trim(F.split_part(line, F.lit(","), F.lit(1)))
    lines = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    return (
        lines.select(phone.normalize(field, False).alias("normalized_number"))
        .dropna().distinct().orderBy("normalized_number")
    )


def parse_blocklist(lines: DataFrame, order: str) -> DataFrame:
    """Block-list lines as (kind, key, pattern): exact numbers, prefixes and regular expressions.

    A prefix becomes an anchored, escaped pattern. Patterns the engine cannot compile are left
    out: each distinct one is tried once. The first line of each key stays.
    """
    line = F.trim("value")
    body = F.trim(F.regexp_replace(line, "^(prefix|regex):", ""))
    kind = F.when(line.startswith("prefix:"), "prefix").when(line.startswith("regex:"), "regex").otherwise("exact")
    escaped = F.concat(F.lit("^"), F.regexp_replace(body, r"([^0-9A-Za-z_])", r"\\$1"))
    pattern = F.when(kind == "prefix", escaped).when(kind == "regex", body)
    key = F.when(kind == "exact", phone.normalize_block_key(line)).otherwise(body)
    rows = lines.filter((line != "") & ~line.startswith("#")).select(
        kind.alias("kind"), key.alias("key"), pattern.alias("pattern"), line.alias("line"), F.col(order)
    )
    rows = rows.filter(F.coalesce("key", F.lit("")) != "")
    unique = best_row(rows.withColumn("_id", F.coalesce("pattern", "key")), ["_id"], [F.col(order)]).drop("_id")
    return unique.filter((F.col("kind") != "regex") | compiles("pattern"))


def _is_pattern(text: str | None) -> bool:
    try:
        return text is not None and re.compile(text) is not None
    except re.error:
        return False


@F.pandas_udf(T.BooleanType())
def _compiles(s: pd.Series) -> pd.Series:
    return s.map(_is_pattern)


def compiles(pattern: str) -> Column:
    """Is the text a regular expression? Tested in batches of distinct patterns."""
    return _compiles(F.col(pattern))


CORPUS_COLUMNS = ["packageName", "label", "category"]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Strict three-column corpus: another header is an error, rows of another width are dropped."""
    header = spark.read.text(path).limit(1).collect()
    found = header[0][0].lstrip("﻿").strip().split(",") if header else []
    if found != CORPUS_COLUMNS:
        raise ValueError(f"corpus header is {found}, expected {CORPUS_COLUMNS}")
    schema = S.string_schema(CORPUS_COLUMNS)
    return spark.read.csv(
        path, header=True, schema=schema, enforceSchema=False, mode="DROPMALFORMED", escape='"'
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of saved API answers, one row per item."""
    schema = (
        "response struct<count:bigint,items:array<struct<id:bigint,from_id:bigint,owner_id:bigint,date:bigint,text:string>>>"
    )
    raw = spark.read.json(path, schema=schema, multiLine=True)
    return raw.select(F.explode("response.items").alias("p")).select("p.*")


def parse_posts(df: DataFrame, column: str) -> DataFrame:
    """The same from a column of JSON texts."""
    schema = "response struct<items:array<struct<id:bigint,from_id:bigint,owner_id:bigint,date:bigint,text:string>>>"
    return df.select(F.explode(F.from_json(column, schema)["response"]["items"]).alias("p")).select("p.*")


def user_posts(posts: DataFrame) -> DataFrame:
    """Posts by people, not by communities, that have a text."""
    return posts.filter((F.col("from_id") > 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def read_official(spark: SparkSession, path: str) -> DataFrame:
    """Official list without a header: number, name, category; # comments are left out."""
    raw = spark.read.csv(path, schema=S.string_schema(["number", "name", "category"]), comment="#")
    return raw.select(
        phone.normalize("number").alias("normalized_number"), F.trim("name").alias("name"), F.trim("category").alias("category")
    ).dropna(subset=["normalized_number"])
