"""Deduplication, merging and set operations.

"First in input order" has no meaning on a distributed table, so every operator that needs it
takes an explicit order column. Winners are found by an aggregate with map-side combine; a key
that holds a third of all rows leaves each map task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phone


def best_row(df: DataFrame, keys: list[str], rank: list[Column], pick: str = "min") -> DataFrame:
    """The whole row with the smallest (or largest) rank per key."""
    fold = F.min_by if pick == "min" else F.max_by
    best = fold(F.struct(*df.columns), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)]))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best.alias("_r")).select("_r.*")


def source_priority(df: DataFrame, key: str, rank: str, order: str) -> DataFrame:
    """Lowest source rank wins, earliest row on ties; sorted by the key's first appearance."""
    row = F.struct(*df.columns)
    out = df.groupBy(F.col(key).alias("_k")).agg(
        F.min_by(row, F.struct(F.col(rank).alias("a"), F.col(order).alias("b"))).alias("_r"),
        F.min(order).alias("first_seen"),
    )
    return out.select("_r.*", "first_seen").orderBy("first_seen")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Earliest row per key."""
    return best_row(df, keys, [F.col(order)])


def confidence_upgrade(df: DataFrame, order: str, number: str = "normalized_number") -> DataFrame:
    """Highest confidence per valid number, the earlier row on ties; unreadable counts as .70."""
    trimmed = df.withColumn(number, F.trim(F.col(number)))
    valid = trimmed.filter(phone.is_valid(number)).withColumn(
        "confidence_value", F.coalesce(F.trim(F.col("source_confidence")).try_cast("double"), F.lit(0.70))
    )
    return best_row(valid, [number], [-F.col("confidence_value"), F.col(order)]).orderBy("category", number)


SNAPSHOT_KEY = [
    "normalized_number", "source", "detail_date", "review_count", "negative_count",
    "positive_count", "last_review_at",
]


def append_snapshots(master: DataFrame, shards: DataFrame, order: str) -> DataFrame:
    """Master rows as they are, plus shard rows with a new seven-field signature."""
    usable = shards.filter(
        phone.is_valid("normalized_number") & (F.coalesce(F.col("source"), F.lit("")) != "")
    )
    fresh = first_wins(usable, SNAPSHOT_KEY, order)
    known = master.select(*SNAPSHOT_KEY).distinct()
    hit = [fresh[c].eqNullSafe(known[c]) for c in SNAPSHOT_KEY]
    return master.unionByName(fresh.join(known, hit, "left_anti"))


EVIDENCE_KEY = ["normalized_number", "source", "url"]


def new_evidence(stored: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Fresh evidence whose (number, source, url) is not stored yet, first one of each."""
    return first_wins(fresh, EVIDENCE_KEY, order).join(
        stored.select(*EVIDENCE_KEY).distinct(), EVIDENCE_KEY, "left_anti"
    )


def union_feeds(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds under each other; an empty source is filled with the feed's name."""
    out = None
    for hint, feed in feeds.items():
        source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(hint))
        part = feed.withColumn("source", source)
        out = part if out is None else out.unionByName(part)
    return out


def key_union(*tables: DataFrame, key: str) -> DataFrame:
    """Distinct keys of all tables."""
    out = tables[0].select(key)
    for table in tables[1:]:
        out = out.union(table.select(key))
    return out.distinct()


def key_except(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def key_intersect(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def replace_by_origin(table: DataFrame, fresh: DataFrame, origin: str, key: str) -> DataFrame:
    """Rows of one origin are replaced; fresh rows whose key is held by another origin are ignored."""
    kept = table.filter(F.col("source") != origin)
    return kept.unionByName(fresh.withColumn("source", F.lit(origin)).join(kept.select(key), key, "left_anti"))


def update_verdicts(records: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Records with the verdict of the change table where there is one; changes are unique on key."""
    part = changes.select(key, F.col("verdict").alias("_new"))
    found = records.join(part, key, "left")
    return found.withColumn("verdict", F.coalesce("_new", "verdict")).drop("_new")


def recent_distinct(
    events: DataFrame, user: str, item: str, ts: str, now_ms: Column, lookback_ms: int, limit: int
) -> DataFrame:
    """The latest ``limit`` distinct items of each user in the look-back.

    Rows shrink to one per user and item first; the rank limit is then pushed below the shuffle.
    """
    from pyspark.sql import Window

    recent = events.filter((F.col(ts) >= now_ms - lookback_ms) & (F.col(ts) <= now_ms))
    latest = recent.groupBy(user, item).agg(F.max(ts).alias(ts))
    newest = Window.partitionBy(user).orderBy(F.desc(ts), F.asc(item))
    return latest.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)


def joined_parts(df: DataFrame, key: str, columns: dict[str, tuple[str | None, str]]) -> DataFrame:
    """Per key and column the sorted distinct parts of its texts, joined.

    ``columns`` maps a column to (what its texts are split at, or None; what the parts are joined by).
    Parts are rows until they are distinct, so a key with many rows is shrunk before it is put together.
    """
    def parts(name: str, sep: str | None) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        pieces = F.array(text) if sep is None else F.transform(F.split(text, sep), lambda x: F.trim(x))
        return F.transform(pieces, lambda x: F.struct(F.lit(name).alias("column"), x.alias("part")))

    rows = df.select(key, F.explode(F.concat(*[parts(n, sep) for n, (sep, _) in columns.items()])).alias("_x")).select(key, "_x.*")
    rows = rows.filter(F.col("part") != "").distinct()
    return rows.groupBy(key).agg(*[
        F.expr(f"coalesce(listagg(CASE WHEN column = '{n}' THEN part END, '{glue}') WITHIN GROUP (ORDER BY part), '')").alias(n)
        for n, (_, glue) in columns.items()
    ])


def review_rollup(df: DataFrame, number: str = "normalized_number") -> DataFrame:
    """Sums of review counts and all categories of a number."""
    sums = df.groupBy(number).agg(*[F.sum(c).alias(c) for c in ("negative_count", "positive_count", "review_count")])
    return sums.join(joined_parts(df, number, {"categories": (";", ";")}), number, "left").na.fill("", ["categories"])
